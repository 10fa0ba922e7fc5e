"""Token ids as length-delimited binary records with an index of offsets.

A file is a sequence of frames::

    uint64  length of the payload
    uint32  masked CRC-32 of the eight length bytes
    payload: uint8 1 if the id is present, uint8 bytes per token (2 or 4), int64 id (0 if absent), the token ids
    uint32  masked CRC-32 of the payload
    0x0A    end of frame

All numbers are little-endian. A checksum is masked (rotated by 15 bits, plus a constant), so that checksums of data that
holds checksums stay sound. Files are numbered in the order of ids, and frames within a file are in that order too.
Spark's own writer commits the files, on any store that Spark can write and with lost executors repeated.

The index is a Parquet table beside the files, made by reading them back and verifying every checksum: file,
offset and length of each frame, so that a reader can fetch sequences in any order.

Texts are cut into segments at blanks that the tokenizer never reads across, and the segments, which repeat, are encoded once per
task by the tokenizers library, many of them joined to one text. Texts with the text of an added token are encoded whole.

Edge cases: null and empty texts give the end id alone; ids must be integers (others, as text, fail where they can't be cast); null ids
come first; rows of equal ids follow each other in the order in which the table holds them; an empty
table gives no files and an empty index; other input columns are not stored.
"""

from __future__ import annotations

import itertools
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanloom.llm.common import whole_text
from gleanloom.llm.segments import GLUED, JOINED, chunks_of, runs_of, segments
from gleanloom.scale import BATCH_BYTES, broadcast_if_small, setting, shared_dir

END = 0
FILE_BYTES = 32 << 20
CACHE = 200_000
#: Most bytes of an Arrow batch, in the JVM and in Python, beyond its first row.
SENT_BYTES = 4 << 20
SIGNS = ".,;:!?"
RUN_BYTES = 2 << 20
INDEX = ("file string, offset long, length long, doc_id long, n_tokens long, ids_crc32 long, tokens_before long, file_tokens long")


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes, width: int) -> bytes:
    payload = struct.pack("<BBq", doc_id is not None, width, doc_id or 0) + ids
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked(length)) + payload + struct.pack("<I", masked(payload)) + b"\n"


def read_frame(content, offset: int = 0) -> tuple[int | None, np.ndarray, int]:
    """(id, token ids, offset of the next frame) of the frame at ``offset``; raises where a checksum fails."""
    head = bytes(content[offset : offset + 12])
    length, crc = struct.unpack("<QI", head)
    payload = bytes(content[offset + 12 : offset + 12 + length])
    end = offset + 12 + length
    if crc != masked(head[:8]) or struct.unpack("<I", content[end : end + 4])[0] != masked(payload) or content[end + 4] != 10:
        raise ValueError(f"damaged frame at offset {offset}")
    present, width, doc_id = struct.unpack("<BBq", payload[:10])
    return (doc_id if present else None), np.frombuffer(payload, f"<u{width}", offset=10), end + 5


def gathered(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of the pool, one after the other."""
    ends = np.cumsum(sizes)
    return pool[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


class SegmentEncoder:
    """Encodes texts with the tokenizers library; distinct segments are encoded once, joined to longer texts, and kept in one array."""

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        vocabulary = self.tokenizer.get_vocab()
        self.width = 2 if len(vocabulary) <= 1 << 16 else 4
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Bytes of text per token: a character of a byte-level entry stands for a byte. Others are encoded whole.
        self.byte_level = "use_regex=True" in str(self.tokenizer.pre_tokenizer) and self.tokenizer.normalizer is None
        self.lengths = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.lengths[list(vocabulary.values())] = [len(token) for token in vocabulary]
        self.tails: dict[str, bytes] = {}
        self.end = self.packed([END])
        self.forget()

    def forget(self) -> None:
        """Known segments, and where each one's tokens start in the pool, and how many they are."""
        self.known = pa.array([], pa.string())
        self.starts, self.sizes, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, f"<u{self.width}")

    def packed(self, ids: list[int]) -> bytes:
        return np.array(ids, f"<u{self.width}").tobytes()

    def whole(self, texts: list[str]) -> list[bytes]:
        return [self.packed(found.ids) for found in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, new: pa.StringArray) -> np.ndarray:
        """Encode segments, each behind a blank, and cut the tokens where the segments' bytes end; returns the places of the segments."""
        plain = pc.match_substring_regex(new, "^[!-~]+$")
        easy, odd = new.filter(plain), new.filter(pc.invert(plain)).to_pylist()
        chunks = chunks_of(odd)
        cuts = pa.array([*range(0, len(easy), JOINED), len(easy)], pa.int32())
        joined = pc.binary_join(pa.ListArray.from_arrays(cuts, easy), " ").to_pylist() + [" ".join(chunk) for chunk in chunks]
        found = [e.ids for e in self.tokenizer.encode_batch_fast([" " + text for text in joined], add_special_tokens=False)]
        ids = np.fromiter(itertools.chain.from_iterable(found), f"<u{self.width}")
        others = [s for chunk in chunks for s in chunk]
        words = pa.concat_arrays([easy, pa.array(others, pa.string())])
        token_ends, ends = np.cumsum(self.lengths[ids]), np.cumsum(pc.binary_length(words).to_numpy().astype(np.int64) + 1)
        stops = np.searchsorted(token_ends, ends) + 1
        if len(words) and not np.array_equal(token_ends[np.minimum(stops, len(ids)) - 1], ends):
            alone = self.whole([" " + s for s in words.to_pylist()])
            ids, stops = np.frombuffer(b"".join(alone), f"<u{self.width}"), np.cumsum([len(a) for a in alone]) // self.width
        sizes, known = np.diff(stops, prepend=0), len(self.known)
        self.starts = np.append(self.starts, len(self.pool) + stops - sizes)
        self.sizes, self.pool = np.append(self.sizes, sizes), np.append(self.pool, ids)
        self.known = pa.concat_arrays([self.known, words])
        places, at = np.empty(len(new), np.int64), plain.to_numpy(zero_copy_only=False)
        places[at] = known + np.arange(len(easy))
        place_of = {s: known + len(easy) + k for k, s in enumerate(others)}
        places[~at] = [place_of[s] for s in odd]
        return places

    def places(self, words: pa.StringArray) -> np.ndarray:
        """The places of segments among those that are known, after new ones have been learnt."""
        if len(self.known) > CACHE:
            self.forget()
        coded = words.dictionary_encode()
        found = pc.index_in(coded.dictionary, self.known)
        places = found.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        if found.null_count:
            new = found.is_null()
            places[new.to_numpy(zero_copy_only=False)] = self.learn(coded.dictionary.filter(new))
        return places[coded.indices.to_numpy()]

    def pieces(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, number of tokens of each) of distinct segments.

        A word with a sentence's signs behind it is the word's tokens and those of the signs, which are pieces of their own.
        """
        stems = pc.ascii_rtrim(words, SIGNS)
        signed = pc.and_(pc.less(pc.binary_length(stems), pc.binary_length(words)), pc.ascii_is_alpha(stems))
        places = self.places(pc.if_else(signed, stems, words))
        tails = pc.replace_substring_regex(words.filter(signed), "^[A-Za-z]+", "").dictionary_encode()
        known = tails.dictionary.to_pylist()
        new = [t for t in known if t not in self.tails]
        self.tails.update(zip(new, self.whole(new)))
        behind = np.array([len(self.tails[t]) // self.width for t in known], np.int64)
        starts, sizes = np.zeros((2, len(words), 2), np.int64)
        starts[:, 0], sizes[:, 0] = self.starts[places], self.sizes[places]
        at = signed.to_numpy(zero_copy_only=False)
        codes = tails.indices.to_numpy()
        starts[at, 1], sizes[at, 1] = len(self.pool) + (np.cumsum(behind) - behind)[codes], behind[codes]
        pool = np.append(self.pool, np.frombuffer(b"".join([self.tails[t] for t in known]), f"<u{self.width}"))
        return gathered(pool, starts.reshape(-1), sizes.reshape(-1)), sizes.sum(axis=1)

    def joined(self, cut: pa.ListArray) -> list[bytes]:
        """The tokens of each text's segments but the first: distinct segments are looked up once, their tokens gathered as one array."""
        offsets = cut.offsets.to_numpy().astype(np.int64)
        behind = np.ones(offsets[-1] - offsets[0], bool)
        behind[offsets[:-1] - offsets[0]] = False
        coded = cut.flatten().filter(pa.array(behind)).dictionary_encode()
        codes = coded.indices.to_numpy()
        pool, sizes = self.pieces(coded.dictionary)
        taken = sizes[codes]
        ends = np.append(0, np.cumsum(taken))
        ids = gathered(pool, (np.cumsum(sizes) - sizes)[codes], taken)
        edges = ends[offsets - offsets[0] - np.arange(len(offsets))].tolist()
        return [ids[i:j].tobytes() for i, j in zip(edges, edges[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [self.byte_level and not any(a in t for a in self.added) for t in texts]
        glued = [ok and GLUED.search(t) is not None for t, ok in zip(texts, plain)]
        first, rest = list(texts), [b""] * len(texts)
        for way in (False, True):
            rows = [i for i, ok in enumerate(plain) if ok and glued[i] == way]
            if rows:
                own = [texts[i] for i in rows]
                cut = pa.array(map(segments, own), pa.list_(pa.string())) if way else pc.split_pattern(pa.array(own, pa.string()), " ")
                heads = cut.flatten().take(cut.offsets[:-1]).to_pylist()
                for i, head, tokens in zip(rows, heads, self.joined(cut)):
                    first[i], rest[i] = head, tokens
        # a text's first segment has no blank before it; other texts are encoded whole
        return [one + tokens + self.end for one, tokens in zip(self.whole(first), rest)]


def framer(tokenizer_file: str):
    def frames(batches):
        import gc
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        gc.disable()  # nothing here is cyclic, and the collector would go through all that is cached
        encoder = SegmentEncoder(tokenizer_file)
        for batch in batches:
            for keys, texts in runs_of(batch, RUN_BYTES):
                rows = [frame(k, ids, encoder.width)[:-1] for k, ids in zip(keys.to_pylist(), encoder.encode(texts))]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["frame"])

    return frames


def parse_files(batches):
    """Index rows of whole files: every frame is read and verified."""
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            view = memoryview(content.as_buffer())
            rows, offset, tokens = [], 0, 0
            while offset < len(view):
                doc_id, ids, after = read_frame(view, offset)
                rows.append((path, offset, after - offset, doc_id, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), tokens))
                offset, tokens = after, tokens + len(ids)
            columns = list(zip(*rows)) if rows else [()] * 7
            kinds = [pa.string(), *[pa.int64()] * 6]
            names = ["file", "offset", "length", "doc_id", "n_tokens", "ids_crc32", "tokens_before", "file_tokens"]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)] + [pa.array([tokens] * len(rows), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names)


def write_records(docs: DataFrame, path: str, tokenizer_file: str, doc_id: str = "doc_id", text: str = "text",
                  file_bytes: int = FILE_BYTES) -> None:
    """Write the files in ascending order of ids, about ``file_bytes`` of text to each.

    Rows are range-sorted before they are tokenized, as the sort samples its input once more. The second sort key tells rows of
    equal ids apart, so that any number of them can be dealt to several files.
    """
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("_id"), whole_text(text).alias("_text"))
    total = rows.agg(F.sum(F.octet_length("_text") + 16)).first()[0] or 0
    order = ["_id", "_copy"]
    ordered = rows.withColumn("_copy", F.monotonically_increasing_id()).repartitionByRange(max(1, -(-total // file_bytes)), *order)
    ordered = ordered.sortWithinPartitions(*order).select("_id", "_text")
    frames = ordered.mapInArrow(framer(tokenizer_file), "frame binary").select(F.col("frame").cast("string"))
    with setting(docs.sparkSession, BATCH_BYTES, str(SENT_BYTES), "64m"):
        frames.write.option("lineSep", "\n").text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, content) of all files."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")


def write_index(spark: SparkSession, path: str, index_path: str) -> DataFrame:
    """Read the files back, verify them and write their index; returns it. A batch holds one large file."""
    with setting(spark, BATCH_BYTES, str(SENT_BYTES), "64m"):
        read_files(spark, path).mapInArrow(parse_files, INDEX).write.parquet(index_path)
    return spark.read.schema(INDEX).parquet(index_path)


def file_number(file: str = "file") -> Column:
    """The number that Spark's writer gave a file: names sort like it only up to 99,999."""
    return F.regexp_extract(file, r"part-(\d+)", 1).cast("long")


def with_starts(index: DataFrame) -> DataFrame:
    """Add ``start``: tokens of all frames before. Only one row per file goes through the ordered sum."""
    files = index.groupBy("file").agg(F.max("file_tokens").alias("_tokens"))
    before = Window.orderBy(file_number(), "file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.withColumn("_before", F.coalesce(F.sum("_tokens").over(before), F.lit(0))).drop("_tokens")
    joined = index.join(broadcast_if_small(files), "file")
    return joined.withColumn("start", F.col("_before") + F.col("tokens_before")).drop("_before")


def shuffled_records(spark: SparkSession, path: str, index: DataFrame, seed: int) -> DataFrame:
    """(doc_id, ids) of the indexed frames in a pseudo-random order: each file is opened once, its frames are cut by offset and range-sorted by a hash."""
    wanted = index.groupBy("file").agg(F.collect_list("offset").alias("offsets"))

    def cut(batches):
        for batch in batches:
            for content, offsets in zip(batch.column(0), batch.column(1).to_pylist()):
                view = memoryview(content.as_buffer())
                found = [read_frame(view, o) for o in offsets]
                ids = pa.array([f[1].astype(np.int32) for f in found], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), ids], ["doc_id", "ids"])

    rows = read_files(spark, path).join(wanted, "file").select("content", "offsets").mapInArrow(cut, "doc_id long, ids array<int>")
    return rows.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id")


def scratch(spark: SparkSession) -> tuple[str, str]:
    base = f"{shared_dir(spark).rstrip('/')}/records-{uuid.uuid4().hex}"
    return f"{base}/files", f"{base}/index"
