"""Alignment of two tokenizers' tokens, and how often their ids meet in the corpus.

A is a byte-level BPE of the tokenizers library and encodes a blank and the text; B is a sentencepiece model, which adds the blank
itself. Strings of special tokens are plain text.

1. Texts are cut into segments at blanks that neither tokenizer reads across; a distinct segment is aligned once per task. Texts that
   can't be cut (a vocabulary with blanks inside its pieces) are one segment.
2. The spans of both libraries are coarse cuts: character offsets for A, begin and end of the pieces of the sentencepiece message for B.
   Where they share a character (parts of a multibyte character, byte-fallback pieces) the ends are refined with the lengths of
   the tokens' decoded bytes. Byte offsets at which tokens of both end cut the segment into groups.
3. A segment whose decoded bytes differ from the text on either side makes its text have no tokens.
4. A pair of ids counts once for each document that holds it linked. Tasks put about ``BLOCK_CHARS`` of text into a block, which is written
   once: figures and digests of its documents, their segments, the pairs of the segments, and in how many documents a pair occurs.
   Blocks send their pairs to ``PARTS`` parts of A's ids, in which they are added up over a tree of ``FAN`` blocks a step. A part
   holds all pairs of its A ids, so it knows the highest count of each. The totals go back to about ``FAN`` blocks at a time, and
   each block adds them up per document.

Memory is bounded by a block (or one text) and by the pairs of a part, at most the product of both vocabularies divided by ``PARTS``.
Groups of very many links are kept as distinct pairs with their multiplicity.

Edge cases: null and empty texts, and those whose bytes differ, give zeros and an empty ``groups_sha256``; texts of white space alone
have tokens like others; null and repeated ids, of any type, are rows like others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanloom.llm.common import opened, packed, squeezed, unpacked, whole_text, written
from gleanloom.llm.segments import chunks_of, runs_of, segments

PARTS = 64
FAN = 64
BLOCK_CHARS = 2 << 20
CACHE = 300_000
RUN_BYTES = 1 << 19
MANY_LINKS = 1 << 16
BLOCKS = ("_block long, ids array<{id}>, figures binary, digests binary, doc_sizes binary, doc_segments binary, doc_times binary, "
          "segment_sizes binary, segment_codes binary, segment_times binary, codes binary, counts binary")
SENT = "_part long, _block long, codes binary, counts binary"
RESULT = ("doc_id {id}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(others)}


_SPAN = operator.attrgetter("id", "end")


class Grown:
    """Rows in an array that doubles when it is full."""

    def __init__(self, dtype, width: int | None = None):
        self.data, self.n = np.zeros((1024, width) if width else 1024, dtype), 0

    def add(self, rows: np.ndarray) -> None:
        need = self.n + len(rows)
        if need > len(self.data):
            self.data = np.concatenate([self.rows, np.zeros((max(need, 2 * self.n) - self.n, *self.data.shape[1:]), self.data.dtype)])
        self.data[self.n : need] = rows
        self.n = need

    @property
    def rows(self) -> np.ndarray:
        return self.data[: self.n]


class Aligned:
    """Aligned segments of this task: one number per segment, its figures in arrays."""

    def __init__(self, file_a: str, file_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(file_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=file_b)
        alphabet = byte_alphabet()
        vocabulary = self.a.get_vocab()
        added = {t.content for t in self.a.get_added_tokens_decoder().values()}
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            self.bytes_a[k] = token.encode() if token in added else bytes(alphabet[ch] for ch in token)
        names = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(n[3:5], 16)]) if self.b.is_byte(k) else n.replace("▁", " ").encode() for k, n in enumerate(names)]
        self.width_a = np.array([len(t) for t in self.bytes_a], np.int64)
        self.width_b = np.array([len(t) for t in self.bytes_b], np.int64)
        numbers = [str(k) for k in range(max(len(self.bytes_a), len(self.bytes_b)))]
        #: Ids as text, each before a comma, then before a bar, then before a semicolon.
        self.written = [n + sign for sign in ",|;" for n in numbers]
        self.byte_pieces = np.array([self.b.is_byte(k) for k in range(len(names))])
        crossing = any(" " in t.lstrip(b" ").decode(errors="replace") for t in self.bytes_b)
        self.whole = crossing or "use_regex=True" not in str(self.a.pre_tokenizer)
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.texts: list[str] = []
        self.figures = Grown(np.int64, 5)  # n_a, n_b, n_groups, n_links, 1 where bytes differ
        self.sizes, self.codes, self.times = Grown(np.int32), Grown(np.uint32), Grown(np.int64)

    def cut(self, text: str) -> list[str]:
        """The segments of a blank and the text, each without the blank before it; a lone blank at the end stays with its segment,
        as the second library adds no blank to an empty text."""
        if self.whole:
            return [text]
        cut = segments(" " + text)[1:]
        return cut if cut[-1] else [*cut[:-2], cut[-2] + " "]

    def add(self, words: list[str]) -> None:
        """Align segments that are not known yet."""
        if not words:
            return
        chunks = [[w] for w in words] if self.whole else chunks_of(words)
        while chunks:
            chunks = self.aligned(chunks)

    def aligned(self, chunks: list[list[str]]) -> list[list[str]]:
        """Add the segments of the chunks whose bytes agree, and return those of the others one by one; a lone one that differs is marked."""
        plain = [" ".join(chunk) for chunk in chunks]
        joined = [" " + p for p in plain]
        # the second library adds the first blank
        found = list(zip(chunks, joined, self.a.encode_batch(joined, add_special_tokens=False), self.b.encode(plain, return_type="proto", num_threads=1)))
        good, again = [], []
        for chunk, text, a, b in found:
            ids_a, raw = a.ids, text.encode()
            ids_b, stops = zip(*map(_SPAN, b.pieces)) if b.pieces else ((), ())
            if b"".join(map(self.bytes_a.__getitem__, ids_a)) == raw and b"".join(map(self.bytes_b.__getitem__, ids_b)) == raw:
                good.append((chunk, text, raw, ids_a, a.offsets, ids_b, stops))
            elif len(chunk) > 1:
                again += [[w] for w in chunk]
            else:
                self.store(chunk, np.array([[0, 0, 0, 0, 1]]), [""], np.zeros(1, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64))
        if good:
            self.store(*self.measured(good))
        return again

    def measured(self, good: list[tuple]) -> tuple:
        """Groups and links of chunks, all in one run of arrays."""
        raw = b"".join([g[2] for g in good])
        size = np.array([len(g[2]) for g in good])
        base = np.cumsum(size) - size
        letters = np.append(np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80), len(raw))
        first = np.searchsorted(letters, base)
        flat = lambda k: itertools.chain.from_iterable([g[k] for g in good])
        ids_a, ids_b = np.fromiter(flat(3), np.int64), np.fromiter(flat(5), np.int64)
        count_a, count_b = (np.array([len(g[k]) for g in good]) for k in (3, 5))
        spans = np.fromiter(itertools.chain.from_iterable(flat(4)), np.int64).reshape(-1, 2) + np.repeat(first, count_a)[:, None]
        # A: a span that reaches into the next one's shares a character with it
        shared = np.append(spans[1:, 0] < spans[:-1, 1], False)
        ends_a = np.where(shared, np.cumsum(self.width_a[ids_a]), letters[spans[:, 1]])
        # B: begin and end count bytes of the text behind the added blank; only byte-fallback pieces are parts of a character
        ends_b = np.fromiter(flat(6), np.int64) + np.repeat(base, count_b) + 1
        ends_b = np.where(self.byte_pieces[ids_b], np.cumsum(self.width_b[ids_b]), ends_b)
        common = np.intersect1d(ends_a, ends_b)
        words = [w for g in good for w in g[0]]
        ends = letters[np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)]
        a, b = (np.searchsorted(e, common, "right") for e in (ends_a, ends_b))
        a0, b0 = np.append(0, a[:-1]), np.append(0, b[:-1])
        n_a, n_b = a - a0, b - b0
        last = np.searchsorted(common, ends) + 1
        begin = np.append(0, last[:-1])
        total = lambda values: np.add.reduceat(values, begin)
        links = n_a * n_b
        figures = np.stack([total(n_a), total(n_b), last - begin, total(links), np.zeros(len(words), np.int64)], axis=1)
        # the ids of a group stand in a row, those of A first; each is written with the sign behind it
        row = np.zeros(len(ids_a) + len(ids_b), np.int64)
        step = len(self.written) // 3
        sign_a, sign_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
        sign_a[a - 1], sign_b[b - 1] = step, 2 * step
        row[np.arange(len(ids_a)) + np.repeat(b0, n_a)] = ids_a + sign_a
        row[np.arange(len(ids_b)) + np.repeat(a, n_b)] = ids_b + sign_b
        signs = list(map(self.written.__getitem__, row.tolist()))
        stop = (a + b)[last - 1].tolist()
        texts = ["".join(signs[i:j])[:-1] for i, j in zip([0, *stop], stop)]
        kept = np.where(links > MANY_LINKS, 0, links)
        at = np.repeat(np.arange(len(links)), kept)
        place = np.arange(len(at)) - np.repeat(np.cumsum(kept) - kept, kept)
        codes = (ids_a[a0[at] + place // n_b[at]] << 16 | ids_b[b0[at] + place % n_b[at]]).astype(np.uint32)
        times = np.ones(len(codes), np.int64)
        for group in np.flatnonzero(links > MANY_LINKS)[::-1]:
            one, n = np.unique(ids_a[a0[group] : a[group]], return_counts=True)
            two, m = np.unique(ids_b[b0[group] : b[group]], return_counts=True)
            where = kept[:group].sum()
            codes = np.insert(codes, where, (one[:, None] << 16 | two).astype(np.uint32).ravel())
            times = np.insert(times, where, (n[:, None] * m).ravel())
            kept[group] = len(one) * len(two)
        return words, figures, texts, total(kept), codes, times

    def store(self, words, figures, texts, n_codes, codes, times) -> None:
        self.number.update(zip(words, range(len(self.texts), len(self.texts) + len(words))))
        self.texts += texts
        self.figures.add(figures), self.sizes.add(n_codes), self.codes.add(codes), self.times.add(times)

    def numbered(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Segment numbers of all texts, and how many each has."""
        cut = [self.cut(t) if t else [] for t in texts]
        self.add(list(set().union(*cut).difference(self.number)))
        counts = np.array([len(c) for c in cut], np.int64)
        return np.array(list(map(self.number.__getitem__, itertools.chain.from_iterable(cut))), np.int64), counts

    def links(self, which: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index into ``which``, code, times) of the links of segments; ``begins`` are the sums of ``sizes`` before each."""
        size = self.sizes.rows[which]
        at = np.repeat(np.arange(len(which)), size)
        place = begins[which][at] + np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
        return at, self.codes.rows[place], self.times.rows[place]

    def begins(self) -> np.ndarray:
        return np.cumsum(self.sizes.rows, dtype=np.int64) - self.sizes.rows


def agreeing(aligned: Aligned, which: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whether each text has tokens: segments, and none whose bytes differ."""
    doc = np.repeat(np.arange(len(counts)), counts)
    return (counts > 0) & (np.bincount(doc, aligned.figures.rows[which, 4], len(counts)) == 0)


def run_sums(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of runs of rows of the given lengths, which may be 0."""
    before = np.concatenate([np.zeros((1, rows.shape[1]), np.int64), np.cumsum(rows, axis=0)])
    ends = np.cumsum(sizes)
    return before[ends] - before[ends - sizes]


def added_up(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order and the sums of their counts."""
    if not codes:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    every, number = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(every, kind="stable")
    every = every[order]
    first = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.zeros(0, np.int64)
    return every[first], np.add.reduceat(number[order], first) if len(first) else number


def part_of(codes: np.ndarray, parts: int) -> np.ndarray:
    """All codes of an A id are in one part."""
    return ((codes >> np.uint32(16)).astype(np.int64) * 40503 >> 4) % parts


class Block:
    """What is written of the documents of a block."""

    def __init__(self, aligned: Aligned):
        self.aligned, self.chars = aligned, 0
        if len(aligned.number) > CACHE:
            aligned.clear()
        self.ids, self.figures, self.digests, self.sizes, self.segments, self.times, self.codes, self.counts = [[] for _ in range(8)]

    def add(self, ids: pa.Array, texts: list[str]) -> None:
        aligned = self.aligned
        which, size = aligned.numbered(texts)
        good = agreeing(aligned, which, size)
        doc = np.repeat(np.arange(len(size)), size)
        self.figures.append(run_sums(aligned.figures.rows[which, :4].astype(np.int64) * good[doc][:, None], size))
        edges, numbers = np.append(0, np.cumsum(size)).tolist(), which.tolist()
        for k, ok in enumerate(good.tolist()):
            joined = ";".join(map(aligned.texts.__getitem__, numbers[edges[k] : edges[k + 1]])) if ok else ""
            self.digests.append(hashlib.sha256(joined.encode()).digest() if ok else bytes(32))
        pairs, times = np.unique(doc[good[doc]] << 32 | which[good[doc]], return_counts=True)
        owner, segment = pairs >> 32, pairs & 0xFFFFFFFF
        at, code, _ = aligned.links(segment, aligned.begins())
        held = np.sort((owner[at] << 32) | code.astype(np.int64))
        once = held[np.append(True, held[1:] != held[:-1])[: len(held)]]  # a document counts once for a pair
        one, n = np.unique(once.astype(np.uint32), return_counts=True)
        self.codes.append(one), self.counts.append(n)
        self.sizes.append(np.bincount(owner, minlength=len(size))), self.segments.append(segment), self.times.append(times)
        self.ids.append(ids)
        self.chars += sum(map(len, texts))

    def row(self, number: int, schema: pa.Schema) -> pa.RecordBatch:
        codes, counts = added_up(self.codes, self.counts)
        segments, sizes = np.concatenate(self.segments), np.concatenate(self.sizes)
        used, local = np.unique(segments, return_inverse=True)
        at, code, times = self.aligned.links(used, self.aligned.begins())
        ids = pa.concat_arrays(self.ids)
        columns = {
            "figures": np.concatenate(self.figures).ravel(), "doc_sizes": sizes.astype(np.uint32),
            "doc_segments": np.diff(local, prepend=0).astype(np.int32), "doc_times": np.concatenate(self.times).astype(np.uint32),
            "segment_sizes": np.bincount(at, minlength=len(used)).astype(np.uint32), "segment_codes": np.searchsorted(codes, code).astype(np.uint32),
            "segment_times": times if (times != 1).any() else np.zeros(0, np.int64), "counts": counts.astype(np.int64)}
        data = {name: squeezed(values) for name, values in columns.items()} | {"codes": packed(codes), "digests": b"".join(self.digests)}
        arrays = [pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)]
        arrays += [pa.array([data[name]], pa.binary()) for name in schema.names[2:]]
        return pa.RecordBatch.from_arrays(arrays, schema.names)


def measurer(files: tuple[str, str], block_chars: int, names: list[str]):
    def measure(batches):
        import gc
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        gc.disable()  # nothing here is cyclic, and the collector would go through all that is cached
        aligned, first, number = Aligned(*files), TaskContext.get().partitionId() << 32, 0
        schema = pa.schema([(n, pa.binary()) for n in names])
        block = Block(aligned)
        for batch in batches:
            for ids, texts in runs_of(batch, RUN_BYTES):
                block.add(ids, texts)
                if block.chars >= block_chars:
                    yield block.row(first + number, schema)
                    block, number = Block(aligned), number + 1
        if block.ids:
            yield block.row(first + number, schema)

    return measure


def by_part(parts: int):
    def cut(batches):
        for batch in batches:
            out = []
            for block, codes, counts in zip(*[c.to_pylist() for c in batch.columns]):
                codes, counts = unpacked(codes, np.uint32), opened(counts, np.int64)
                part = part_of(codes, parts)
                for k in np.unique(part).tolist():
                    out.append((k, block, packed(codes[part == k]), squeezed(counts[part == k])))
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.binary())], ["_part", "_block", "codes", "counts"])

    return cut


def summed(rows: pa.Table) -> pa.Table:
    """One row for a part's rows of a group of blocks; it takes the number of the group."""
    codes, counts = added_up([unpacked(c, np.uint32) for c in rows["codes"].to_pylist()], [opened(c, np.int64) for c in rows["counts"].to_pylist()])
    return pa.table([pa.array([rows["_part"][0].as_py()], pa.int64()), pa.array([rows["_group"][0].as_py()], pa.int64()),
                     pa.array([packed(codes)], pa.binary()), pa.array([squeezed(counts)], pa.binary())], names=["_part", "_block", "codes", "counts"])


def returned(rows: pa.Table, totals: pa.Table) -> pa.Table:
    """For each block of a group: the totals of its codes of a part, in their order, and whether each is the highest of its A id."""
    out: list[tuple] = []
    if len(rows):
        codes, counts = unpacked(totals["codes"][0].as_py(), np.uint32), opened(totals["counts"][0].as_py(), np.int64)
        owner = codes >> np.uint32(16)
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        best = counts == np.repeat(np.maximum.reduceat(counts, first), np.diff(np.append(first, len(codes))))
        part = totals["_part"][0].as_py()
        for block, sent in zip(rows["_block"].to_pylist(), rows["codes"].to_pylist()):
            at = np.searchsorted(codes, unpacked(sent, np.uint32))
            out.append((block, part, squeezed(counts[at]), np.packbits(best[at]).tobytes()))
    columns = list(zip(*out)) or [()] * 4
    return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), *[pa.array(c, pa.binary()) for c in columns[2:]]], names=["_block", "_part", "totals", "best"])


def scorer(parts: int):
    def score(block: pa.Table, back: pa.Table) -> pa.Table:
        read = lambda name, dtype: opened(block[name][0].as_py(), dtype)
        codes = unpacked(block["codes"][0].as_py(), np.uint32)
        part, worth = part_of(codes, parts), np.zeros((len(codes), 2), np.int64)
        for k, totals, best in zip(back["_part"].to_pylist(), back["totals"].to_pylist(), back["best"].to_pylist()):
            mine = np.flatnonzero(part == k)
            worth[mine, 0] = np.unpackbits(np.frombuffer(best, np.uint8))[: len(mine)]
            worth[mine, 1] = opened(totals, np.int64)
        times = read("segment_times", np.int64)
        links = worth[read("segment_codes", np.uint32)]
        per_segment = run_sums(links * times[:, None] if len(times) else links, read("segment_sizes", np.uint32).astype(np.int64))
        held = per_segment[np.cumsum(read("doc_segments", np.int32))] * read("doc_times", np.uint32).astype(np.int64)[:, None]
        sums = run_sums(held, read("doc_sizes", np.uint32).astype(np.int64))
        figures = np.concatenate([read("figures", np.int64).reshape(-1, 4), sums], axis=1)
        raw = block["digests"][0].as_py()
        digests = [raw[i : i + 32].hex() if n else "" for i, n in zip(range(0, len(raw), 32), figures[:, 0].tolist())]
        ids = block["ids"].combine_chunks().values
        return pa.table([ids, *[pa.array(c, pa.int64()) for c in figures.T], pa.array(digests, pa.string())],
                        names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return score


def align(docs: DataFrame, file_a: str, file_b: str, doc_id: str = "doc_id", text: str = "text",
          block_chars: int = BLOCK_CHARS, fan: int = FAN, parts: int = PARTS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row per document.

    ``file_a`` and ``file_b`` must be readable on every executor, as the libraries open them there.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("_id"), whole_text(text).alias("_text"))
    id_type = rows.schema["_id"].dataType.simpleString()
    schema = BLOCKS.format(id=id_type)
    names = [column.split(" ")[0] for column in schema.split(", ")]
    blocks = written(rows.mapInArrow(measurer((file_a, file_b), block_chars, names), schema), "blocks")
    number = blocks.count()
    groups = max(1, -(-number // fan))
    sent = blocks.select("_block", "codes", "counts").mapInArrow(by_part(parts), SENT)
    sent = sent.withColumn("_group", F.pmod(F.xxhash64("_block"), F.lit(groups)))
    level, left = sent, groups
    while True:
        level = level.groupBy("_part", "_group").applyInArrow(summed, SENT)
        if left == 1:
            break
        level, left = level.withColumn("_group", F.floor(F.col("_block") / fan)), -(-left // fan)
    spread = level.select("_part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<bigint>")).alias("_group"), "codes", "counts")
    back = sent.groupBy("_part", "_group").cogroup(spread.groupBy("_part", "_group"))
    back = back.applyInArrow(returned, "_block long, _part long, totals binary, best binary")
    return blocks.groupBy("_block").cogroup(back.groupBy("_block")).applyInArrow(scorer(parts), RESULT.format(id=id_type))
