"""Near-duplicate detection: improved consistent weighted sampling over TF-IDF shingles, banded, then verified.

1. Texts are reduced to their words (runs of letters, marks, digits and underscores, in lower case). Texts of
   equal words are one text from here on: copies are neither counted nor compared again.
2. A shingle is five words. Its weight in a text is ``(1 + ln tf) * idf`` with the smoothed, normalised
   ``idf = 1 + ln((1 + N) / (1 + df)) / ln(1 + N)``. Document frequencies are exact, by the shingle's 64-bit hash: texts are dealt
   into blocks, a block sends its distinct shingles with their counts to parts of the hash range, and a part sends
   back the totals of those that occur in at least two texts. Blocks and parts grow in number, not in size.
3. Improved consistent weighted sampling draws ``BANDS * ROWS`` samples of each text: for shingle weight w,
   ``t = floor(ln w / r + beta)``, ``ln a = ln c - r (t - beta) - r`` with r and c from Gamma(2, 1) and beta uniform; the
   smallest a wins and (shingle, t) is the sample. Two texts agree in a sample with the probability of
   their weighted Jaccard similarity. Variates come from tables of 2^16 entries per sample, looked up by the shingle's hash.
4. Shingles that no other text holds bound what a text can have in common with any: texts whose other shingles weigh too little
   for the threshold are left out before the samples are drawn.
5. Texts that agree in a band meet in a bucket. A pair of a bucket is a candidate if its shared weights allow the threshold, in
   all and summed over ``CELLS`` parts of the hashes (bounds of the exact similarity), and at least ``AGREE`` of its samples agree;
   candidates are compared by the exact weighted Jaccard similarity, and linked texts form components. First every bucket's members meet one leader, with a few bands, then with all of
   them; members that are in the leader's component already are not compared again. What is left are the pairs of a bucket
   that lie in different components: all of them that are candidates are compared. So a large group of near copies costs
   a few comparisons per text, and no link is lost.

A pair at similarity 0.8 is missed with probability 3e-4 (12 bands of 3 samples, 19 of 36 samples), at 0.9 with less than 1e-6.

Edge cases: null text is empty; texts without words are linked to equal texts only; a text of fewer than five words
has one shingle, of all its words; null and repeated ids are rows like others; an empty table gives no rows;
the class of rows whose ids are all null is null. Other input columns are left alone.
"""

from __future__ import annotations

import functools
import operator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from gleanloom.llm.common import fresh_name, opened, packed, squeezed, unpacked, whole_text, written

SHINGLE = 5
THRESHOLD = 0.8
BANDS = 12
ROWS = 3
AGREE = 19
FIRST_BANDS = 3
MOST_ROUNDS = 4
VARIATES = 1 << 16
CHUNK = 1 << 17
RUN_CHARS = 1 << 20
BLOCK_CHARS = 4 << 20
PART_CHARS = 12 << 20
GAPS = r"[^\p{L}\p{M}\p{N}_]+"
#: Parts of the hashes for which a text's shared weight is kept.
CELLS = 128
#: Least neighbours of at most so many bytes are broadcast, a node and its neighbour taking so many.
BROADCAST_BYTES = 8 << 20
NODE_BYTES = 64
#: Bounds are looser than the threshold by so much, for the rounding of sums.
SLACK = 2e-6
EMPTY = pa.schema([("_key", pa.binary()), ("_words", pa.string()), ("_df", pa.binary()), ("_weight", pa.float64()), ("_shared", pa.float64()),
                   ("_cells", pa.list_(pa.float32())), ("_bands", pa.list_(pa.int64())), ("_samples", pa.list_(pa.int16()))])

_ODD = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hashes of words; forgets all when it has grown large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * _ODD
    return values ^ (values >> np.uint64(29))


def shingles(text: str, cache: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of a normalised text's shingles."""
    words = text.split(" ") if text else []
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashes = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    size = min(SHINGLE, len(words))
    total = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        total = mixed(total + hashes[k : len(words) - size + 1 + k])
    return np.unique(total, return_counts=True)


def block_shingles(words: pa.ChunkedArray, cache: WordHashes):
    """The same for many texts, in their order: words are told apart by Arrow, and shingles made for a run of texts at once."""
    for run in words.cast(pa.large_string()).chunks:
        size = pc.utf8_length(run).to_numpy(zero_copy_only=False).astype(np.int64)
        cuts = np.flatnonzero(np.diff(np.cumsum(size) // RUN_CHARS, prepend=-1))
        for i, j in zip(cuts, [*cuts[1:], len(run)]):
            lists = pc.split_pattern(run[int(i) : int(j)], " ")
            offsets = lists.offsets.to_numpy().astype(np.int64)
            offsets -= offsets[0]
            coded = lists.flatten().dictionary_encode()
            known = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
            hashes = np.fromiter(map(cache.__getitem__, known), np.uint64, len(known))[coded.indices.to_numpy()]
            total = np.full(max(0, len(hashes) - SHINGLE + 1), SHINGLE, np.uint64)
            for k in range(SHINGLE):
                total = mixed(total + hashes[k : len(hashes) - SHINGLE + 1 + k])
            for n, (start, end) in enumerate(zip(offsets.tolist(), offsets[1:].tolist())):
                if end - start < SHINGLE:
                    yield shingles(run[int(i) + n].as_py(), cache)
                else:
                    yield np.unique(total[start : end - SHINGLE + 1], return_counts=True)


def weights(counts: np.ndarray, frequencies: np.ndarray, texts: int) -> np.ndarray:
    return (1 + np.log(counts)) * idf_table(frequencies, texts).astype(np.float32)


def idf_table(frequencies: np.ndarray, texts: int) -> np.ndarray:
    top = max(texts, 1)
    return 1 + np.log((1 + top) / (1 + np.minimum(frequencies, top))) / np.log(1 + top)


class Sampler:
    """The samples of many texts at once."""

    def __init__(self, samples: int = BANDS * ROWS, seed: int = 7):
        rng = np.random.default_rng(seed)
        shape = (samples, VARIATES)
        self.r = rng.gamma(2.0, 1.0, shape).astype(np.float32)
        self.log_c = np.log(rng.gamma(2.0, 1.0, shape)).astype(np.float32)
        self.beta = rng.random(shape, dtype=np.float32)
        self.odd = rng.integers(1 << 62, 1 << 63, samples, dtype=np.uint64) | np.uint64(1)

    def __call__(self, hashes: np.ndarray, weight: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(texts, samples) for the texts that begin at ``starts``; none of them is empty."""
        log_w, low = np.log(weight).astype(np.float32), hashes.astype(np.uint32)
        out = np.empty((len(starts), len(self.odd)), np.int64)
        halves = np.empty((len(hashes), 2), np.dtype("<u4"))
        both = halves.view("<i8").reshape(-1)
        for k, odd in enumerate(self.odd):
            at = ((hashes * odd) >> np.uint64(48)).view(np.int64)
            r, beta = self.r[k].take(at), self.beta[k].take(at)
            t = np.floor(log_w / r + beta)
            log_a = self.log_c[k].take(at) - r * (t - beta + 1)
            # positive floats sort like their bits; below them the sample itself, so that one minimum finds both
            halves[:, 1] = np.maximum(log_a + np.float32(64), np.float32(0)).view(np.uint32)
            halves[:, 0] = low ^ (t.astype(np.int32).view(np.uint32) * np.uint32(0x9E3779B1))
            out[:, k] = np.minimum.reduceat(both, starts) & 0xFFFFFFFF
        return out


def bands_of(samples: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit hash per text and band."""
    out = np.empty((len(samples), bands), np.uint64)
    for band in range(bands):
        value = np.full(len(samples), band + 1, np.uint64)
        for k in range(rows):
            value = mixed(value + samples[:, band * rows + k].astype(np.uint64))
        out[:, band] = mixed(value)
    return out.view(np.int64)


def lists(rows: np.ndarray) -> pa.Array:
    offsets = pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(rows).reshape(-1)))


def sender(bits: int):
    def send(block: pa.Table) -> pa.Table:
        cache = WordHashes()
        hashes, counts = np.unique(np.concatenate([h for h, _ in block_shingles(block["_words"], cache)]), return_counts=True)
        part = (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
        parts, at = np.unique(part, return_index=True)
        ends = [*at[1:], len(hashes)]
        number = block["_block"][0].as_py()
        sent = pa.array([packed(hashes[i:j]) for i, j in zip(at, ends)], pa.binary())
        shared = pa.array([squeezed(counts[i:j].astype(np.int32)) for i, j in zip(at, ends)], pa.binary())
        return pa.table({"_part": pa.array(parts, pa.int64()), "_block": pa.array([number] * len(parts), pa.int64()), "hashes": sent, "counts": shared})

    return send


def add_up(part: pa.Table) -> pa.Table:
    """For each block its hashes that occur in two texts or more, with the number of those."""
    sent = [unpacked(h, np.uint64) for h in part["hashes"].to_pylist()]
    counts = np.concatenate([opened(c, np.int32) for c in part["counts"].to_pylist()])
    _, place = np.unique(np.concatenate(sent), return_inverse=True)
    total, start, out = np.bincount(place, counts).astype(np.int64)[place], 0, []
    for block, hashes in zip(part["_block"].to_pylist(), sent):
        mine = total[start : start + len(hashes)]
        start += len(hashes)
        if (mine > 1).any():
            out.append((block, packed(hashes[mine > 1]), squeezed(mine[mine > 1])))
    return pa.table({"_block": pa.array([o[0] for o in out], pa.int64()), "hashes": pa.array([o[1] for o in out], pa.binary()), "totals": pa.array([o[2] for o in out], pa.binary())})


def signer(number: int, threshold: float):
    kept: list[Sampler] = []

    def sign(block: pa.Table, repeated: pa.Table) -> pa.Table:
        kept or kept.append(Sampler())
        cache, sampler, out = WordHashes(), kept[0], []
        known = np.concatenate([np.zeros(0, np.uint64), *[unpacked(h, np.uint64) for h in repeated["hashes"].to_pylist()]])
        totals = np.concatenate([np.zeros(0, np.int64), *[opened(t, np.int64) for t in repeated["totals"].to_pylist()]])
        order = np.argsort(known)
        known, totals = np.append(known[order], np.uint64(2**64 - 1)), np.append(totals[order], 1)

        def rows(places, parts):
            hashes, counts, frequency, weight = (np.concatenate(c) for c in zip(*parts))
            starts = np.cumsum([0] + [len(p[0]) for p in parts[:-1]])
            samples = sampler(hashes, weight, starts)
            total, shared = np.add.reduceat(weight, starts), np.add.reduceat(np.where(frequency > 1, weight, 0), starts)
            stored = pa.array([squeezed(f.astype(np.int64)) for _, _, f, _ in parts], pa.binary())
            own = block.select(["_key", "_words"]).take(pa.array(places, pa.int64())).combine_chunks()
            cell = np.repeat(np.arange(len(parts)), np.diff(np.append(starts, len(hashes)))) * CELLS + (hashes % np.uint64(CELLS)).astype(np.int64)
            cells = np.bincount(cell, np.where(frequency > 1, weight, 0), len(parts) * CELLS).reshape(-1, CELLS).astype(np.float32)
            columns = [own["_key"].combine_chunks(), own["_words"].combine_chunks(), stored, pa.array(total, pa.float64()), pa.array(shared, pa.float64()), lists(cells),
                       lists(bands_of(samples)), lists((samples & 0xFFFF).astype(np.uint16).view(np.int16))]
            out.append(pa.RecordBatch.from_arrays(columns, EMPTY.names))

        places, parts, size = [], [], 0
        for place, (hashes, counts) in enumerate(block_shingles(block["_words"], cache)):
            at = np.searchsorted(known, hashes)
            frequency = np.where(known[at] == hashes, totals[at], 1)
            weight = weights(counts, frequency, number)
            if weight[frequency > 1].sum() < (threshold - SLACK) * weight.sum():
                continue
            places.append(place), parts.append((hashes, counts, frequency, weight))
            size += len(hashes)
            if size >= CHUNK:
                rows(places, parts)
                places, parts, size = [], [], 0
        if places:
            rows(places, parts)
        return pa.Table.from_batches(out, None if out else EMPTY)

    return sign


def signed(texts: DataFrame, number: int, block_chars: int = BLOCK_CHARS, part_chars: int = PART_CHARS, threshold: float = 0.0) -> DataFrame:
    """(_key, _words, _df, _weight, _shared, _cells, _bands, _samples) of distinct texts with words, among ``number`` texts; ``_df`` in the order
    of the shingles' hashes. ``_shared`` is the weight of the shingles that another text holds too; texts of which it is less
    than ``threshold`` of all their weight are near no text and are left out. ``_cells`` is this weight by parts of the hashes.
    """
    chars = texts.agg(F.coalesce(F.sum(F.length("_words")), F.lit(0))).first()[0]
    bits = max(0, (chars // part_chars)).bit_length()
    dealt = texts.select("_key", "_words", F.pmod(F.xxhash64("_key"), F.lit(chars // block_chars + 1)).alias("_block"))
    sent = dealt.groupBy("_block").applyInArrow(sender(bits), "_part long, _block long, hashes binary, counts binary")
    repeated = sent.groupBy("_part").applyInArrow(add_up, "_block long, hashes binary, totals binary")
    return dealt.groupBy("_block").cogroup(repeated.groupBy("_block")).applyInArrow(
        signer(number, threshold), "_key binary, _words string, _df binary, _weight double, _shared double, _cells array<float>, _bands array<long>, _samples array<smallint>")


def verifier(number: int, threshold: float):
    def verify(batches):
        cache, last, last_text = WordHashes(), None, None

        def parsed(text, frequencies):
            hashes, counts = shingles(text, cache)
            weight = weights(counts, opened(frequencies, np.int64), number).astype(np.float64)
            return hashes, weight, weight.sum()

        for batch in batches:
            a, b, similarity = [], [], []
            for one, other, text, df, other_text, other_df in zip(*[c.to_pylist() for c in batch.columns]):
                if text != last_text:
                    last, last_text = parsed(text, df), text
                hashes, weight, total = parsed(other_text, other_df)
                _, i, j = np.intersect1d(last[0], hashes, assume_unique=True, return_indices=True)
                shared = np.minimum(last[1][i], weight[j]).sum()
                jaccard = shared / (last[2] + total - shared)
                if jaccard >= threshold - 1e-6:
                    a.append(one), b.append(other), similarity.append(float(jaccard))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(similarity, pa.float64())], ["_a", "_b", "similarity"])

    return verify


def normalised(docs: DataFrame, text: str, words: str = "_words", key: str = "_key") -> DataFrame:
    """Rows with their words and a key: equal keys are equal words, or equal texts where there are no words."""
    own = F.trim(F.regexp_replace(F.lower(whole_text(text)), F.lit(GAPS), F.lit(" ")))
    out = docs.withColumn(words, own)
    raw = F.when(F.col(words) == "", F.concat(F.lit("\n"), whole_text(text))).otherwise(F.col(words))
    return out.withColumn(key, F.unhex(F.md5(raw.cast("binary"))))


def components(links: DataFrame) -> DataFrame:
    """(_key, _component) of all linked keys; the least key names a component.

    Alternating large-star and small-star steps: the number of rounds grows with the logarithm of a chain's length,
    and a node with many links is handled by an aggregate and a join, never as one group.
    """
    def counted(rows: DataFrame) -> tuple[DataFrame, int]:
        seen = Observation()
        return written(rows.distinct().observe(seen, F.count(F.lit(1)).alias("n")), "edges"), seen.get["n"]

    def met(rows: DataFrame, least: DataFrame, bound: int) -> DataFrame:
        return rows.join(F.broadcast(least) if bound * NODE_BYTES <= BROADCAST_BYTES else least, "u")

    edges, n = counted(links.select(F.greatest("_a", "_b").alias("u"), F.least("_a", "_b").alias("v")).where("u <> v"))
    while n:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        edges, n = counted(met(both, least, 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"))
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        down = met(edges, least, n)
        edges, n = counted(down.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v")))
        # done when each node leads to one other, which leads nowhere
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("led")).unionByName(
            edges.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("led")))
        if ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("led").alias("led")).where("out > 1 OR (out > 0 AND led > 0)").isEmpty():
            break
    nodes = edges.select(F.col("u").alias("_key"), F.col("v").alias("_component"))
    return nodes.unionByName(edges.select(F.col("v").alias("_key"), F.col("v").alias("_component")).distinct())


def compared(pairs: DataFrame, texts: DataFrame, number: int, threshold: float) -> DataFrame:
    """(_a, _b, similarity) of the pairs that reach the threshold. Both joins can be split where a text has many pairs."""
    second = pairs.join(texts.toDF("_b", "_other", "_other_df"), "_b")
    both = second.join(texts.toDF("_a", "_words", "_df"), "_a").select("_a", "_b", "_words", "_df", "_other", "_other_df")
    return both.mapInArrow(verifier(number, threshold), "_a binary, _b binary, similarity double")


def agreeing(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)


def earlier_band(a: Column, b: Column, band: Column) -> Column:
    """Whether two texts agree in all samples of a band before this one, so that they have met there."""
    bands = F.when(band > 0, F.sequence(F.lit(0), band - 1)).otherwise(F.array().cast("array<int>"))
    same = lambda n, k: F.get(a, n * ROWS + k) == F.get(b, n * ROWS + k)
    return F.exists(bands, lambda n: functools.reduce(operator.and_, [same(n, k) for k in range(ROWS)]))


def candidate(a: str, b: str, threshold: float) -> Column:
    """Whether two texts of a bucket can be near, by their weights and samples.

    They have no more in common than either of them shares with other texts, as a whole and in each part of the hashes.
    """
    fits = lambda common: common >= (F.col(f"{a}._weight") + F.col(f"{b}._weight") - common) * (threshold - SLACK)
    cells = F.aggregate(F.zip_with(f"{a}._cells", f"{b}._cells", lambda x, y: F.least(x, y)), F.lit(0.0), lambda n, x: n + x)
    agree = agreeing(F.col(f"{a}._samples"), F.col(f"{b}._samples")) >= AGREE
    return F.when(fits(F.least(f"{a}._shared", f"{b}._shared")) & agree, fits(cells)).otherwise(False)


def with_components(members: DataFrame, groups: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Members of the buckets that hold several components, with ``_own``; and (bucket, size, _main: its largest component, its size)."""
    named = members.drop("_own")
    if groups is None:
        named = named.withColumn("_own", F.col("_key"))
    else:
        named = named.join(groups, "_key", "left").withColumn("_own", F.coalesce("_component", "_key")).drop("_component")
    own = named.groupBy("_bucket", "_own").agg(F.count("*").alias("n"))
    main = own.groupBy("_bucket").agg(F.sum("n").alias("_size"), F.max(F.struct("n", F.col("_own").alias("own"))).alias("_top"), F.count("*").alias("_parts"))
    main = written(main.where("_parts > 1").select("_bucket", "_size", F.col("_top.own").alias("_main"), F.col("_top.n").alias("_main_size")), "main")
    return written(named.join(main.select("_bucket"), "_bucket"), "members"), main


def linked(texts: DataFrame, signatures: DataFrame, number: int, threshold: float = THRESHOLD) -> DataFrame:
    """(_key, _component) of all texts that have a near-duplicate.

    Members of buckets are narrow rows; weights and samples are fetched for the pairs of a member and its leader, and
    carried only into the last join, which they thin out.
    """
    bands = signatures.select("_key", F.posexplode("_bands").alias("_band", "_bucket"))
    shared = bands.groupBy("_bucket").agg(F.count("*").alias("_n")).where("_n > 1").select("_bucket")
    members, main = with_components(written(bands.join(shared, "_bucket"), "members"), None)
    facts = signatures.join(members.select("_key").distinct(), "_key", "left_semi")
    facts = written(facts.select("_key", F.struct("_weight", "_shared", "_cells", "_samples").alias("_facts")), "facts")
    groups, before = None, None

    def compare(pairs: DataFrame) -> DataFrame:
        """Components of the links among the pairs and of those before, which the components stand for."""
        links = compared(written(pairs, "pairs"), texts, number, threshold).select("_a", "_b")
        every = links if groups is None else links.unionByName(groups.select(F.col("_key").alias("_a"), F.col("_component").alias("_b")))
        return written(components(every), "groups")

    for step in range(MOST_ROUNDS):
        use = members.where(F.col("_band") < FIRST_BANDS) if step == 0 else members
        led = use if step == 0 else use.join(main.select("_bucket", "_main"), "_bucket").where("_own = _main")
        rank = F.lit(0) if step == 0 else F.xxhash64(F.lit(step), "_key")
        leaders = led.groupBy("_bucket").agg(F.min(F.struct(rank.alias("_rank"), "_key", "_own")).alias("_leader"))
        met = use.join(leaders, "_bucket").where(F.col("_own") != F.col("_leader._own"))
        pairs = met.select(F.least("_key", "_leader._key").alias("_a"), F.greatest("_key", "_leader._key").alias("_b")).distinct()
        pairs = pairs.join(facts.toDF("_b", "_fb"), "_b").join(facts.toDF("_a", "_fa"), "_a").where(candidate("_fa", "_fb", threshold))
        groups = compare(pairs.select("_a", "_b"))
        members, main = with_components(members, groups)
        rest = main.agg(F.sum((F.col("_size") - F.col("_main_size")) * F.col("_size")).alias("pairs"), F.sum("_size").alias("rows")).first()
        left = rest["pairs"] or 0
        if step and (left <= 8 * (rest["rows"] or 0) or left > 0.9 * before):
            break
        before = left
    side = members.join(facts, "_key").select("_bucket", "_band", F.struct("_key", "_own", "_facts").alias("_member"))
    others = side.join(main.select("_bucket", "_main"), "_bucket").where("_member._own <> _main")
    others = others.select("_bucket", "_main", F.col("_member").alias("_other"))
    once = (F.col("_member._own") == F.col("_main")) | (F.col("_other._key") < F.col("_member._key"))
    first = ~earlier_band(F.col("_other._facts._samples"), F.col("_member._facts._samples"), F.col("_band"))
    apart = F.col("_other._own") != F.col("_member._own")
    met = others.join(side, "_bucket").where(once & apart & candidate("_other._facts", "_member._facts", threshold) & first)
    pairs = met.select(F.least("_other._key", "_member._key").alias("_a"), F.greatest("_other._key", "_member._key").alias("_b")).distinct()
    return compare(pairs)


def named_keys(rows: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, _key, _class) of all rows; ``_class`` is the least key of the row's class."""
    rows = written(rows.select("doc_id", "_key", "_words"), "words", compression="zstd")
    texts = written(rows.select("_key", "_words").dropDuplicates(["_key"]), "texts", compression="zstd")
    number = texts.count()
    both = written(signed(texts.where("_words <> ''"), number, threshold=threshold), "signatures", compression="zstd")
    groups = linked(both.select("_key", "_words", "_df"), both.drop("_words", "_df"), number, threshold)
    return rows.select("doc_id", "_key").join(groups, "_key", "left").select("doc_id", "_key", F.coalesce("_component", "_key").alias("_class"))


def duplicate_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, class_rows): one row per document; the class is named by its least id."""
    rows = normalised(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), "text")
    named = named_keys(rows, threshold)
    classes = named.groupBy("_class").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_rows"))
    return named.select("doc_id", "_class").join(classes, "_class").select("doc_id", "class_id", "class_rows")


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class, that of the least id, with its columns as they are.

    The rows are fetched by id and key, so that a large group of copies is not one task's work.
    """
    rows = normalised(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), "text")
    named = named_keys(rows, threshold)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_key")).alias("_first")
    same_id, same_key, words = (fresh_name(docs, name) for name in ("id", "key", "words"))
    kept = named.groupBy("_class").agg(first).select(id_text(F.col("_first.doc_id")).alias(same_id), F.col("_first._key").alias(same_key))
    own = normalised(docs, text, words, same_key).withColumn(same_id, id_text(F.col(f"`{doc_id}`"))).drop(words)
    return own.join(kept, [same_id, same_key]).dropDuplicates([same_id, same_key]).select(*[f"`{c}`" for c in docs.columns])


def id_text(column):
    return F.coalesce(column.cast("string"), F.lit(""))
