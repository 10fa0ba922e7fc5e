"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over neighbouring tokens: the hash of the tokens at its marked places, the others ignored, so
that a substituted token at an ignored place does not hide a copied passage. Every position of every document
is hashed under every mask and met with the hashes of the benchmark items. A hit fixes a diagonal (document position
minus item position); along it the tokens of document and item are compared one by one, and the best stretch counts:
a match gains 1, a substitution costs 2. An item is leaked when its best stretch reaches ``FLOOR`` or ``PART`` of
its tokens, whichever is less.

Tokens are runs of letters, marks, digits and underscores, in lower case. Documents are identified by their
content (the MD5 of the text), so that copies are judged once and repeated or null ids do no harm.

Edge cases: null and empty texts hold no leak; an item with fewer tokens than the shortest mask spans is too short
to be evidence and matches nothing; items of equal text are reported each; an empty benchmark leaves all documents
clean; other input columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanloom.llm.common import whole_text
from gleanloom.scale import broadcast_if_small, cut_lineage, explode_once, measured_bytes

#: Places of the tokens that count: 6 of 8, 6 of 9 and 6 of 10.
MASKS = ((0, 1, 2, 4, 5, 7), (0, 1, 4, 5, 7, 8), (0, 2, 3, 6, 8, 9))
FLOOR = 20
PART = 0.6
#: A benchmark is broadcast while its measured seeds and tokens stay under this; beyond it they are joined by shuffle.
BROADCAST_BYTES = 64 << 20
TOKEN = r"[\p{L}\p{M}\p{N}_]+"


def tokens(text: Column) -> Column:
    """Hashes of the text's tokens, in order."""
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), lambda word: F.xxhash64(word))


def seed_count(size: Column, mask) -> Column:
    return F.greatest(F.lit(0), size - F.lit(mask[-1]))


def seeds(hashes: Column, size: Column, mask, number: int) -> Column:
    """The mask's hash at every position at which it fits."""
    at = F.when(seed_count(size, mask) > 0, F.sequence(F.lit(0), seed_count(size, mask) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.lit(number), *[F.get(hashes, i + F.lit(k)) for k in mask]))


def seed_rows(df: DataFrame) -> DataFrame:
    """(_key, _n, _at, _seed): one row per position and mask of rows with ``_key``, ``_tokens`` and ``_n``.

    The seeds are a column of their own before they are exploded, so that the explosion runs in generated code.
    """
    every = F.concat(*[seeds(F.col("_tokens"), F.col("_n"), mask, k) for k, mask in enumerate(MASKS)])
    return explode_once(df.select("_key", "_n", every.alias("_seeds")), F.col("_seeds"), "_at", "_seed", ["_key", "_n"])


def place(at: Column, size: Column) -> Column:
    """Position in the text of the seed at place ``at`` of the concatenated masks."""
    out, before = at, F.lit(0)
    for mask in MASKS[:-1]:
        before = before + seed_count(size, mask)
        out = F.when(at >= before, at - before).otherwise(out)
    return out


def best_stretch(document: Column, item: Column, diagonal: Column) -> Column:
    """Highest score of a stretch along the diagonal: matches minus twice the substitutions."""
    low = F.greatest(F.lit(0), -diagonal)
    length = F.least(F.size(item), F.size(document) - diagonal) - low
    same = F.zip_with(F.slice(document, diagonal + low + 1, length), F.slice(item, low + 1, length), lambda a, b: F.when(a == b, 1).otherwise(-2))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))

    def step(state: Column, gain: Column) -> Column:
        now = F.greatest(F.lit(0), state["now"] + gain)
        return F.struct(now.alias("now"), F.greatest(state["best"], now).alias("best"))

    return F.aggregate(same, start, step, lambda state: state["best"])


def keyed(df: DataFrame, text: str) -> DataFrame:
    return df.select(F.unhex(F.md5(whole_text(text).cast("binary"))).alias("_key"), whole_text(text).alias("_text"))


def tokenized(df: DataFrame) -> DataFrame:
    out = df.select("_key", tokens(F.col("_text")).alias("_tokens"))
    return out.withColumn("_n", F.size("_tokens"))


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text",
          broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(_key, _item, matched, item_tokens): the leaked items of each distinct text, both by the MD5 of their text.

    Seeds of a benchmark of bounded size are broadcast, those of a larger one meet the documents' seeds in a shuffle join. Only
    distinct diagonals of hits leave that pass, gathered per text and item (at most one per token of both). While they are of
    bounded size they are broadcast to a second pass over the texts, which shuffles none; beyond it the texts of hits are
    fetched by key, each distinct text once.
    """
    items = cut_lineage(tokenized(keyed(benchmark, item_text).distinct()).where(F.col("_n") > MASKS[0][-1]))
    wanted = cut_lineage(seed_rows(items).select(
        F.col("_key").alias("_item"), place(F.col("_at"), F.col("_n")).alias("_q"), "_seed").distinct())
    items = items.select(F.col("_key").alias("_item"), F.col("_tokens").alias("_words"))
    diagonal = (place(F.col("_at"), F.col("_n")) - F.col("_q")).alias("_diagonal")
    small = measured_bytes(wanted) + measured_bytes(items) <= broadcast_bytes
    met = seed_rows(tokenized(keyed(docs, text))).join(F.broadcast(wanted) if small else wanted, "_seed")
    hits = met.select("_key", "_item", diagonal).distinct().groupBy("_key", "_item").agg(F.collect_list("_diagonal").alias("_diagonals"))
    hits, texts = cut_lineage(hits), keyed(docs, text)
    if measured_bytes(hits) <= broadcast_bytes:
        hits = texts.join(F.broadcast(hits), "_key")
    else:
        texts = texts.join(hits.select("_key").distinct(), "_key", "left_semi").dropDuplicates(["_key"])
        hits = texts.join(hits, "_key")
    hits = hits.withColumn("_tokens", tokens(F.col("_text"))).join(F.broadcast(items) if small else items, "_item")
    score = F.array_max(F.transform("_diagonals", lambda d: best_stretch(F.col("_tokens"), F.col("_words"), d)))
    scored = hits.select("_key", "_item", score.alias("_score"), F.size("_words").alias("item_tokens"))
    best = scored.groupBy("_key", "_item").agg(F.max("_score").alias("matched"), F.max("item_tokens").alias("item_tokens"))
    return best.where(F.col("matched") >= F.least(F.lit(FLOOR), F.ceil(F.col("item_tokens") * F.lit(PART))))


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(doc_id, contaminated, n_items, matched): for each row how many distinct item texts it leaks and the best match."""
    found = cut_lineage(leaks(docs, benchmark, text, **options).groupBy("_key").agg(
        F.count("*").alias("n_items"), F.max("matched").cast("long").alias("matched")))
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.unhex(F.md5(whole_text(text).cast("binary"))).alias("_key"))
    joined = rows.join(broadcast_if_small(found), "_key", "left")
    return joined.select("doc_id", F.col("n_items").isNotNull().alias("contaminated"),
                         F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("matched", F.lit(0)).alias("matched"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows whose text leaks no item, with their columns as they are."""
    found = cut_lineage(leaks(docs, benchmark, text, **options).select(F.col("_key").alias("_leak")).distinct())
    key = F.unhex(F.md5(whole_text(text).cast("binary")))
    return docs.join(broadcast_if_small(found), key == F.col("_leak"), "left_anti")
