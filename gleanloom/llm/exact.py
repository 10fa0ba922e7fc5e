"""Exact deduplication by skew-safe combining: local copies first, then salted digest groups, then the winners of the salts.

1. Texts are equal when they are identical; nothing is normalised, and null counts as empty.
2. Every row gets the SHA-256 of its text and, as salt, the number of its task modulo ``SALTS``. The aggregate by (digest, salt,
   text) first removes copies inside each task, so that a task sends one row per text whatever the number of copies, and then
   merges the rows of the tasks that share a salt. A second aggregate by (digest, text) combines the at most ``SALTS``
   winners of a text. The text itself is a grouping key of both, so content is compared at every stage: texts that merely share
   a digest stay apart.
3. Groups go back to their rows by digest. Groups that hold more than one of ``HOT`` parts of all rows, at most ``HOT`` in number, are
   broadcast; the others are joined by shuffle, where no key is hot any more. Digests shared by different texts (none, with
   SHA-256) are looked for among the groups, and their rows are joined by digest and text.

Of a group the row of the largest id stays. Edge cases: null ids are smaller than all others, and a group of null ids keeps one
of its rows, with a null ``keep_id``; where rows repeat the largest id exactly one of them stays; an empty table gives no rows. The
other columns are ignored by ``exact_groups`` and left as they are by ``kept_rows``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanloom.llm.common import fresh_name, hot_join, whole_text, written
from gleanloom.scale import broadcast_if_small

SALTS = 256


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def combined(rows: DataFrame, salts: int) -> DataFrame:
    """(_digest, _text, keep_id, group_size) of rows (_id, _digest, _text)."""
    dealt = rows.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    cells = dealt.groupBy("_digest", "_salt", "_text").agg(F.max("_id").alias("_top"), F.count("*").alias("_rows"))
    return cells.groupBy("_digest", "_text").agg(F.max("_top").alias("keep_id"), F.sum("_rows").alias("group_size"))


def grouped(rows: DataFrame, salts: int) -> DataFrame:
    """(_id, _digest, keep_id, group_size), one per row of (_id, _digest, _text)."""
    groups = written(combined(rows, salts).drop("_text"), "groups")
    ids = written(rows.select("_id", "_digest"), "digests")
    shared = groups.groupBy("_digest").count().where("count > 1").select("_digest")
    if shared.limit(1).count() == 0:
        return hot_join(ids, groups, "_digest", "group_size")
    shared = broadcast_if_small(written(shared, "shared"))
    apart = rows.join(shared, "_digest", "left_semi")
    apart = apart.join(combined(apart, salts), ["_digest", "_text"]).select("_id", "_digest", "keep_id", "group_size", "_text")
    alone = hot_join(ids.join(shared, "_digest", "left_anti"), groups.join(shared, "_digest", "left_anti"), "_digest", "group_size")
    return alone.withColumn("_text", F.lit(None).cast("string")).unionByName(apart)


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", salts: int = SALTS,
                 digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one per row; ``digest`` maps a text to binary."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("_id"), whole_text(text).alias("_text"))
    rows = rows.withColumn("_digest", digest(F.col("_text")))
    named = grouped(rows, salts)
    exact = "_text" in named.columns
    keys = ["_digest", "_text"] if exact else ["_digest"]
    place = F.row_number().over(Window.partitionBy(*keys, "_id").orderBy(F.lit(0)))
    named = named.withColumn("kept", F.col("_id").eqNullSafe(F.col("keep_id")) & (place == 1))
    if digest is sha256:
        return named.select(F.col("_id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("_digest")).alias("text_sha256"))
    return named.select(F.col("_id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("_digest")).alias("digest"))


def kept_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; whole rows that repeat stay once."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("_id"), whole_text(text).alias("_text")).withColumn("_digest", sha256(F.col("_text")))
    stay = combined(rows, salts).select(id_text("keep_id"), "_digest")
    key, hashed = fresh_name(docs, "key"), fresh_name(docs, "digest")
    own = docs.withColumns({key: id_text(f"`{doc_id}`"), hashed: sha256(whole_text(text))})
    own = own.join(stay.toDF(key, hashed), [key, hashed], "left_semi")
    return own.dropDuplicates([key, hashed]).drop(key, hashed)


def id_text(column: str) -> Column:
    """An id as text, different from all others where it is null."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("")).alias("_key")
