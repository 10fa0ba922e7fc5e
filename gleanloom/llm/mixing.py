"""Mixing sources to target weights by a time-varying curriculum.

Each source has a target of words (``source_targets``) and a schedule: the relative weight of the source over
training time 0 to 1, straight between knots. The integral of the schedule, scaled to the target, is the
source's cumulative token demand. The source's documents form a stream in a fixed pseudo-random order, repeated
until the target is met; a document that begins after ``c`` words of the stream is trained at the time when
the demand reaches ``c``: the integral inverted. Sorting all documents by that position gives the curriculum.

Running totals within a source are summed in two levels: a source's rows are dealt by hash into about as many
buckets as a bucket has rows, so that a source with a third of all rows is neither one task's rows nor one
task's buckets.

Edge cases: null text has size 0; rows without words are taken 0 words and get no position; null sources form
one source, which comes last; repeated rows count as rows of their own; an empty table gives no rows. Input columns
named like a result column give way to it. The document at the target's boundary counts with the words up
to it, so that a source's taken words meet its target to less than one word.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanloom.llm.common import WORD, hash60, put, whole_text
from gleanloom.scale import broadcast_if_small, cut_lineage

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
CAP = 2.0
#: Schedules by turns of the sources: knots (time, relative weight). Early, even and late sources.
SCHEDULES = (
    ((0.0, 2.0), (0.5, 1.0), (1.0, 0.25)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.25), (0.5, 1.0), (1.0, 2.0)),
)


def turns(index: Column, values: list[Column]) -> Column:
    """``values[index mod length]``."""
    return F.element_at(F.array(*values), (F.pmod(index, F.lit(len(values))) + 1).cast("int"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(_source, source_rows, source_size, turn, target) from rows (_source, _size).

    All sources share ``share`` times all sizes by weight. A target stops at ``cap`` times the source's size and
    its excess is shared again by weight: the level at which the sum is met, found by one pass over
    the sources ordered by the level at which each is full. Only one row per source goes through the windows.
    """
    totals = sizes.groupBy("_source").agg(F.count("*").alias("source_rows"), F.sum("_size").alias("source_size"))
    by_name = Window.orderBy(F.col("_source").asc_nulls_last())
    totals = totals.withColumn("turn", F.row_number().over(by_name) - 1)
    totals = totals.withColumn("_weight", turns(F.col("turn"), [F.lit(float(w)) for w in weights]))
    totals = totals.withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
    by_level = Window.orderBy(F.col("_cap") / F.col("_weight"), "turn")
    before, on = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(0))
    left = F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    totals = totals.withColumn("_level", left / F.sum("_weight").over(on))
    totals = totals.withColumn("_full", F.col("_cap") < F.col("_level") * F.col("_weight"))
    first_open = F.min(F.when(~F.col("_full"), F.struct(F.col("_cap") / F.col("_weight"), "turn", "_level"))).over(every)
    shared = F.least(first_open["_level"] * F.col("_weight"), F.col("_cap"))
    target = F.when(F.col("_full"), F.col("_cap")).otherwise(shared)
    return totals.select("_source", "source_rows", "source_size", "turn", target.alias("target"))


def segments(knots) -> list[tuple[float, float, float, float, float, float]]:
    """Per straight piece of a schedule: start, length, weight at start, slope, integral before it, integral of it; the whole is 1."""
    total = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))
    done, out = 0.0, []
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        area = (t1 - t0) * (w0 + w1) / 2 / total
        out.append((t0, t1 - t0, w0 / total, (w1 - w0) / (t1 - t0) / total, done, area))
        done += area
    return out


def inverted(fraction: Column, knots) -> Column:
    """The time at which the schedule's integral, scaled to 1, reaches ``fraction``."""
    out = None
    for t0, length, w0, slope, done, area in reversed(segments(knots)):
        rest = fraction - F.lit(done)
        if abs(slope) < 1e-12:
            t = F.lit(t0) + rest / F.lit(w0)
        else:
            root = F.sqrt(F.greatest(F.lit(0.0), F.lit(w0 * w0) + F.lit(2 * slope) * rest))
            t = F.lit(t0) + (root - F.lit(w0)) / F.lit(slope)
        out = t if out is None else F.when(fraction < F.lit(done + area), t).otherwise(out)
    return out


def mix(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS,
        share: float = SHARE, cap: float = CAP, schedules=SCHEDULES) -> DataFrame:
    """Every row with ``size``, ``source_size``, ``target``, ``taken`` words, ``copies`` and the first ``position``.

    ``copies`` is the number of times the mix places the row (the last may be cut by the target's boundary).
    """
    rows = df.withColumns({
        "_source": F.col(f"`{source}`").cast("string"),
        "_size": F.regexp_count(whole_text(text), F.lit(WORD)).cast("long"),
        "_order": hash60(F.col(f"`{doc_id}`")),
        "_id": F.col(f"`{doc_id}`"),
    })
    small = cut_lineage(rows.select("_source", "_size", "_order"))
    targets = cut_lineage(source_targets(small, weights, share, cap))
    most = targets.agg(F.max("source_rows")).first()[0] or 1
    width = (1 << 60) // max(1, math.isqrt(most)) + 1
    bucket = F.floor(F.col("_order") / F.lit(width)).cast("long")
    small = small.withColumn("_bucket", bucket).groupBy("_source", "_bucket").agg(F.sum("_size").alias("_words"))
    ahead = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = small.withColumn("_ahead", F.coalesce(F.sum("_words").over(ahead), F.lit(0))).drop("_words")
    known = buckets.alias("b").join(
        broadcast_if_small(targets).alias("t"), F.col("b._source").eqNullSafe(F.col("t._source"))
    ).select("b.*", "t.source_size", "t.turn", "t.target")
    known = known.toDF("_source", "_bucket", "_ahead", "_source_size", "_turn", "_target")
    keys = [F.coalesce(F.concat(F.lit("s"), "_source"), F.lit("")).alias("_key"), "_bucket"]
    known = known.select(*keys, "_ahead", "_source_size", "_turn", "_target")
    rows = rows.withColumn("_bucket", bucket).withColumn("_key", keys[0])
    within = Window.partitionBy("_key", "_bucket").orderBy("_order", "_id", "_size")
    rows = rows.withColumn("_before", F.sum("_size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size"))
    rows = rows.join(known, ["_key", "_bucket"], "left")
    start = F.col("_ahead") + F.col("_before")
    words = F.floor(F.col("_target") + F.lit(1e-6)).cast("long")
    passes = F.when(F.col("_source_size") > 0, F.floor(words / F.col("_source_size")).cast("long")).otherwise(F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("_size"), words - passes * F.col("_source_size") - start))
    rows = rows.withColumns({"_start": start, "_passes": passes, "_part": part})
    copies = F.when(F.col("_size") == 0, F.lit(0)).otherwise(F.col("_passes") + (F.col("_part") > 0).cast("long"))
    position = F.when(copies > 0, position_of(F.col("_start"), F.col("_target"), F.col("_turn"), schedules))
    out = put(rows, {
        "size": F.col("_size"), "source_size": F.col("_source_size"), "target": F.col("_target"),
        "taken": F.col("_passes") * F.col("_size") + F.col("_part"), "copies": copies.cast("long"), "position": position,
    })
    return out.drop("_key", "_bucket", "_source", "_size", "_order", "_id", "_before", "_ahead", "_source_size", "_target", "_passes", "_part")


def position_of(start: Column, target: Column, turn: Column, schedules=SCHEDULES) -> Column:
    fraction = start / target
    out = inverted(fraction, schedules[-1])
    for k in range(len(schedules) - 2, -1, -1):
        out = F.when(F.pmod(turn, F.lit(len(schedules))) == k, inverted(fraction, schedules[k])).otherwise(out)
    return F.round(out, 9)


def curriculum(df: DataFrame, schedules=SCHEDULES, **options) -> DataFrame:
    """One row per placement of a document, range-sorted by training position; rows of which nothing is taken go.

    A row placed twice appears at two positions. Documents stay whole: the one at the boundary is emitted in full.
    """
    mixed = mix(df, schedules=schedules, **options).where(F.col("copies") > 0)
    turn = mixed.withColumn("_copy", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))))
    again = F.col("_start") + F.col("_copy") * F.col("source_size")
    placed = turn.withColumn("position", position_of(again, F.col("target"), F.col("_turn"), schedules))
    return placed.orderBy("position", "_start").drop("_copy", "_start", "_turn")
