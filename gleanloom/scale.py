"""Helpers that keep plans safe on large inputs: measured broadcasts and lineage cuts."""

from __future__ import annotations

import contextlib
import functools
import operator
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

_UNITS = {"": 1, "b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30}


def broadcast_limit(spark: SparkSession) -> int:
    """The session's own broadcast threshold in bytes; -1 means never broadcast."""
    text = spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760").strip().lower()
    number, unit = re.fullmatch(r"(-?\d+)\s*([a-z]*)", text).groups()
    return int(number) * _UNITS[unit]


def _width(field: T.StructField) -> Column:
    col, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, T.StringType):
        size = F.octet_length(col)
    elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
        size = F.octet_length(F.array_join(col, "")) + F.size(col) * 16
    elif isinstance(kind, T.ArrayType):
        size = F.size(col) * (4 if isinstance(kind.elementType, (T.FloatType, T.IntegerType)) else 8)
    else:
        size = F.lit(16)
    return F.coalesce(size.cast("long"), F.lit(0)) + 16


def measured_bytes(df: DataFrame) -> int:
    """Size of the rows, measured by one aggregate over them."""
    total = functools.reduce(operator.add, [_width(f) for f in df.schema.fields])
    return df.agg(F.coalesce(F.sum(total), F.lit(0)).alias("bytes")).first()["bytes"]


def fits_broadcast(df: DataFrame, copies: int = 1) -> bool:
    """Whether ``copies`` times the rows stay under the session's threshold."""
    limit = broadcast_limit(df.sparkSession)
    return limit > 0 and measured_bytes(df) * copies <= limit


def broadcast_if_small(df: DataFrame, bound: DataFrame | None = None) -> DataFrame:
    """Mark for broadcast when the measured size is under the session's threshold.

    Beyond it the frame is returned as is, and the join runs as a shuffle join, where adaptive
    execution splits skewed keys. ``bound`` names a cheaper frame that is known to be no smaller (same
    rows, at least the columns that weigh), so that measuring does not run ``df`` itself.
    """
    return F.broadcast(df) if fits_broadcast(df if bound is None else bound) else df


def shared_dir(spark: SparkSession) -> str:
    """Shared folder of the cluster (``spark.checkpoint.dir``); a fresh local one only when unset, and only where one machine runs all."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    current = context.getCheckpointDir()
    if configured:
        if current is None:
            context.setCheckpointDir(configured)
        return configured
    if current is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="gleanloom-checkpoint-"))
        current = context.getCheckpointDir()
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder for a written table or a stream's checkpoint."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors and ends the plan's history."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str, default: str):
    """The session's setting while a write runs; afterwards the one before."""
    before = spark.conf.get(key, default)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write to a new Parquet table below the shared folder and read it back: ends the lineage, survives lost executors.

    The shuffle files of this one write go when it has ended, as the table takes their place.
    """
    spark: SparkSession = df.sparkSession
    path = scratch_path(spark, name)
    with setting(spark, CLEANUP, "true", "false"):
        df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def block_count(size: Column, most: int, least: int | None, spark: SparkSession) -> Column:
    """Blocks of at most ``most`` each; a size of few blocks is cut into as many as there are task slots, while these hold ``least``."""
    blocks = F.ceil(size / most)
    if least is not None:
        blocks = F.greatest(blocks, F.least(F.ceil(size / least), F.lit(spark.sparkContext.defaultParallelism).cast("long")))
    return F.greatest(blocks, F.lit(1).cast("long")).cast("int")


def explode_once(df: DataFrame, array: Column, position: str, value: str, keep: list[str]) -> DataFrame:
    """One row per element of a computed array.

    A plain explode makes the optimizer add a filter on the array's size, and with it a second evaluation
    of the whole expression per row; the outer form does not. Empty arrays still give no row.
    """
    return df.select(*keep, F.posexplode_outer(array).alias(position, value)).where(F.col(position).isNotNull())


def top_ranked(df: DataFrame, group: str | list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows per group with their ``rank`` from 0.

    The bound is on the row number itself: only then do tasks drop the rest before the shuffle.
    """
    keys = [group] if isinstance(group, str) else group
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    ranked = df.withColumn("_place", place).where(F.col("_place") <= k)
    return ranked.withColumn("rank", F.col("_place").cast("long") - 1).drop("_place")


# Most workspaces that are named in a scan's filter; more are found by a join.
NAMED_WORKSPACES = 1_000


def in_workspaces(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows of the asked workspaces. While these are few the filter is a list, which prunes partitions of the table."""
    some = [r[0] for r in asked.select("workspace_id").distinct().limit(NAMED_WORKSPACES + 1).collect()]
    if len(some) <= NAMED_WORKSPACES:
        return rows.where(F.col("workspace_id").isin([w for w in some if w is not None]))
    return rows.join(broadcast_if_small(asked.select("workspace_id").distinct()), "workspace_id", "left_semi")
