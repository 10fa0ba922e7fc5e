"""Parquet tables of the corpus: layout, readers and writers.

Chunks, parents and vectors are partitioned by ``workspace_id``, so that every search prunes to its own
workspaces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str, spread: bool = False) -> DataFrame:
    """``spread`` is for tables whose rows are worked on at length, such as texts.

    When such a table has fewer scan splits than the session has task slots (a few small files), its
    rows are dealt out to all slots. A large table has more splits than slots and is left alone.
    """
    df = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
    slots = spark.sparkContext.defaultParallelism
    return df.repartition(slots) if spread and df.rdd.getNumPartitions() < slots else df


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("page_id", "url", "html")


def write_by_workspace(df: DataFrame, path: str, mode: str = "overwrite", gathered: bool = False) -> None:
    """Write partitioned by workspace; overwriting replaces the partitions that the rows belong to, and no others.

    The rebalance hint gathers a workspace's rows into few files and lets adaptive execution split a hot
    workspace by size over as many tasks as it needs. ``gathered`` rows come from a table of this layout and are not dealt again.
    """
    rows = (df if gathered else df.hint("rebalance", "workspace_id")).write.mode(mode)
    rows.option("partitionOverwriteMode", "dynamic").partitionBy("workspace_id").parquet(path)


def read_by_workspace(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Read with the declared schema: partition values stay strings and no files are sampled."""
    return spark.read.schema(schema).parquet(path)
