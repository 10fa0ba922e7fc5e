"""Idempotent sink: each micro-batch owns one folder, so a repeated batch replaces itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleanloom.scale import cut_lineage

EPOCH = "epoch"


def write_epochs(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    mode: str = "append",
    prepare: Callable[[DataFrame], DataFrame] | None = None,
    partition_by: list[str] | None = None,
    shared: Callable[[DataFrame], DataFrame] | None = None,
    more: dict[str, Callable[[DataFrame], DataFrame]] | None = None,
) -> StreamingQuery:
    """Process what is available now and stop; ``prepare`` runs on each micro-batch as a batch frame.

    ``more`` names further tables that are made from the same micro-batch, ``shared`` what is done once for all.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        own = batch if shared is None else cut_lineage(shared(batch))
        for other, made in (more or {}).items():
            made(own).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{other}/{EPOCH}={epoch}")
        rows = own if prepare is None else prepare(own)
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "static")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{path}/{EPOCH}={epoch}")

    return (
        stream.writeStream.outputMode(mode)
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_epochs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All written rows with their ``epoch``; folders of the sink appear as a column."""
    return spark.read.schema(f"{schema}, {EPOCH} BIGINT").option("basePath", path).parquet(path)


def latest_by(log: DataFrame, key: str) -> DataFrame:
    """The last update of each key in an update-mode log."""
    rest = [c for c in log.columns if c not in (key, EPOCH)]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), EPOCH).alias("_last")).select(key, "_last.*")
