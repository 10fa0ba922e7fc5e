"""Status streams: newest state per source, delivery to subscribers, page progress, request deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanloom.operators.cleaning import quality_gate
from gleanloom.scale import broadcast_if_small
from gleanloom.sources.model import STATUS_CHANNEL, STATUS_MESSAGE


def dedup_requests(requests: DataFrame, horizon: str) -> DataFrame:
    """One request per source within the watermark ``horizon``, which bounds the state."""
    return requests.withWatermark("ts", horizon).dropDuplicatesWithinWatermark(["source_id"])


def request_runs(requests: DataFrame, delay: str, quiet: str) -> DataFrame:
    """One row per run of a source's requests, ``(source_id, first_ts, last_ts, n_requests)``, when the run has ended.

    A run ends when no request has come for ``quiet`` of event time; a source that returns later begins a new run. The state holds
    open runs only and expires by the watermark, which is ``delay`` behind the newest request. A late request is dropped when
    the watermark has passed its own quiet time, one without a time always; a null source is one source of its own.
    """
    runs = requests.withWatermark("ts", delay).groupBy("source_id", F.session_window("ts", quiet))
    return runs.agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n_requests")).drop("session_window")


def status_latest(events: DataFrame) -> DataFrame:
    """Current status per source by (ts, event_id); state holds one row per source."""
    newest = F.max_by(F.struct("status", "ts"), F.struct("ts", "event_id"))
    return events.groupBy("source_id").agg(newest.alias("_last")).select("source_id", "_last.*")


def parse_status(messages: DataFrame) -> DataFrame:
    """Messages ``(channel, value)`` of the status channel as columns; ``malformed`` marks the unreadable."""
    parsed = F.from_json("value", STATUS_MESSAGE, {"mode": "PERMISSIVE"})
    return (
        messages.where(F.col("channel") == STATUS_CHANNEL)
        .withColumn("_m", parsed)
        .select(
            "value",
            (F.col("_m").isNull() | F.col("_m.workspaceId").isNull() | F.col("_m.sourceId").isNull()).alias(
                "malformed"
            ),
            F.col("_m.workspaceId").alias("workspace_id"),
            F.col("_m.sourceId").alias("source_id"),
            F.col("_m.status").alias("status"),
            F.col("_m.pageCount").alias("page_count"),
            F.col("_m.chunkCount").alias("chunk_count"),
            F.col("_m.error").alias("error"),
        )
    )


def quarantine(messages: DataFrame) -> DataFrame:
    return parse_status(messages).where("malformed").select("value")


def status_route(messages: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """The five public fields, once per subscriber ``(workspace_id, user_id)`` of the message's workspace."""
    good = parse_status(messages).where(~F.col("malformed"))
    rooms = subscriptions.select("workspace_id", "user_id").distinct()
    return good.join(broadcast_if_small(rooms), "workspace_id").select(
        "workspace_id", "user_id", "source_id", "status", "page_count", "chunk_count", "error"
    )


def page_progress(pages: DataFrame, horizon: str | None = None) -> DataFrame:
    """Running count of good pages per source of ``pages(source_id, url, content, failed)``; a URL counts by its first capture.

    With a ``horizon`` a URL is remembered until the watermark has passed its ``ts`` by that long, and counts again when it returns in
    a later micro-batch than that; so the state is bounded. Without one every URL stays in the state, for streams that end.
    """
    if horizon is not None:
        pages = pages.withWatermark("ts", horizon).dropDuplicatesWithinWatermark(["source_id", "url"])
    elif "url" in pages.columns:
        pages = pages.dropDuplicates(["source_id", "url"])
    return quality_gate(pages).groupBy("source_id").agg(F.count(F.lit(1)).alias("page_count"))
