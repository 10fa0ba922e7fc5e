"""Status of every source as its pages arrive: an arbitrary stateful operator with a timer per source.

A source goes through SCRAPING, CHUNKING and EMBEDDING to DONE, or to FAILED with an error. Its state is a few counters; an event is
emitted at each change, in the micro-batch in which it happens:

* the first page of a run: SCRAPING;
* the first page that passes the gate: CHUNKING;
* the first page that has chunks: EMBEDDING;
* no page for ``quiet`` of event time, measured by the watermark: the run ends, DONE with its numbers of pages and chunks, or FAILED
  where every page was rejected or failed. The state is dropped with it, so it holds running sources only; a page that
  comes later begins a new run.

Pages later than the watermark are dropped by Spark. Null sources are one source of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "source_id STRING, run BIGINT, step INT, status STRING, pages BIGINT, chunks BIGINT, error STRING, at BIGINT"
STATE = "pages BIGINT, good BIGINT, chunks BIGINT, first BIGINT, last BIGINT"


def source_stages(pages: DataFrame, delay: str, quiet_seconds: int) -> DataFrame:
    """Events of ``pages(source_id, ts, failed, drop_reason, n_chunks)``, a stream; ``delay`` is how late a page may come.

    ``run`` is the run's first event time in milliseconds, ``step`` the order of its events.
    """
    quiet = quiet_seconds * 1000
    rows = pages.select("source_id", F.col("ts").cast("timestamp").alias("ts"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"),
                        (~F.coalesce("failed", F.lit(True)) & F.col("drop_reason").isNull()).alias("good"), F.coalesce("n_chunks", F.lit(0)).cast("long").alias("n_chunks"))

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        counts = list(state.get) if state.exists else None

        def event(step: int, status: str, at: int, error: str | None = None) -> None:
            out.append((key[0], counts[3], step, status, counts[0], counts[2], error, at))

        def ended() -> None:
            if counts[1]:
                event(3, "DONE", counts[4] + quiet)
            else:
                event(3, "FAILED", counts[4] + quiet, f"all pages failed: {counts[0]}")

        if state.hasTimedOut:
            ended()
            state.remove()
        else:
            # a source has few pages in a micro-batch: arrays cost it far less than frames do
            parts = [[frame[c].to_numpy() for c in ("at", "n_chunks", "good")] for frame in frames]
            arrived = [np.concatenate(column) for column in zip(*parts)]
            order = np.lexsort((arrived[1], arrived[0]))
            for at, n, good in zip(*[column[order].tolist() for column in arrived]):
                if counts is not None and at > counts[4] + quiet:  # the pause lies between pages of one micro-batch
                    ended()
                    counts = None
                if counts is None:
                    counts = [0, 0, 0, at, at]
                    event(0, "SCRAPING", at)
                counts = [counts[0] + 1, counts[1] + good, counts[2] + n, counts[3], max(counts[4], at)]
                if good and counts[1] == 1:
                    event(1, "CHUNKING", at)
                if n and counts[2] == n:
                    event(2, "EMBEDDING", at)
            state.update(tuple(counts))
            state.setTimeoutTimestamp(max(counts[4] + quiet, state.getCurrentWatermarkMs() + 1))
        if out:
            names = ["source_id", "run", "step", "status", "pages", "chunks", "error", "at"]
            yield pd.DataFrame(out, columns=names)

    events = rows.withWatermark("ts", delay).groupBy("source_id").applyInPandasWithState(
        advance, EVENTS, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return events.withColumn("ts", F.timestamp_millis("at")).drop("at")
