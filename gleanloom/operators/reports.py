"""Reports over workspaces, sources and messages: flat rows of one shape at every size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _of_users(workspaces: DataFrame, user_id: str | None) -> DataFrame:
    return workspaces if user_id is None else workspaces.where(F.col("user_id") == user_id)


def _with_sources(workspaces: DataFrame, sources: DataFrame, columns: list[str]) -> DataFrame:
    """One row per workspace and source, and one for a workspace without sources; no list is collected."""
    named = sources.select(F.col("workspace_id").alias("_of"), *[F.col(c).alias(f"source_{c}") for c in columns])
    return workspaces.join(named, F.col("id") == F.col("_of"), "left").drop("_of")


def workspace_list(workspaces: DataFrame, sources: DataFrame, user_id: str | None = None) -> DataFrame:
    """Workspaces of one user, or of all, newest first, with ``source_id, source_status`` of each of their sources."""
    listed = _with_sources(_of_users(workspaces, user_id), sources, ["id", "status"])
    return listed.orderBy("user_id", F.col("created_at").desc(), "id", "source_id")


def message_counts(workspaces: DataFrame, messages: DataFrame, user_id: str | None = None) -> DataFrame:
    """``(id, user_id, message_count)``: one row per workspace."""
    counted = messages.groupBy(F.col("workspace_id").alias("id")).agg(F.count(F.lit(1)).alias("message_count"))
    mine = _of_users(workspaces, user_id).select("id", "user_id")
    return mine.join(counted, "id", "left").withColumn("message_count", F.coalesce("message_count", F.lit(0)))


def workspace_detail(workspaces: DataFrame, sources: DataFrame, asked: DataFrame) -> DataFrame:
    """The asked workspaces ``(id, user_id)`` of their owners, a row for each of their sources with all its columns."""
    mine = workspaces.join(asked.select("id", "user_id").distinct(), ["id", "user_id"], "left_semi")
    return _with_sources(mine, sources, [c for c in sources.columns if c != "workspace_id"])


def source_list(sources: DataFrame, workspaces: DataFrame, asked: DataFrame) -> DataFrame:
    """Sources of the asked workspaces ``(workspace_id, user_id)`` of their owners, newest first."""
    owners = workspaces.select(F.col("id").alias("workspace_id"), "user_id")
    mine = owners.join(asked.distinct(), ["workspace_id", "user_id"], "left_semi").select("workspace_id")
    return sources.join(mine, "workspace_id", "left_semi").orderBy(
        "workspace_id", F.col("created_at").desc(), "id"
    )
