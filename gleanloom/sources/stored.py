"""Chunk and vector tables on disk, changed workspace by workspace.

A table is a Parquet folder partitioned by workspace. The first upsert writes it. A later one reads the workspaces that it touches, writes their new content to a
staged copy below the shared folder and from there over their partitions alone (dynamic partition overwrite); all other
partitions keep their files. The table is never read and written by one job, and a run that breaks off can be repeated:
merging the same updates again gives the same rows. Dropping a workspace removes its folder; nothing is rewritten.

Rows without a workspace are refused. Writers of one workspace must not run at the same time.
"""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanloom.operators import tables
from gleanloom.scale import broadcast_if_small, cut_lineage, in_workspaces, scratch_path
from gleanloom.sources.tables import read_by_workspace, write_by_workspace


def _folder(spark: SparkSession, path: str):
    """The path and its file system, of whatever store it is in."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def table_exists(spark: SparkSession, path: str) -> bool:
    folder, files = _folder(spark, path)
    return files.exists(folder)


def remove_folder(spark: SparkSession, path: str) -> bool:
    folder, files = _folder(spark, path)
    return files.delete(folder, True)


def _named(updates: DataFrame) -> DataFrame:
    updates = cut_lineage(updates)
    if not updates.where(F.col("workspace_id").isNull()).isEmpty():
        raise ValueError("rows without a workspace cannot be stored")
    return updates


def _replace(spark: SparkSession, path: str, touched: DataFrame, columns: list[str],
             merge: Callable[[DataFrame], DataFrame], empty: DataFrame) -> None:
    """Put the merge of the touched workspaces' stored rows in their place."""
    if not table_exists(spark, path):
        write_by_workspace(merge(empty), path)
        return
    stored, staged = read_by_workspace(spark, path, ", ".join(columns)), scratch_path(spark, "staged")
    write_by_workspace(merge(in_workspaces(stored, touched)), staged)
    # the staged files hold a workspace's rows together already
    write_by_workspace(read_by_workspace(spark, staged, ", ".join(columns)), path, gathered=True)
    remove_folder(spark, staged)


def _columns(df: DataFrame, version: str) -> list[str]:
    return [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != version]


def store_chunks(spark: SparkSession, path: str, updates: DataFrame, version: str = "version") -> None:
    """Upsert chunks by id into the table at ``path``; a known id keeps its workspace and changes in four columns only."""
    updates = _named(updates)
    columns = _columns(updates, version)
    touched = updates.select("workspace_id")
    if table_exists(spark, path):
        ids = updates.select("id").distinct()
        homes = read_by_workspace(spark, path, ", ".join(columns)).select("id", "workspace_id")
        touched = touched.union(homes.join(broadcast_if_small(ids), "id", "left_semi").select("workspace_id"))
    touched = cut_lineage(touched.distinct())
    names = [c for c in updates.columns if c != version]
    merge = lambda stored: tables.merge_chunks(stored.select(*names), updates, version)
    _replace(spark, path, touched, columns, merge, updates.select(*names).limit(0))


def store_vectors(spark: SparkSession, path: str, updates: DataFrame, version: str = "version") -> None:
    """Upsert vectors by workspace and chunk into the table at ``path``; the newest row replaces the old one as a whole."""
    updates = _named(updates)
    names = [c for c in updates.columns if c != version]
    merge = lambda stored: tables.merge_vectors(stored.select(*names), updates, version)
    touched = updates.select("workspace_id").distinct()
    _replace(spark, path, touched, _columns(updates, version), merge, updates.select(*names).limit(0))


def drop_workspaces(spark: SparkSession, path: str, dropped: DataFrame) -> int:
    """Remove the partitions of the given workspaces and return how many there were; no other file is touched."""
    folder, files = _folder(spark, path)
    if not files.exists(folder):
        return 0
    found = {}
    for status in files.listStatus(folder):
        name = status.getPath().getName()
        if status.isDirectory() and name.startswith("workspace_id="):
            found[unquote(name.split("=", 1)[1])] = status.getPath()
    asked = dropped.select(F.col("workspace_id").cast("string")).where("workspace_id IS NOT NULL").distinct()
    removed = 0
    for row in asked.toLocalIterator():
        if row[0] in found:
            removed += files.delete(found[row[0]], True)
    return removed
