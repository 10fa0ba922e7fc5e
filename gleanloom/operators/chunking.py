"""Page text to sections, parents and children. Every step is narrow: pages are cut where they lie."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanloom.functions import ids
from gleanloom.functions.splitter import CHILD_LEVEL, PARENT_LEVEL, Level, split_one_level, split_two_levels
from gleanloom.functions.text import WHITE_SPACE_CLASS, section_label, trim_all
from gleanloom.operators.cleaning import MIN_CONTENT, MIN_SECTION
from gleanloom.scale import explode_once

_MARK = "\u0001"
# A heading is a line of one to three hashes, white space and a title; only LF ends a line.
_HEADING = rf"#{{1,3}}{WHITE_SPACE_CLASS}+.+"
_TITLE = rf"(?md)^#{{1,3}}{WHITE_SPACE_CLASS}+(.+)$"

PAGE_COLUMNS = ["source_id", "workspace_id", "page_url", "page_title"]


def split_sections(pages: DataFrame, content: str = "content") -> DataFrame:
    """One row per section: ``section_index, heading, text``; the text keeps its heading line.

    A page without any text has one empty section.
    """
    columns = [c for c in pages.columns if c != content]
    body = F.replace(F.coalesce(F.col(content), F.lit("")), F.lit(_MARK), F.lit(""))
    part, index = F.coalesce("_part", F.lit("")), F.coalesce("_at", F.lit(0))
    # every part but a preamble opens with its heading line
    heading = F.when(F.col("_preamble") & (index == 0), "").otherwise(F.regexp_extract(part, _TITLE, 1))
    return (
        pages.select(*columns, F.regexp_replace(body, rf"(?md)^({_HEADING})$", f"{_MARK}$1").alias("_marked"))
        .select(
            *columns,
            (~F.startswith("_marked", F.lit(_MARK))).alias("_preamble"),
            F.filter(F.split("_marked", _MARK), lambda p: p != "").alias("_parts"),
        )
        .select(*columns, "_preamble", F.posexplode_outer("_parts").alias("_at", "_part"))
        .select(*columns, index.alias("section_index"), heading.alias("heading"), trim_all(part).alias("text"))
    )


def recursive_split(df: DataFrame, text: str, level: Level) -> DataFrame:
    """One row per chunk of one level: ``chunk_index, chunk``."""
    keep = [c for c in df.columns if c != text]
    return explode_once(df, split_one_level(F.col(text), level), "chunk_index", "chunk", keep)


def windows_of(text: Column, size: int, overlap: int) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - overlap, F.lit(1)), F.lit(size - overlap))
    cut = F.transform(starts, lambda at: trim_all(F.substr(text, at, F.lit(size))))
    return F.filter(cut, lambda chunk: chunk != "")


def window_split(df: DataFrame, text: str, size: int, overlap: int) -> DataFrame:
    """Character windows, trimmed, blank ones dropped: ``chunk_index, chunk``."""
    keep = [c for c in df.columns if c != text]
    return explode_once(df, windows_of(F.col(text), size, overlap), "chunk_index", "chunk", keep)


def _parents_of(text: Column, splitter: str, parent: Level, child: Level) -> Column:
    if splitter == "recursive":
        return split_two_levels(text, parent, child)
    if splitter == "window":
        return F.transform(
            windows_of(text, parent.size, parent.overlap),
            lambda p: F.struct(
                p.alias("parent_text"), windows_of(p, child.size, child.overlap).alias("children")
            ),
        )
    raise ValueError(f"splitter must be 'recursive' or 'window', not {splitter!r}")


def split_parents(
    pages: DataFrame,
    splitter: str = "recursive",
    parent: Level = PARENT_LEVEL,
    child: Level = CHILD_LEVEL,
    id_scheme: str = "section",
) -> DataFrame:
    """Parents of every page with their children still nested.

    Both later tables come from here: ``parents_of`` and ``chunks_of``. A parent's text is stored once.
    """
    good = pages.select(*PAGE_COLUMNS, "content").where(F.length("content") >= MIN_CONTENT)
    sections = split_sections(good).where(F.length("text") >= MIN_SECTION)
    pid = ids.parent_id(
        F.col("source_id"), F.col("page_url"), F.col("section_index"), F.col("parent_index"), id_scheme
    )
    place = [*PAGE_COLUMNS, "section_index", "heading"]
    return (
        explode_once(sections, _parents_of(F.col("text"), splitter, parent, child), "parent_index", "_p", place)
        .select(
            pid.alias("parent_id"),
            *PAGE_COLUMNS,
            "section_index",
            section_label(F.col("heading"), F.col("page_title")).alias("section_heading"),
            "parent_index",
            F.col("_p.parent_text").alias("parent_text"),
            F.col("_p.children").alias("children"),
        )
    )


def parents_of(split: DataFrame) -> DataFrame:
    return split.drop("children")


def chunks_of(split: DataFrame, id_scheme: str = "section") -> DataFrame:
    """One row per child, without the parent's text (join ``parents`` on ``parent_id`` for it)."""
    cid = ids.chunk_id(
        F.col("source_id"), F.col("page_url"), F.col("section_index"),
        F.col("parent_index"), F.col("chunk_index"), F.col("child_text"), id_scheme,
    )
    place = [c for c in split.columns if c not in ("parent_text", "children")]
    return (
        explode_once(split, F.col("children"), "chunk_index", "child_text", place)
        .select(
            cid.alias("id"),
            "parent_id",
            *PAGE_COLUMNS,
            "section_index",
            "section_heading",
            "parent_index",
            "chunk_index",
            "child_text",
        )
    )


def chunk_hierarchy(pages: DataFrame, id_scheme: str = "section", **options) -> tuple[DataFrame, DataFrame]:
    """``(parents, chunks)`` of cleaned pages ``(source_id, workspace_id, page_url, page_title, content)``."""
    split = split_parents(pages, id_scheme=id_scheme, **options)
    return parents_of(split), chunks_of(split, id_scheme)


def id_collisions(chunks: DataFrame) -> DataFrame:
    """Ids that stand for more than one place; the default id scheme leaves none."""
    return chunks.groupBy("id").agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > 1)


def chunk_counts(sources: DataFrame, pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per source: good pages, visited pages and chunks; a source without any stays with zeros."""
    visited = pages.groupBy("source_id").agg(
        F.count_if(F.col("drop_reason").isNull()).alias("pages_indexed"),
        F.countDistinct("page_url").alias("pages_visited"),
    )
    counted = chunks.groupBy("source_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    joined = sources.select("source_id").join(visited, "source_id", "left").join(counted, "source_id", "left")
    return joined.select(
        "source_id",
        *[
            F.coalesce(c, F.lit(0)).cast("long").alias(c)
            for c in ("pages_indexed", "pages_visited", "chunk_count")
        ],
    )
