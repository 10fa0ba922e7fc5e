"""Incremental reindexing: only pages whose capture changed are cut again, and only texts without a vector are embedded.

The page table of an index keeps a fingerprint of each page's html and of the options that it was cut with. A run compares the
fingerprints of the new captures with the stored ones, takes changed pages apart, removes the rows of changed and vanished pages, and adds
the new rows. A chunk of a changed page whose text the page's workspace had before takes over its vector. The
tables equal those of a full rebuild with the same model.

Defined cases: null html is a page that fails, and differs from empty html; a URL that is captured twice counts once (``scan_pages``); sources
that are not asked for keep all their rows; a source without any capture loses its rows; no previous index means a first build.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanloom.operators import chunking, crawl, embedding
from gleanloom.plans.ingest import audit_scoped
from gleanloom.scale import broadcast_if_small, cut_lineage

PAGE = ["workspace_id", "source_id", "page_url"]
SOURCE = ["workspace_id", "source_id"]


@dataclass(frozen=True)
class Index:
    """The stored tables of an index.

    ``pages(workspace_id, source_id, page_url, print, failed, drop_reason)``, ``parents`` and ``chunks`` as ``chunk_hierarchy`` makes them,
    ``vectors(chunk_id, workspace_id, source_id, embedding)``.
    """

    pages: DataFrame
    parents: DataFrame
    chunks: DataFrame
    vectors: DataFrame


def page_print(html: Column, options: dict) -> Column:
    """Fingerprint of a capture and of the way it is cut."""
    cut = F.lit(repr(sorted(options.items())))
    return F.md5(F.concat(cut, F.when(html.isNull(), "0").otherwise("1"), F.coalesce(html, F.lit(""))))


def _states(prints: DataFrame, stored: DataFrame) -> DataFrame:
    """Every page of either side: whether it is ``fresh`` (to be cut) and ``stale`` (its stored rows go)."""
    both = prints.join(stored.select(*PAGE, F.col("print").alias("_stored")), PAGE, "full_outer")
    same = F.coalesce(F.col("print") == F.col("_stored"), F.lit(False))
    return both.select(
        *PAGE, "print", (F.col("print").isNotNull() & ~same).alias("fresh"), (F.col("_stored").isNotNull() & ~same).alias("stale"))


def _without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(broadcast_if_small(gone.select(*keys)), keys, "left_anti").select(*rows.columns)


def _of(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(broadcast_if_small(wanted.select(*keys)), keys, "left_semi").select(*rows.columns)


def known_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """``(workspace_id, text_print, embedding)``: a vector of each text among the chunks ``(workspace_id, id, text_print)``."""
    held = vectors.select("workspace_id", F.col("chunk_id").alias("id"), "embedding").where("embedding is not null")
    paired = held.join(broadcast_if_small(chunks), ["workspace_id", "id"])
    return paired.groupBy("workspace_id", "text_print").agg(F.min_by("embedding", "id").alias("embedding"))


def refresh(
    index: Index | None, pages: DataFrame, sources: DataFrame, model: PipelineModel, suffixes: DataFrame | None = None, **options
) -> tuple[Index, DataFrame]:
    """The index after new captures ``pages(page_id, url, html)`` of ``sources(source_id, workspace_id, url)``, and the work it took.

    The work is a row per source: ``n_pages, n_changed, n_gone, n_cut, n_reused, n_embedded``. Fingerprints move between
    tasks, html only that of changed pages, and only when these are too many to be named in a broadcast.
    """
    if options.get("id_scheme", "section") != "section":
        raise ValueError("chunks are replaced by id: the id scheme must tell all places apart")
    scoped = crawl.scope_pages(crawl.scan_pages(pages), sources, suffixes).withColumnRenamed("url", "page_url")
    prints = cut_lineage(scoped.select(*PAGE, page_print(F.col("html"), options).alias("print")))
    if index is None:
        states = prints.withColumn("fresh", F.lit(True)).withColumn("stale", F.lit(False))
    else:
        states = cut_lineage(_states(prints, _of(index.pages, sources.select(*SOURCE).distinct(), SOURCE)))
    fresh, stale = states.where("fresh"), states.where("stale")
    audited = cut_lineage(audit_scoped(_of(scoped, fresh, PAGE).withColumnRenamed("page_url", "url")))
    parents, chunks = chunking.chunk_hierarchy(audited.where(F.col("drop_reason").isNull()), **options)
    chunks = cut_lineage(chunks)
    page_rows = audited.join(broadcast_if_small(fresh.select(*PAGE, "print")), PAGE).select(*PAGE, "print", "failed", "drop_reason")
    texts = chunks.withColumn("text_print", F.md5("child_text"))
    if index is None:
        paired = texts.withColumn("embedding", F.lit(None).cast("array<float>"))
    else:
        old = cut_lineage(_of(index.chunks, stale, PAGE).select("workspace_id", "id", F.md5("child_text").alias("text_print")))
        known = cut_lineage(known_vectors(old, index.vectors))
        paired = cut_lineage(texts.join(broadcast_if_small(known), ["workspace_id", "text_print"], "left"))
    columns = [F.col("id").alias("chunk_id"), "workspace_id", "source_id", "embedding"]
    reused = paired.where(F.col("embedding").isNotNull())
    embedded = embedding.embed_texts(paired.where(F.col("embedding").isNull()).drop("embedding"), "child_text", model)
    vectors = reused.select(*columns).unionByName(embedded.select(*columns))
    work = _work(sources, states, paired)
    if index is None:
        return Index(page_rows, parents, chunks, vectors), work
    gone = old.select("workspace_id", F.col("id").alias("chunk_id"))
    return Index(
        _without(index.pages, stale, PAGE).unionByName(page_rows),
        _without(index.parents, stale, PAGE).unionByName(parents),
        _without(index.chunks, stale, PAGE).unionByName(chunks),
        _without(index.vectors, gone, ["workspace_id", "chunk_id"]).unionByName(vectors),
    ), work


def _work(sources: DataFrame, states: DataFrame, paired: DataFrame) -> DataFrame:
    by_page = states.groupBy(*SOURCE).agg(
        F.count("print").alias("n_pages"), F.count_if("fresh").alias("n_changed"), F.count_if(F.col("print").isNull()).alias("n_gone"))
    by_chunk = paired.groupBy(*SOURCE).agg(
        F.count("*").alias("n_cut"), F.count("embedding").alias("n_reused"), F.count_if(F.col("embedding").isNull()).alias("n_embedded"))
    every = sources.select(*SOURCE).distinct().join(by_page, SOURCE, "left").join(by_chunk, SOURCE, "left")
    return every.na.fill(0, ["n_pages", "n_changed", "n_gone", "n_cut", "n_reused", "n_embedded"])
