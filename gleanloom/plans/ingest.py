"""Raw pages to stored chunks and vectors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanloom.operators import chunking, cleaning, crawl, embedding, tables
from gleanloom.scale import cut_lineage


@dataclass(frozen=True)
class Ingested:
    """The outputs of one run; all lazy."""

    pages: DataFrame
    parents: DataFrame
    chunks: DataFrame
    outcome: DataFrame


def clean_pages(pages: DataFrame, sources: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """Scoped, extracted and audited pages: every page of every source, with its ``drop_reason``."""
    return audit_scoped(crawl.scope_pages(crawl.scan_pages(pages), sources, suffixes))


def audit_scoped(scoped: DataFrame) -> DataFrame:
    extracted = cleaning.extract_content(scoped).drop("root_path")
    return cleaning.audit_pages(extracted.withColumnsRenamed({"url": "page_url", "title": "page_title"}))


def ingest(pages: DataFrame, sources: DataFrame, suffixes: DataFrame | None = None, **options) -> Ingested:
    """``pages(page_id, url, html)`` and ``sources(source_id, workspace_id, url)`` to chunks.

    Narrow from the scope join to the outputs, apart from the per-source roll-up. The extracted pages
    feed all outputs, so they are checkpointed: the html is read and taken apart once.
    """
    audited = cut_lineage(clean_pages(pages, sources, suffixes))
    good = audited.where(F.col("drop_reason").isNull())
    parents, chunks = chunking.chunk_hierarchy(good, **options)
    outcome = cleaning.source_outcome(audited).join(
        chunking.chunk_counts(sources, audited, chunks), "source_id", "right"
    )
    return Ingested(audited, parents, chunks, outcome)


def embed_chunks(chunks: DataFrame, model: PipelineModel) -> DataFrame:
    """Vector rows of the chunks."""
    return embedding.embed_texts(chunks, "child_text", model).select(
        F.col("id").alias("chunk_id"), "workspace_id", "source_id", "embedding"
    )


def reindex(
    chunks: DataFrame, parents: DataFrame, vectors: DataFrame, pages: DataFrame, sources: DataFrame,
    model: PipelineModel, **options,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Delete-then-rebuild of ``sources``: ``(chunks, parents, vectors)``. Equal input gives equal tables."""
    fresh = ingest(pages, sources, **options)
    new_chunks = cut_lineage(fresh.chunks)
    stamped = new_chunks.withColumn("version", F.lit(0))
    new_vectors = embed_chunks(new_chunks, model).withColumn("version", F.lit(0))
    return (
        tables.merge_chunks(tables.delete_by_source(chunks, sources), stamped),
        tables.delete_by_source(parents, sources).unionByName(fresh.parents),
        tables.merge_vectors(tables.delete_by_source(vectors, sources), new_vectors),
    )
