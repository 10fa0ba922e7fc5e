"""Pages as they arrive: clean, cut, embed, append; tables are read as the merge of all micro-batches."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleanloom.operators import chunking
from gleanloom.operators.tables import latest_chunks, latest_vectors
from gleanloom.plans.ingest import clean_pages, embed_chunks
from gleanloom.streaming.sinks import EPOCH, read_epochs, write_epochs

CHUNK_LOG = (
    "id STRING, parent_id STRING, source_id STRING, page_url STRING, page_title STRING, section_index INT, "
    "section_heading STRING, parent_index INT, chunk_index INT, child_text STRING, capture_id BIGINT, capture_md5 STRING, workspace_id STRING"
)
VECTOR_LOG = "chunk_id STRING, source_id STRING, embedding ARRAY<FLOAT>, workspace_id STRING"
PAGE_LOG = (
    "source_id STRING, workspace_id STRING, page_url STRING, capture_id BIGINT, capture_md5 STRING, failed BOOLEAN, "
    "drop_reason STRING, n_chunks BIGINT"
)
CAPTURE = ["capture_id", "capture_md5"]


def stream_chunks(pages: DataFrame, sources: DataFrame, path: str, checkpoint: str, **options) -> StreamingQuery:
    """Append each micro-batch's pages (to ``<path>-pages``) and chunks, both marked with the capture they are from.

    Ids are deterministic, so a page seen again changes nothing; of several captures of a URL the tables show the
    one that the batch job keeps.
    """

    def audited(batch: DataFrame) -> DataFrame:
        marked = batch.withColumns({"capture_id": F.col("page_id"), "capture_md5": F.coalesce(F.md5("html"), F.lit(""))})
        return clean_pages(marked, sources)

    def chunk(batch: DataFrame) -> DataFrame:
        good = batch.where(F.col("drop_reason").isNull())
        chunks = chunking.chunk_hierarchy(good, **options)[1]
        captures = good.select("source_id", "page_url", *CAPTURE)
        return chunks.drop(*CAPTURE).join(captures, ["source_id", "page_url"])

    def log(batch: DataFrame) -> DataFrame:
        counts = chunk(batch).groupBy("source_id", "page_url").agg(F.count("*").alias("n_chunks"))
        kept = batch.select("source_id", "workspace_id", "page_url", *CAPTURE, "failed", "drop_reason")
        return kept.join(counts, ["source_id", "page_url"], "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)))

    return write_epochs(pages, path, checkpoint, prepare=chunk, partition_by=["workspace_id"], shared=audited, more={f"{path}-pages": log})


def current_pages(spark: SparkSession, path: str) -> DataFrame:
    """Each page by its winning capture: unknown ids last, then by id and the html's hash, as in the batch job."""
    log = read_epochs(spark, f"{path}-pages", PAGE_LOG)
    rest = [c for c in log.columns if c not in ("source_id", "page_url", EPOCH)]
    order = F.struct(F.col("capture_id").isNull(), "capture_id", "capture_md5")
    first = log.groupBy("source_id", "page_url").agg(F.min_by(F.struct(*rest), order).alias("_first"))
    return first.select("source_id", "page_url", "_first.*")


def stage_events(spark: SparkSession, path: str, vector_path: str | None = None) -> DataFrame:
    """``(source_id, epoch, stage, status, n, error)``: an event for each stage that a micro-batch brought a source through.

    A batch of which all pages fail ends in FAILED with an error; else pages were scraped, chunked, embedded (with a
    vector table) and done.
    """
    log = read_epochs(spark, f"{path}-pages", PAGE_LOG)
    seen = log.groupBy("source_id", EPOCH).agg(
        F.count("*").alias("pages"), F.count_if(F.coalesce("failed", F.lit(True))).alias("failures"), F.sum("n_chunks").alias("chunks"))
    bad = F.col("failures") == F.col("pages")
    error = F.when(bad, F.concat(F.lit("all pages failed: "), F.col("pages")))

    def event(stage: int, status, n, error=None):
        return F.struct(F.lit(stage).alias("stage"), F.lit(status).alias("status"), F.col(n).alias("n"), (F.lit(None).cast("string") if error is None else error).alias("error"))

    stages = [event(0, "SCRAPING", "pages"), F.when(~bad, event(1, "CHUNKING", "chunks"))]
    if vector_path is not None:
        stages.append(F.when(~bad & (F.col("chunks") > 0), event(2, "EMBEDDING", "chunks")))
    end = F.when(bad, event(3, "FAILED", "failures", error)).otherwise(event(3, "DONE", "chunks"))
    return seen.select("source_id", EPOCH, F.explode(F.array_compact(F.array(*stages, end))).alias("e")).select("source_id", EPOCH, "e.*")


def stream_vectors(
    chunk_path: str, spark: SparkSession, model: PipelineModel, path: str, checkpoint: str
) -> StreamingQuery:
    """Embed the chunk log's new files: the second stage follows the first through its table."""
    stream = spark.readStream.schema(f"{CHUNK_LOG}, {EPOCH} BIGINT").option("basePath", chunk_path).parquet(
        chunk_path
    )
    return write_epochs(
        stream, path, checkpoint, prepare=lambda batch: embed_chunks(batch, model), partition_by=["workspace_id"]
    )


def current_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of the winning captures; chunks of other captures of the same page are gone."""
    winners = current_pages(spark, path).select("source_id", "page_url", *CAPTURE)
    log = read_epochs(spark, path, CHUNK_LOG)
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"w.{c}")) for c in ("source_id", "page_url", *CAPTURE)]
    own = log.alias("l").join(winners.alias("w"), same, "left_semi")
    return latest_chunks(own.drop(*CAPTURE), EPOCH)


def current_vectors(spark: SparkSession, path: str, chunks: DataFrame | None = None) -> DataFrame:
    """The newest vector of each chunk, of the given current ``chunks`` only."""
    newest = latest_vectors(read_epochs(spark, path, VECTOR_LOG), EPOCH)
    if chunks is None:
        return newest
    return newest.join(chunks.select("workspace_id", F.col("id").alias("chunk_id")), ["workspace_id", "chunk_id"], "left_semi")
