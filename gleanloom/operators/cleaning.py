"""Page cleaning, quality gate and failure roll-up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanloom.functions import html as html_text

# Length limits in characters.
MIN_PAGE = 100  # a page needs more
MIN_CONTENT = 50
MIN_SECTION = 30


def extract_content(pages: DataFrame) -> DataFrame:
    """Adds ``title, content, failed`` and drops the html."""
    return html_text.extract_content(pages)


def drop_reason(content: str = "content", failed: str = "failed"):
    """Why the crawler skips a page; NULL for a good one. A page of unknown outcome counts as failed."""
    length = F.length(content)
    return (
        F.when(F.coalesce(F.col(failed), F.lit(True)), "failed")
        .when(F.coalesce(length, F.lit(0)) == 0, "empty")
        .when(length <= MIN_PAGE, "short")
    )


def audit_pages(pages: DataFrame) -> DataFrame:
    return pages.withColumn("drop_reason", drop_reason())


def quality_gate(pages: DataFrame) -> DataFrame:
    return pages.where(drop_reason().isNull())


def split_failures(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(good, failed)``; the run goes on with the good ones."""
    failed = F.coalesce(F.col("failed"), F.lit(True))
    return pages.where(~failed), pages.where(failed)


def source_outcome(pages: DataFrame) -> DataFrame:
    """Per source: FAILED with a message when every page failed, else DONE."""
    return (
        pages.groupBy("source_id")
        .agg(
            F.count(F.lit(1)).alias("n_pages"),
            F.count_if(F.coalesce("failed", F.lit(True))).alias("n_failed"),
        )
        .select(
            "source_id",
            "n_pages",
            "n_failed",
            F.when(F.col("n_failed") == F.col("n_pages"), "FAILED").otherwise("DONE").alias("status"),
            F.when(
                F.col("n_failed") == F.col("n_pages"), F.concat(F.lit("all pages failed: "), F.col("n_pages"))
            ).alias("error"),
        )
    )
