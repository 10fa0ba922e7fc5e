"""Shapes of physical plans that matter at scale."""

import re

import pytest
from pyspark.sql import functions as F

from gleanloom.operators import crawl, keyword, vector
from gleanloom.scale import broadcast_limit, fits_broadcast, top_ranked
from gleanloom.sources.model import CHUNKS, VECTORS
from gleanloom.sources.tables import read_by_workspace, write_by_workspace


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("vectors"))
    vectors = spark.range(300).select(
        F.col("id").cast("string").alias("chunk_id"),
        F.concat(F.lit("w"), F.col("id") % 3).alias("workspace_id"),
        F.lit("s").alias("source_id"),
        F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("embedding"),
    )
    write_by_workspace(vectors, path)
    return path


def test_vector_search_prunes_partitions_and_columns(spark, stored):
    vectors = read_by_workspace(spark, stored, VECTORS)
    asked = spark.createDataFrame([("q", "w1", [1.0, 0.0])], "question_id string, workspace_id string, embedding array<float>")
    found = vector.vector_search(vectors, asked, 3)
    text = plan(found)
    assert re.search(r"PartitionFilters: \[[^]]*workspace_id#\d+ = w1", text)
    assert "ReadSchema: struct<chunk_id:string,embedding:array<float>>" in text
    assert text.count("WindowGroupLimit") == 2 and text.count("Exchange") == 1
    # the scores of the best are equal when rounded: the id decides
    assert [r.id for r in found.orderBy("rank").collect()] == ["280", "283", "286"]


def test_top_ranked_limits_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("g"), F.col("id").alias("v"))
    best = top_ranked(df, "g", [F.col("v").desc()], 2)
    assert plan(best).count("WindowGroupLimit") == 2
    assert sorted((r.g, r.v, r["rank"]) for r in best.collect()) == [(0, 996, 1), (0, 998, 0), (1, 997, 1), (1, 999, 0)]


def test_size_checks_decide_on_broadcast(spark):
    small, large = spark.range(10), spark.range(2_000_000)
    assert fits_broadcast(small) and not fits_broadcast(large) and not fits_broadcast(small, copies=10**6)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "2MB")
    assert broadcast_limit(spark) == 2 << 20
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760b")


def test_scope_is_an_equi_join(spark, no_broadcast):
    pages = spark.createDataFrame([(1, "https://a.example.com/x")], "page_id long, url string")
    sources = spark.createDataFrame([("s", "https://example.com")], "source_id string, url string")
    text = plan(crawl.scope_pages(pages, sources))
    assert "SortMergeJoin" in text and "Cartesian" not in text and "NestedLoop" not in text


def test_chunk_table_keeps_string_workspaces(spark, tmp_path):
    rows = spark.createDataFrame([("c", "007")], "id string, workspace_id string")
    write_by_workspace(rows, str(tmp_path / "c"))
    assert read_by_workspace(spark, str(tmp_path / "c"), CHUNKS).first().workspace_id == "007"


@pytest.mark.parametrize("named", [True, False])
def test_stored_postings_are_read_from_the_folders_of_the_terms(spark, tmp_path, named, monkeypatch):
    if not named:
        monkeypatch.setattr(keyword, "NAMED_TERMS", 0)
    words = spark.range(2000).select(F.lit("w").alias("workspace_id"), F.concat(F.lit("t"), "id").alias("term"), F.lit("d").alias("id"), F.array(F.col("id").cast("int")).alias("positions"))
    keyword.write_postings(words, str(tmp_path / "p"), 4)
    stored = keyword.read_postings(spark, str(tmp_path / "p"))
    asked = spark.createDataFrame([("w", "t7"), ("w", "t1999"), ("w", "none"), ("v", "t8")], "workspace_id string, term string")
    found = keyword.asked_postings(stored, asked)
    text = plan(found)
    assert re.search(r"PartitionFilters: \[[^]]*folder#\d+ IN", text) and text.count("FileScan") == 1
    assert ("In(term" in text) == named
    assert rows_of(found.select("term", "positions")) == [("t1999", [1999]), ("t7", [7])]


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())
