import pytest
from conftest import rows
from pyspark.sql import functions as F

from gleanloom.operators import reports, tables

CHUNK = "id string, source_id string, workspace_id string, page_title string, child_text string"


@pytest.fixture
def target(spark):
    return spark.createDataFrame([("1", "s", "w", "t", "old"), ("2", "s", "w", "t", "keep")], CHUNK)


@pytest.fixture
def updates(spark):
    data = [
        ("1", "moved", "w2", "t1", "first", 1),
        ("1", "moved", "w2", None, "last", 2),
        ("3", "s3", "w", "t3", "new", 1),
        ("3", "s4", "w9", "t4", "newer", 2),
    ]
    return spark.createDataFrame(data, f"{CHUNK}, version int")


MERGED = [("1", "s", "w", None, "last"), ("2", "s", "w", "t", "keep"), ("3", "s3", "w", "t4", "newer")]


def test_merge_chunks(target, updates):
    merged = tables.merge_chunks(target, updates)
    assert rows(merged) == MERGED
    assert rows(tables.merge_chunks(merged, updates)) == MERGED


def test_merge_chunks_without_broadcast(target, updates, no_broadcast):
    assert rows(tables.merge_chunks(target, updates)) == MERGED


def test_merge_equals_log(target, updates):
    log = target.withColumn("version", F.lit(0)).unionByName(updates)
    assert rows(tables.latest_chunks(log).select(*target.columns)) == MERGED


def test_merge_vectors(spark):
    schema = "chunk_id string, workspace_id string, embedding array<float>"
    target = spark.createDataFrame([("a", "w", [1.0]), ("b", "w", [2.0])], schema)
    updates = spark.createDataFrame([("a", "w", [3.0], 1), ("a", "w", [4.0], 2), ("a", "v", [5.0], 1)], f"{schema}, version int")
    want = [("a", "v", [5.0]), ("a", "w", [4.0]), ("b", "w", [2.0])]
    merged = tables.merge_vectors(target, updates)
    assert rows(merged) == want and rows(tables.merge_vectors(merged, updates)) == want


def test_deletes(spark, target):
    gone = spark.createDataFrame([("w", "s"), ("w", "s")], "workspace_id string, source_id string")
    elsewhere = spark.createDataFrame([("w2", "s")], "workspace_id string, source_id string")
    assert rows(tables.delete_by_source(target, gone)) == []
    assert tables.delete_by_source(target, elsewhere).count() == 2
    assert tables.delete_by_workspace(target, gone).count() == 0


@pytest.fixture
def spaces(spark):
    data = [("w1", "One", None, "u1", "2024-01-01"), ("w2", "Two", "d", "u2", "2024-01-02"), ("w3", "3", "d", "u1", "2024-01-03")]
    df = spark.createDataFrame(data, "id string, name string, description string, user_id string, created_at string")
    return df.withColumn("created_at", F.col("created_at").cast("timestamp"))


@pytest.fixture
def sources(spark):
    data = [
        ("s1", "http://a.b/1", "w1", "DONE", 3, 30, None, "2024-02-01"),
        ("s2", "http://a.b/2", "w1", "FAILED", None, None, "boom", "2024-02-02"),
        ("s3", "http://a.b/1", "w2", "DONE", 5, 50, None, "2024-02-03"),
    ]
    df = spark.createDataFrame(data, "id string, url string, workspace_id string, status string, page_count int, chunk_count int, error string, created_at string")
    return df.withColumn("created_at", F.col("created_at").cast("timestamp"))


def test_intake(spark, spaces, sources):
    data = [
        ("n1", "http://a.b/9", "w1", "u1", 2),
        ("n2", "http://a.b/9", "w1", "u1", 1),
        ("n3", "http://a.b/1", "w1", "u1", 1),
        ("n4", "http://a.b/1", "w3", "u1", 1),
        ("n5", "http://a.b/5", "w1", "u2", 1),
        ("n6", "not a url", "w1", "u1", 1),
    ]
    requests = spark.createDataFrame(data, "id string, url string, workspace_id string, user_id string, created_at int")
    accepted, conflicts, rejected = tables.intake_sources(requests, spaces, sources)
    assert rows(accepted.select("id", "status")) == [("n2", "PENDING"), ("n4", "PENDING")]
    assert rows(conflicts.select("id")) == [("n1",), ("n3",)]
    assert rows(rejected.select("id", "errors")) == [("n5", ["workspace"]), ("n6", ["url"])]


def test_validation(spark):
    data = [("x" * 50, None), ("x" * 51, "d"), ("", "d" * 201), (None, "")]
    df = spark.createDataFrame(data, "name string, description string")
    good, bad = tables.split_valid(df, tables.workspace_errors(F.col("name"), F.col("description")))
    assert good.count() == 1
    assert sorted(r.errors for r in bad.collect()) == [["name"], ["name", "description"], ["name", "description"]]
    roles = spark.createDataFrame([("USER",), ("SYSTEM",), (None,)], "role string")
    assert tables.split_valid(roles, tables.role_errors(F.col("role")))[1].count() == 2
    states = spark.createDataFrame([("DONE",), ("done",)], "status string")
    assert tables.split_valid(states, tables.status_errors(F.col("status")))[0].count() == 1


def test_owned_by(spark, spaces, sources):
    asked = spark.createDataFrame([("u1",)], "user_id string")
    assert rows(tables.owned_by(sources, spaces, asked).select("id")) == [("s1",), ("s2",)]


def test_cascade(spark, spaces, sources):
    requests = spark.createDataFrame([("w1", "u1"), ("w2", "u1")], "workspace_id string, user_id string")
    messages = spark.createDataFrame([("m1", "w1"), ("m2", "w2")], "id string, workspace_id string")
    chunks = spark.createDataFrame([("c1", "s1"), ("c3", "s3")], "id string, source_id string")
    left = tables.cascade_delete_workspaces(requests, spaces, sources, messages, chunks)
    assert [rows(df.select("id")) for df in left] == [[("w2",), ("w3",)], [("s3",)], [("m2",)], [("c1",)]]
    asked = spark.createDataFrame([("s1", "u1"), ("s3", "u1")], "source_id string, user_id string")
    assert rows(tables.delete_sources(asked, sources, spaces).select("id")) == [("s2",), ("s3",)]


def test_reset(spark, spaces, sources):
    asked = spark.createDataFrame([("s2", "u1"), ("s3", "u1"), ("s2", "u1")], "source_id string, user_id string")
    got = {r.id: r for r in tables.reset_for_reindex(asked, sources, spaces).collect()}
    assert (got["s2"].status, got["s2"].error) == ("PENDING", None)
    assert (got["s3"].status, got["s3"].page_count) == ("DONE", 5) and len(got) == 3


def test_patches(spark, sources):
    data = [
        ("s1", 1, "FAILED", 9, "e1", None),
        ("s1", 2, None, None, None, ["error", "page_count"]),
        ("s1", 3, None, 11, None, None),
        ("s2", 1, None, None, None, ["error"]),
        ("zz", 1, "DONE", 1, "e", None),
    ]
    patches = spark.createDataFrame(data, "id string, seq int, status string, page_count int, error string, null_fields array<string>")
    got = tables.apply_patches(sources, patches, ["status", "page_count", "error"])
    assert rows(got.select("id", "status", "page_count", "chunk_count", "error")) == [
        ("s1", "FAILED", 11, 30, None),
        ("s2", "FAILED", None, None, None),
        ("s3", "DONE", 5, 50, None),
    ]


def test_workspace_patches_are_checked(spark):
    spaces = spark.createDataFrame([("w1", "u1", "One", "d"), ("w2", "u2", "Two", None)], "id string, user_id string, name string, description string")
    data = [
        ("w1", "u1", 1, "Uno", None, None),
        ("w1", "u2", 2, "Stolen", "x", None),
        ("w1", "u1", 3, None, None, ["description"]),
        ("w1", "u1", 4, "", None, None),
        ("w2", "u2", 1, "x" * 51, "y" * 201, None),
        ("w2", "u2", 2, None, None, ["name"]),
        ("w2", "u2", 3, None, "é" * 200, None),
        ("w9", "u1", 1, "None", None, None),
        (None, None, 1, "n", None, None),
    ]
    patches = spark.createDataFrame(data, "id string, user_id string, seq int, name string, description string, null_fields array<string>")
    patched, rejected = tables.patch_workspaces(patches, spaces)
    assert rows(patched) == [("w1", "u1", "Uno", None), ("w2", "u2", "Two", "é" * 200)]
    got = {(r.id, r.seq): r.errors for r in rejected.collect()}
    assert got == {("w1", 2): ["workspace"], ("w1", 4): ["name"], ("w2", 1): ["name", "description"], ("w2", 2): ["name"],
                   ("w9", 1): ["workspace"], (None, 1): ["workspace"]}
    empty, none = tables.patch_workspaces(patches.limit(0), spaces)
    assert rows(empty) == rows(spaces) and none.isEmpty()


def test_reports(spark, spaces, sources):
    messages = spark.createDataFrame([("m1", "w1"), ("m2", "w1")], "id string, workspace_id string")
    listed = reports.workspace_list(spaces, sources, "u1").collect()
    assert [(r.id, r.source_id, r.source_status) for r in listed] == [
        ("w3", None, None),
        ("w1", "s1", "DONE"),
        ("w1", "s2", "FAILED"),
    ]
    counts = reports.message_counts(spaces, messages, "u1").collect()
    assert {r.id: r.message_count for r in counts} == {"w1": 2, "w3": 0}
    asked = spark.createDataFrame([("w1", "u1"), ("w2", "u1")], "id string, user_id string")
    detail = reports.workspace_detail(spaces, sources, asked).collect()
    assert sorted((r.id, r.source_url) for r in detail) == [("w1", "http://a.b/1"), ("w1", "http://a.b/2")]
    mine = reports.source_list(sources, spaces, asked.withColumnRenamed("id", "workspace_id"))
    assert [r.id for r in mine.collect()] == ["s2", "s1"]


@pytest.mark.parametrize("n", [25, 25_000])
def test_large_workspace_has_the_same_row_form(spark, spaces, n):
    many = spark.range(n).select(F.concat(F.lit("x"), "id").alias("id"), F.lit("w1").alias("workspace_id"), F.lit("DONE").alias("status"))
    listed = reports.workspace_list(spaces, many, "u1")
    assert listed.columns == [*spaces.columns, "source_id", "source_status"]
    assert listed.where("id = 'w1'").select("source_id").distinct().count() == n


def test_intake_judges_each_row(spark, spaces, sources):
    requests = spark.createDataFrame(
        [("same", "http://n.ew/1", "w1", "u1", "2024-02-01"), ("same", "http://n.ew/1", "w1", "stranger", "2024-02-02"),
         (None, "http://n.ew/2", "w1", "u1", "2024-02-03"), (None, "http://n.ew/3", "w1", "stranger", "2024-02-03"),
         ("twice", "http://n.ew/4", "w1", "u1", "2024-02-04"), ("twice", "http://n.ew/4", "w1", "u1", "2024-02-04")],
        "id string, url string, workspace_id string, user_id string, created_at string")
    accepted, conflicts, rejected = tables.intake_sources(requests, spaces, sources)
    assert sorted(r.url for r in accepted.collect()) == ["http://n.ew/1", "http://n.ew/2", "http://n.ew/4"]
    assert all(r.id for r in accepted.collect())
    assert [r.url for r in conflicts.collect()] == ["http://n.ew/4"]
    assert sorted((r.url, r.user_id) for r in rejected.collect()) == [("http://n.ew/1", "stranger"), ("http://n.ew/3", "stranger")]


def test_equal_versions_are_decided_alike(spark):
    log = spark.createDataFrame([("a", "s", f"text {k}", 1) for k in range(20)], "id string, source_id string, child_text string, version int")
    got = {tuple(tables.latest_chunks(log.repartition(n)).first()) for n in (1, 3, 8)}
    assert len(got) == 1
