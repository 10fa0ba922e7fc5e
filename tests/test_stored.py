import os

import pytest
from pyspark.sql import functions as F

from conftest import rows
from gleanloom.operators import tables
from gleanloom.sources import stored
from gleanloom.sources.tables import read_by_workspace

CHUNK = "id string, workspace_id string, source_id string, page_url string, page_title string, section_heading string, child_text string, parent_text string"


def chunk(k, room, version=0, source="s", text="t"):
    return (f"c{k}", room, source, f"url{version}", f"title{version}", "h", f"{text}{version}", "p", version)


def files_of(path):
    found = {}
    for top, _, names in os.walk(path):
        for name in names:
            if name.endswith(".parquet"):
                found.setdefault(os.path.basename(top), []).append((name, os.stat(f"{top}/{name}").st_mtime_ns))
    return {room: sorted(own) for room, own in found.items()}


def frame(spark, data):
    return spark.createDataFrame(data, CHUNK + ", version int")


def test_upserts_touch_their_workspaces_only(spark, tmp_path):
    path = str(tmp_path / "chunks")
    first = [chunk(k, room) for k, room in enumerate(["a", "a", "b", "c/d", "c/d", "e f"])]
    stored.store_chunks(spark, path, frame(spark, first))
    before = files_of(path)
    assert len(before) == 4
    # a changed chunk that names another workspace stays where it is; a new one comes twice
    updates = [chunk(2, "a", 1, "other"), chunk(9, "new", 1, "x"), chunk(9, "new", 2, "y")]
    stored.store_chunks(spark, path, frame(spark, updates))
    after = files_of(path)
    assert set(after) == set(before) | {"workspace_id=new"}
    assert after["workspace_id=c%2Fd"] == before["workspace_id=c%2Fd"] and after["workspace_id=e f"] == before["workspace_id=e f"]
    assert after["workspace_id=b"] != before["workspace_id=b"]
    table = read_by_workspace(spark, path, CHUNK)
    want = tables.merge_chunks(frame(spark, first).drop("version"), frame(spark, updates))
    assert rows(table.select(want.columns)) == rows(want)
    got = {r.id: r for r in table.collect()}
    assert (got["c2"].workspace_id, got["c2"].source_id, got["c2"].child_text) == ("b", "s", "t1")
    assert (got["c9"].source_id, got["c9"].page_url, got["c9"].child_text) == ("x", "url1", "t2")
    # the same updates again change no row
    stored.store_chunks(spark, path, frame(spark, updates))
    assert rows(read_by_workspace(spark, path, CHUNK).select(want.columns)) == rows(want)


def test_vectors_are_replaced_as_a_whole(spark, tmp_path, no_broadcast):
    path, schema = str(tmp_path / "vectors"), "chunk_id string, workspace_id string, source_id string, embedding array<float>"
    make = lambda data: spark.createDataFrame(data, schema + ", version int")
    stored.store_vectors(spark, path, make([("1", "a", "s", [1.0, 2.0], 0), ("1", "b", "s", [3.0], 0), ("2", "c", "s", [4.0], 0)]))
    before = files_of(path)
    stored.store_vectors(spark, path, make([("1", "a", "t", [9.0], 1), ("1", "a", "u", [8.0, 7.0], 2), ("5", "b", "s", [5.0], 1)]))
    assert files_of(path)["workspace_id=c"] == before["workspace_id=c"]
    got = {(r.workspace_id, r.chunk_id): (r.source_id, r.embedding) for r in read_by_workspace(spark, path, schema).collect()}
    assert got == {("a", "1"): ("u", [8.0, 7.0]), ("b", "1"): ("s", [3.0]), ("b", "5"): ("s", [5.0]), ("c", "2"): ("s", [4.0])}


def test_dropped_workspaces_leave_other_files(spark, tmp_path):
    path = str(tmp_path / "chunks")
    stored.store_chunks(spark, path, frame(spark, [chunk(k, room) for k, room in enumerate(["a", "b", "c/d", "e f"])]))
    before = files_of(path)
    asked = spark.createDataFrame([("a",), ("c/d",), ("nowhere",), (None,), ("a",)], "workspace_id string")
    assert stored.drop_workspaces(spark, path, asked) == 2
    assert files_of(path) == {room: own for room, own in before.items() if room in ("workspace_id=b", "workspace_id=e f")}
    assert {r.workspace_id for r in read_by_workspace(spark, path, CHUNK).collect()} == {"b", "e f"}
    assert stored.drop_workspaces(spark, str(tmp_path / "none"), asked) == 0


def test_rows_without_workspace_are_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        stored.store_chunks(spark, str(tmp_path / "x"), frame(spark, [chunk(1, None)]))
    assert not stored.table_exists(spark, str(tmp_path / "x"))


def test_staged_copies_are_removed(spark, tmp_path):
    from gleanloom.scale import shared_dir

    stored.store_chunks(spark, str(tmp_path / "chunks"), frame(spark, [chunk(1, "a")]).withColumn("page_title", F.lit("x")))
    folder = shared_dir(spark).removeprefix("file:")
    assert not [name for name in os.listdir(folder) if name.startswith("staged-")]


def test_rows_are_dealt_once_per_upsert(spark, tmp_path, monkeypatch):
    path, plans = str(tmp_path / "chunks"), []
    dealt = stored.write_by_workspace
    monkeypatch.setattr(stored, "write_by_workspace", lambda df, to, **how: plans.append((to, how.get("gathered", False))) or dealt(df, to, **how))
    stored.store_chunks(spark, path, frame(spark, [chunk(0, "a"), chunk(1, "b")]))
    assert plans == [(path, False)]
    stored.store_chunks(spark, path, frame(spark, [chunk(0, "a", 1), chunk(2, "c", 1)]))
    assert [(to == path, gathered) for to, gathered in plans[1:]] == [(False, False), (True, True)]
    assert sorted(r[0] for r in read_by_workspace(spark, path, CHUNK).select("id").collect()) == ["c0", "c1", "c2"]
