import json

from conftest import rows
from pyspark.sql import functions as F

from gleanloom.operators import chunking, embedding
from gleanloom.plans.ingest import clean_pages
from gleanloom.sources.model import PAGES
from gleanloom.streaming import ingest as stream_tables
from gleanloom.streaming import stages, status
from gleanloom.streaming.sinks import latest_by, read_epochs, write_epochs


def file_stream(spark, tmp_path, batches, schema):
    """One file per micro-batch."""
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(f"{tmp_path}/in/b={i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")


def run(spark, stream, tmp_path, schema, **options):
    for _ in range(2):  # a second start finds nothing new
        write_epochs(stream, f"{tmp_path}/out", f"{tmp_path}/progress", **options).awaitTermination()
    return read_epochs(spark, f"{tmp_path}/out", schema)


def test_status_latest(spark, tmp_path):
    batches = [[(1, "a", "PENDING", 10), (2, "b", "PENDING", 11)], [(3, "a", "DONE", 30), (4, "a", "CHUNKING", 20)], [(5, "b", "FAILED", 11)]]
    stream = file_stream(spark, tmp_path, batches, "event_id long, source_id string, status string, ts long")
    log = run(spark, status.status_latest(stream), tmp_path, "source_id string, status string, ts long", mode="update")
    assert rows(latest_by(log, "source_id")) == [("a", "DONE", 30), ("b", "FAILED", 11)]


def test_dedup(spark, tmp_path):
    batches = [[("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:01:00"), ("b", "2024-01-01 00:02:00")], [("a", "2024-01-01 00:03:00"), ("c", "2024-01-01 00:04:00")]]
    stream = file_stream(spark, tmp_path, batches, "source_id string, ts string").withColumn("ts", F.to_timestamp("ts"))
    log = run(spark, status.dedup_requests(stream, "1 day"), tmp_path, "source_id string, ts timestamp")
    assert rows(log.select("source_id")) == [("a",), ("b",), ("c",)]


def test_route_and_quarantine(spark, tmp_path):
    good = json.dumps({"workspaceId": "w1", "sourceId": "s", "status": "DONE", "pageCount": 3, "extra": 1})
    foreign = json.dumps({"workspaceId": "w9", "sourceId": "s", "status": "DONE"})
    data = [[("source:status", good), ("other", good)], [("source:status", foreign), ("source:status", "{broken"), ("source:status", '{"status":"DONE"}')]]
    stream = file_stream(spark, tmp_path, data, "channel string, value string")
    rooms = spark.createDataFrame([("w1", "u1"), ("w1", "u2"), ("w2", "u1")], "workspace_id string, user_id string")
    schema = "workspace_id string, user_id string, source_id string, status string, page_count int, chunk_count int, error string"
    log = run(spark, status.status_route(stream, rooms), tmp_path, schema)
    assert rows(log.drop("epoch")) == [("w1", "u1", "s", "DONE", 3, None, None), ("w1", "u2", "s", "DONE", 3, None, None)]
    bad = status.quarantine(spark.read.schema("channel string, value string").parquet(f"{tmp_path}/in/*"))
    assert rows(bad) == [('{"status":"DONE"}',), ("{broken",)]


def test_page_progress(spark, tmp_path):
    long = "x" * 101
    batches = [[("a", long, False), ("a", "short", False)], [("a", long, False), ("b", long, True), ("c", long, False)]]
    stream = file_stream(spark, tmp_path, batches, "source_id string, content string, failed boolean")
    log = run(spark, status.page_progress(stream), tmp_path, "source_id string, page_count long", mode="update")
    assert log.count() == 3  # a twice, c once
    assert rows(latest_by(log, "source_id")) == [("a", 2), ("c", 1)]


def test_stream_tables_equal_batch(spark, tmp_path):
    def html(i):
        return f"<title>t{i}</title><article>" + f"Sentence {i} is here. " * 60 + "</article>"

    batches = [[(i, f"https://a.example.com/{i}", html(i)) for i in range(3)], [(i, f"https://b.example.com/{i}", html(i)) for i in (1, 4)], [(9, "https://a.example.com/0", html(0))]]
    stream = file_stream(spark, tmp_path, batches, PAGES)
    sources = spark.createDataFrame([("s", "w", "https://example.com")], "source_id string, workspace_id string, url string")
    for _ in range(2):
        stream_tables.stream_chunks(stream, sources, f"{tmp_path}/chunks", f"{tmp_path}/p1").awaitTermination()
    current = stream_tables.current_chunks(spark, f"{tmp_path}/chunks")
    pages = spark.createDataFrame([row for batch in batches for row in batch], PAGES)
    good = clean_pages(pages, sources).where("drop_reason is null")
    _, chunks = chunking.chunk_hierarchy(good)
    assert rows(current.select(*chunks.columns)) == rows(chunks)

    model = embedding.fit_embedder(chunks, "child_text", width=16)
    stream_tables.stream_vectors(f"{tmp_path}/chunks", spark, model, f"{tmp_path}/vectors", f"{tmp_path}/p2").awaitTermination()
    vectors = stream_tables.current_vectors(spark, f"{tmp_path}/vectors")
    assert rows(vectors.select("chunk_id")) == rows(chunks.select("id"))


def test_stages_of_each_run(spark, tmp_path):
    """A failing source, one that comes back after its pause, a late start of chunks, and one that still runs at the end."""
    at = lambda minutes: f"2024-01-01 {minutes // 60:02d}:{minutes % 60:02d}:00"
    page = lambda source, minutes, failed=False, reason=None, n=0: (source, at(minutes), failed, reason, n)
    batches = [[page("bad", 0, True), page("bad", 5, False, "short"), page("good", 1, False, "short"), page("good", 2, n=3)],
               [page("good", 10, n=4), page("back", 12), page(None, 13, None)],
               [page("back", 200, n=1), page("good", 201, n=2), page("late", 400)],
               [page("late", 401, n=5)]]
    stream = file_stream(spark, tmp_path, batches, "source_id string, ts string, failed boolean, drop_reason string, n_chunks long")
    events = stages.source_stages(stream.withColumn("ts", F.to_timestamp("ts")), "10 minutes", 3600)
    log = run(spark, events, tmp_path, stages.EVENTS.replace("at BIGINT", "ts TIMESTAMP"))
    got = {}
    for r in log.orderBy("run", "step").collect():
        got.setdefault(r.source_id, []).append((r.status, r.pages, r.chunks, r.error, r.ts.strftime("%H:%M")))
    assert got == {
        "bad": [("SCRAPING", 0, 0, None, "00:00"), ("FAILED", 2, 0, "all pages failed: 2", "01:05")],
        "good": [("SCRAPING", 0, 0, None, "00:01"), ("CHUNKING", 2, 3, None, "00:02"), ("EMBEDDING", 2, 3, None, "00:02"), ("DONE", 3, 7, None, "01:10"),
                 ("SCRAPING", 0, 0, None, "03:21"), ("CHUNKING", 1, 2, None, "03:21"), ("EMBEDDING", 1, 2, None, "03:21"), ("DONE", 1, 2, None, "04:21")],
        "back": [("SCRAPING", 0, 0, None, "00:12"), ("CHUNKING", 1, 0, None, "00:12"), ("DONE", 1, 0, None, "01:12"),
                 ("SCRAPING", 0, 0, None, "03:20"), ("CHUNKING", 1, 1, None, "03:20"), ("EMBEDDING", 1, 1, None, "03:20"), ("DONE", 1, 1, None, "04:20")],
        "late": [("SCRAPING", 0, 0, None, "06:40"), ("CHUNKING", 1, 0, None, "06:40"), ("EMBEDDING", 2, 5, None, "06:41")],
        None: [("SCRAPING", 0, 0, None, "00:13"), ("FAILED", 1, 0, "all pages failed: 1", "01:13")],
    }


def test_request_runs_expire(spark, tmp_path):
    """Repeats within a run, a source that returns, one that is still open, a late row, rows without time or source."""
    at = lambda minutes: f"2024-01-01 {minutes // 60:02d}:{minutes % 60:02d}:00"
    batches = [[("a", at(0)), ("a", at(5)), ("b", at(2)), (None, at(3)), ("a", None)],
               [("a", at(15)), ("c", at(120))],
               [("a", at(121))],
               [("c", at(240)), ("c", at(240)), ("b", at(1))]]
    stream = file_stream(spark, tmp_path, batches, "source_id string, ts string").withColumn("ts", F.to_timestamp("ts"))
    query = write_epochs(status.request_runs(stream, "1 minute", "30 minutes"), f"{tmp_path}/out", f"{tmp_path}/progress")
    query.awaitTermination()
    log = read_epochs(spark, f"{tmp_path}/out", "source_id string, first_ts timestamp, last_ts timestamp, n_requests long")
    got = sorted((str(r.source_id), r.first_ts.strftime("%H:%M"), r.last_ts.strftime("%H:%M"), r.n_requests) for r in log.collect())
    assert got == [("None", "00:03", "00:03", 1), ("a", "00:00", "00:15", 3), ("a", "02:01", "02:01", 1), ("b", "00:02", "00:02", 1), ("c", "02:00", "02:00", 1)]
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 1  # the open run of c; all others have expired


def test_page_progress_with_horizon(spark, tmp_path):
    """A URL counts again after the horizon, and its state is gone by then."""
    long = "x" * 101
    page = lambda url, hour: ("a", url, f"2024-01-01 {hour:02d}:00:00", long, False)
    batches = [[page("u", 0), page("v", 0)], [page("u", 1)], [page("w", 10)], [page("x", 11)], [page("u", 12)]]
    stream = file_stream(spark, tmp_path, batches, "source_id string, url string, ts string, content string, failed boolean")
    counted = status.page_progress(stream.withColumn("ts", F.to_timestamp("ts")), "2 hours")
    query = write_epochs(counted, f"{tmp_path}/out", f"{tmp_path}/progress", mode="update")
    query.awaitTermination()
    assert rows(latest_by(read_epochs(spark, f"{tmp_path}/out", "source_id string, page_count long"), "source_id")) == [("a", 5)]
    remembered = [o["numRowsTotal"] for o in query.lastProgress["stateOperators"] if o["operatorName"].startswith("dedupe")]
    assert remembered == [3]  # w, x and u
