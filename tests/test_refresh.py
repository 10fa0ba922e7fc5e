"""Incremental reindexing against a full rebuild."""

import pytest
from pyspark.sql import functions as F

from conftest import rows
from gleanloom.operators import embedding
from gleanloom.plans import ingest, refresh

PAGES = "page_id long, url string, html string"
SOURCES = "source_id string, workspace_id string, url string"


def html(*paragraphs):
    body = "".join(f"<h2>Part {i}</h2><p>{p}</p>" for i, p in enumerate(paragraphs))
    return f"<html><head><title>T</title></head><body><article>{body}</article></body></html>"


def text(word, n=30):
    return " ".join(f"{word}{i}" for i in range(n)) + "."


BEFORE = {
    "http://a.org/same": html(text("same"), text("more")),
    "http://a.org/edited": html(text("kept"), text("old")),
    "http://a.org/gone": html(text("gone")),
    "http://a.org/thin": html("too little"),
    "http://a.org/null": None,
    "http://b.org/x": html(text("other")),
}
AFTER = {
    "http://a.org/same": BEFORE["http://a.org/same"],
    "http://a.org/edited": html(text("kept"), text("new"), text("kept")),
    "http://a.org/added": html(text("added"), text("gone")),
    "http://a.org/thin": html("too little", text("now enough")),
    "http://a.org/null": "",
    "http://b.org/x": html(text("unseen")),
}


def captures(spark, state):
    return spark.createDataFrame([(i, url, page) for i, (url, page) in enumerate(state.items())], PAGES)


@pytest.fixture
def sources(spark):
    return spark.createDataFrame([("s1", "w", "http://a.org/"), ("s2", "v", "http://b.org/"), ("s3", "v", "http://c.org/")], SOURCES)


@pytest.fixture
def model(spark, sources):
    return embedding.fit_embedder(ingest.ingest(captures(spark, BEFORE), sources).chunks, "child_text", width=16)


def assert_same(got, want):
    for name in ("pages", "parents", "chunks", "vectors"):
        one, other = getattr(got, name), getattr(want, name)
        assert one.columns == other.columns
        assert rows(one) == rows(other), name


@pytest.mark.parametrize("small", [True, False])
def test_refresh_equals_a_full_rebuild(spark, sources, model, small, request):
    if not small:
        request.getfixturevalue("no_broadcast")
    first, _ = refresh.refresh(None, captures(spark, BEFORE), sources, model)
    second, work = refresh.refresh(first, captures(spark, AFTER), sources, model)
    rebuilt, _ = refresh.refresh(None, captures(spark, AFTER), sources, model)
    assert_same(second, rebuilt)
    plain = ingest.ingest(captures(spark, AFTER), sources)
    assert rows(second.chunks) == rows(plain.chunks)
    assert rows(second.vectors) == rows(ingest.embed_chunks(plain.chunks, model).select(*second.vectors.columns))
    got = {r.source_id: tuple(r[c] for c in ("n_pages", "n_changed", "n_gone", "n_cut", "n_reused", "n_embedded")) for r in work.collect()}
    changed = {url for url in AFTER if url not in BEFORE or BEFORE[url] != AFTER[url]}
    stale = {url for url in BEFORE if url not in AFTER or BEFORE[url] != AFTER[url]}
    known = {(c.workspace_id, c.child_text) for c in first.chunks.collect() if c.page_url in stale}
    for source, pages in [("s1", (5, 4, 1)), ("s2", (1, 1, 0)), ("s3", (0, 0, 0))]:
        cut = [(c.workspace_id, c.child_text) for c in second.chunks.collect() if c.source_id == source and c.page_url in changed]
        reused = sum(c in known for c in cut)
        assert got[source] == (*pages, len(cut), reused, len(cut) - reused)
    assert got["s1"][4] > 0


def test_nothing_to_do(spark, sources, model):
    first, built = refresh.refresh(None, captures(spark, BEFORE), sources, model)
    again, work = refresh.refresh(first, captures(spark, BEFORE), sources, model)
    assert_same(again, first)
    done = work.agg(*[F.sum(c).alias(c) for c in ("n_pages", "n_changed", "n_gone", "n_cut", "n_embedded")]).first()
    assert tuple(done) == (6, 0, 0, 0, 0)
    assert built.agg(F.sum("n_embedded")).first()[0] == first.vectors.count()


def test_only_asked_sources_change(spark, sources, model):
    first, _ = refresh.refresh(None, captures(spark, BEFORE), sources, model)
    one = sources.where("source_id = 's2'")
    second, _ = refresh.refresh(first, captures(spark, AFTER), one, model)
    for name in ("pages", "parents", "chunks", "vectors"):
        old, new = getattr(first, name), getattr(second, name)
        assert rows(new.where("source_id = 's1'")) == rows(old.where("source_id = 's1'"))
        assert rows(new.where("source_id = 's2'")) != rows(old.where("source_id = 's2'"))
    emptied, work = refresh.refresh(second, captures(spark, AFTER).limit(0), one, model)
    assert emptied.chunks.where("source_id = 's2'").isEmpty() and emptied.vectors.where("source_id = 's2'").isEmpty()
    assert not emptied.chunks.isEmpty() and [tuple(r)[3:5] for r in work.collect()] == [(0, 1)]


def test_other_options_cut_all_pages_again(spark, sources, model):
    first, _ = refresh.refresh(None, captures(spark, BEFORE), sources, model)
    second, work = refresh.refresh(first, captures(spark, BEFORE), sources, model, splitter="window")
    rebuilt, _ = refresh.refresh(None, captures(spark, BEFORE), sources, model, splitter="window")
    assert_same(second, rebuilt)
    assert work.agg(F.sum("n_changed")).first()[0] == 6
    with pytest.raises(ValueError):
        refresh.refresh(first, captures(spark, BEFORE), sources, model, id_scheme="reference")
