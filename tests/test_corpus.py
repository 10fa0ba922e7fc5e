import random
import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from gleanloom.functions.splitter import PARENT_LEVEL, split_text
from gleanloom.operators import chunking, cleaning, crawl, embedding
from gleanloom.plans import ingest
from gleanloom.scale import cut_lineage

SITE = "https://www.site.example.com"
LINKS = {
    "/docs": ["/docs/a", "/docs2", "https://blog.site.example.com/docs/x", "https://other.org/docs", "/docs/api/x",
              "/docs/f.pdf", "#frag", "mailto:a@b.c", "//cdn.site.example.com/docs/y"],
    "/docs/a": ["../docs", "b", "/blog"],
    "/docs/b": ["a"],
    "/docs2": [],
    "/blog": ["/docs"],
}


def page(links, body="word " * 40):
    anchors = "".join(f"<a href='{x}'>l</a>" for x in links)
    return f"<html><head><title>T</title></head><body><nav>{anchors}</nav><article><p>{body}</p></article></body></html>"


@pytest.fixture
def pages(spark):
    data = [(i, SITE + path, page(links)) for i, (path, links) in enumerate(LINKS.items())]
    return spark.createDataFrame([*data, (9, SITE + "/docs", "again"), (10, None, "x")], "page_id long, url string, html string")


def test_scan(pages, spark):
    assert [r.page_id for r in crawl.scan_pages(pages).orderBy("page_id").collect()] == [0, 1, 2, 3, 4]


def test_scan_without_broadcast(pages, no_broadcast):
    assert crawl.scan_pages(pages).count() == 5


def test_links_and_walk(spark, pages):
    links = crawl.extract_links(crawl.scan_pages(pages))
    admitted = crawl.filter_links(links, "/docs")
    got = {r.dst for r in admitted.collect()}
    assert SITE + "/docs2" in got and "https://other.org/docs" in got
    assert not any(x in u for u in got for x in ("api", ".pdf", "#", "mailto", SITE + "/blog"))
    near = {r.dst for r in crawl.filter_links(links, "/docs", same_domain=True).collect()}
    assert got - near == {"https://other.org/docs"}
    roots = spark.createDataFrame([("s", SITE + "/docs")], "source_id string, url string")
    walked = crawl.reachable_pages(roots, admitted, crawl.MAX_PAGES, captured=pages)
    assert rows(walked.select("url", "depth")) == [
        (SITE + "/docs", 0), (SITE + "/docs/a", 1), (SITE + "/docs/b", 2), (SITE + "/docs2", 1)
    ]


def test_walk_limit(spark):
    star = [("r", f"p{i:03d}") for i in range(120)] + [(f"p{i:03d}", f"deep{i:03d}") for i in range(120)]
    links = spark.createDataFrame([*star, ("x", "y"), ("y", "x"), ("y", "z")], "src string, dst string")
    roots = spark.createDataFrame([("s", "r"), ("t", "x")], "source_id string, url string")
    walked = crawl.reachable_pages(roots, links, crawl.MAX_PAGES)
    got = rows(walked.where("source_id = 's'").select("url"))
    assert [u for (u,) in got] == [*(f"p{i:03d}" for i in range(99)), "r"]
    assert rows(walked.where("source_id = 't'").select("url", "depth")) == [("x", 0), ("y", 1), ("z", 2)]


def test_walk_with_links_per_source(spark):
    links = spark.createDataFrame([("s", "a", "b"), ("t", "a", "c")], "source_id string, src string, dst string")
    roots = spark.createDataFrame([("s", "a"), ("t", "a")], "source_id string, url string")
    assert rows(crawl.reachable_pages(roots, links, crawl.MAX_PAGES).where("depth = 1").select("source_id", "url")) == [("s", "b"), ("t", "c")]


def test_scope(spark, pages):
    sources = spark.createDataFrame(
        [("s1", "https://site.example.com/docs"), ("s2", "https://blog.example.com"), ("s3", "http://other.org/")],
        "source_id string, url string",
    )
    placed = crawl.scope_pages(crawl.scan_pages(pages).select("page_id", "url"), sources)
    assert rows(placed.select("source_id", "page_id")) == [
        *[("s1", i) for i in range(4)], *[("s2", i) for i in range(5)]
    ]
    suffixes = spark.createDataFrame([("example.com",), ("org",), ("com",)], "suffix string")
    narrow = crawl.scope_pages(pages.where("url is not null").select("page_id", "url"), sources, suffixes)
    assert {r.source_id for r in narrow.collect()} == {"s1"}


HEADINGS = {
    "start": "# One\ntext\n## Two\nmore",
    "preamble": "intro\n# One\ntext",
    "four": "#### no\n# yes\nx",
    "nospace": "#no\n# yes\nx",
    "last": "x\n### Last",
    "empty": "",
    "blank": "  \n# H\nx",
    "spans": "#\n\n\nTitle\nbody",
    "mark": "a\u0001b\n# H",
}
SECTIONS = {
    "start": [("One", "# One\ntext"), ("Two", "## Two\nmore")],
    "preamble": [("", "intro"), ("One", "# One\ntext")],
    "four": [("", "#### no"), ("yes", "# yes\nx")],
    "nospace": [("", "#no"), ("yes", "# yes\nx")],
    "last": [("", "x"), ("Last", "### Last")],
    "empty": [("", "")],
    "blank": [("", ""), ("H", "# H\nx")],
    "spans": [("Title", "#\n\n\nTitle\nbody")],
    "mark": [("", "ab"), ("H", "# H")],
}


def test_sections(spark):
    df = spark.createDataFrame(list(HEADINGS.items()), "name string, content string")
    got = {}
    for r in chunking.split_sections(df).orderBy("name", "section_index").collect():
        got.setdefault(r.name, []).append((r.heading, r.text))
    assert got == SECTIONS


def text_pages(spark, texts):
    data = [("s", "w", f"u{i}", f"title {i}", t) for i, t in enumerate(texts)]
    return spark.createDataFrame(data, "source_id string, workspace_id string, page_url string, page_title string, content string")


def test_hierarchy(spark):
    same = "equal words in both sections. " * 20
    long = "".join(f"Sentence number {i} of this page. " for i in range(200))
    texts = [f"# A\n{same}\n# B\n{same}", long, "x" * 49, "y" * 50, "# T\n" + "z" * 2000, "intro\n# H\n" + "w" * 60]
    parents, chunks = chunking.chunk_hierarchy(text_pages(spark, texts))
    assert chunking.id_collisions(chunks).isEmpty()
    assert parents.count() == parents.select("parent_id").distinct().count()
    joined = chunks.join(parents.select("parent_id", "parent_text"), "parent_id").collect()
    assert joined and all(r.child_text in r.parent_text and len(r.child_text) <= 300 for r in joined)
    assert all(len(r.parent_text) <= 1500 for r in parents.collect())
    assert {r.page_url for r in joined} == {"u0", "u1", "u3", "u4", "u5"}
    assert {r.section_heading for r in joined if r.page_url in ("u3", "u5")} == {"title 3", "H"}
    wanted = split_text(long.strip(), PARENT_LEVEL)
    assert [r.parent_text for r in parents.where("page_url = 'u1'").orderBy("parent_index").collect()] == wanted
    _, old = chunking.chunk_hierarchy(text_pages(spark, [f"# A\n{same}\n# A\n{same}"]), id_scheme="reference")
    assert not chunking.id_collisions(old).isEmpty()


def test_gate(spark):
    data = [(1, "x" * 100, False), (2, "x" * 101, False), (3, "x" * 500, True), (4, "", False), (5, None, False)]
    df = spark.createDataFrame(data, "i int, content string, failed boolean")
    assert [r.i for r in cleaning.quality_gate(df).collect()] == [2]
    assert {r.i: r.drop_reason for r in cleaning.audit_pages(df).collect()} == {
        1: "short", 2: None, 3: "failed", 4: "empty", 5: "empty"
    }


def test_outcome_and_counts(spark):
    data = [("a", "u1", True, "failed"), ("a", "u2", True, "failed"), ("b", "u3", True, "failed"), ("b", "u4", False, None)]
    df = spark.createDataFrame(data, "source_id string, page_url string, failed boolean, drop_reason string")
    assert rows(cleaning.source_outcome(df).select("source_id", "status", "error")) == [
        ("a", "FAILED", "all pages failed: 2"), ("b", "DONE", None)
    ]
    good, failed = cleaning.split_failures(df)
    assert (good.count(), failed.count()) == (1, 3)
    sources = spark.createDataFrame([("a",), ("b",), ("c",)], "source_id string")
    chunks = spark.createDataFrame([("b", 1), ("b", 2)], "source_id string, x int")
    assert rows(chunking.chunk_counts(sources, df, chunks)) == [("a", 0, 2, 0), ("b", 1, 2, 2), ("c", 0, 0, 0)]


def test_embedding(spark):
    df = spark.createDataFrame([("1", "spark joins\ntables"), ("2", "tables of words"), ("3", "")], "id string, child_text string")
    model = embedding.fit_embedder(df, "child_text", width=32)
    got = {r.id: r.embedding for r in embedding.embed_texts(df, "child_text", model).collect()}
    assert all(len(v) == 32 for v in got.values()) and not any(got["3"])
    assert sum(x * x for x in got["1"]) == pytest.approx(1, abs=1e-5)
    own = embedding.embed_texts(df, "child_text", lambda x: F.array(F.length(x).cast("float")))
    assert {r.id: r.embedding for r in own.collect()} == {"1": [18.0], "2": [15.0], "3": [0.0]}
    vectors = spark.createDataFrame([("1", [1.0]), ("9", [2.0])], "chunk_id string, embedding array<float>")
    paired, missing = embedding.attach_vectors(df, vectors)
    assert rows(paired.select("id")) == [("1",)] and rows(missing.select("id")) == [("2",), ("3",)]
    assert rows(embedding.vector_widths(vectors)) == [(1, 2)]


def test_ingest_and_reindex(spark, pages):
    sources = spark.createDataFrame([("s1", "w", SITE + "/docs"), ("s9", "w", "http://empty.org/")], "source_id string, workspace_id string, url string")
    done = ingest.ingest(pages, sources)
    outcome = {r.source_id: (r.pages_indexed, r.pages_visited, r.chunk_count) for r in done.outcome.collect()}
    assert outcome == {"s1": (4, 4, 4), "s9": (0, 0, 0)}
    model = embedding.fit_embedder(done.chunks, "child_text", width=16)
    vectors = ingest.embed_chunks(done.chunks, model)
    again, parents, again_vectors = ingest.reindex(done.chunks, done.parents, vectors, pages, sources, model)
    assert rows(again) == rows(done.chunks)
    assert rows(parents) == rows(done.parents)
    assert rows(again_vectors.select("chunk_id", "embedding")) == rows(vectors.select("chunk_id", "embedding"))


def test_scan_keeps_one_row_of_equal_and_missing_ids(spark):
    pages = spark.createDataFrame(
        [(1, "u", "b"), (1, "u", "a"), (1, "u", "a"), (None, "v", "y"), (None, "v", "x"), (None, "w", None), (7, "v", "late"), (None, None, "n")],
        "page_id long, url string, html string")
    assert rows(crawl.scan_pages(pages)) == rows(spark.createDataFrame([(1, "u", "a"), (7, "v", "late"), (None, "w", None)], pages.schema))


def test_links_are_those_of_anchors(spark):
    html = """<link href="/x"><a data-href="/y">t</a><!-- <a href="/c">c</a> --><script>'<a href="/s">'</script><A
      class="k" HREF='/ok'>ok</A><a href="/two">2</a>"""
    pages = spark.createDataFrame([(1, "http://h.example/", html), (2, "http://h.example/", None)], "page_id long, url string, html string")
    assert [r.href for r in crawl.extract_links(pages).collect()] == ["/ok", "/two"]


def test_walk_without_limit_and_cut_sources(spark):
    links = spark.createDataFrame([(f"p{k}", f"p{k + 1}") for k in range(12)], "src string, dst string")
    roots = spark.createDataFrame([("s", "p0"), ("t", "p9")], "source_id string, url string")
    assert crawl.reachable_pages(roots, links, limit=None).where("source_id = 's'").count() == 13
    walked = crawl.reachable_pages(roots, links, limit=4)
    assert rows(crawl.cut_sources(walked, links, 4)) == [("s", 4, True), ("t", 4, False)]


def test_broken_html_takes_linear_time(spark):
    import time

    n = 2_000_000
    broken = ["<form>" * (n // 6), "<!-- x" * (n // 6), "<a href='x' " * (n // 12), "<article>" * (n // 9), "<div class='ad'" * (n // 15), "<title>" * (n // 7)]
    for html in broken:
        pages = spark.createDataFrame([(1, "http://h.example/", html)], "page_id long, url string, html string")
        start = time.monotonic()
        cleaning.extract_content(pages).collect()
        crawl.extract_links(pages).collect()
        assert time.monotonic() - start < 20


def test_unknown_outcome_is_a_failed_page(spark):
    pages = spark.createDataFrame([("x" * 200, None), ("x" * 200, False)], "content string, failed boolean")
    assert cleaning.quality_gate(pages).count() == 1
    assert [r.drop_reason for r in cleaning.audit_pages(pages).collect()] == ["failed", None]


def test_many_roots_on_one_domain(spark, no_broadcast):
    """Ten thousand roots: pages meet those that hold them by hash, with no prefix left to test."""
    sources = spark.range(10_000).select(F.concat(F.lit("s"), "id").alias("source_id"), F.concat(F.lit("https://big.example.com/r"), "id").alias("url"))
    pages = spark.range(3_000).select(F.col("id").alias("page_id"), F.concat(F.lit("https://www.example.com/r"), F.col("id") * 7, F.lit("/x")).alias("url"))
    scoped = crawl.scope_pages(pages, sources)
    plan = scoped._jdf.queryExecution().executedPlan().toString()
    assert "StartsWith" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    want = sum(1 for k in range(3_000) for n in range(1, len(str(k * 7)) + 1) if str(k * 7)[:n] == str(int(str(k * 7)[:n])) and int(str(k * 7)[:n]) < 10_000)
    assert scoped.count() == want


def test_broadcast_and_shuffled_roots_agree(spark):
    sources = spark.createDataFrame([("a", "http://h.org/"), ("b", "http://h.org/docs"), ("c", "http://h.org/docs"), ("d", "no url"), ("e", None), ("f", "http://x.h.org/d?q")],
                                    "source_id string, url string")
    pages = spark.createDataFrame([(1, "http://h.org/docs2"), (2, "http://h.org"), (3, "http://x.h.org/docs"), (4, "http://o.org/docs"), (5, None), (1, "http://h.org/docs2")],
                                  "page_id long, url string")
    few = rows(crawl.scope_pages(pages, sources))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert rows(crawl.scope_pages(pages, sources)) == few
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
    assert [(r[0], r[2], r[3]) for r in few if r[0] == 1] == [(1, s, p) for s, p in (("a", "/"), ("b", "/docs"), ("c", "/docs"), ("f", "/d")) for _ in (0, 1)]
    assert {(r[0], r[2]) for r in few} == {(1, "a"), (1, "b"), (1, "c"), (1, "f"), (2, "a"), (3, "a"), (3, "b"), (3, "c"), (3, "f")}


def test_hub_under_many_sources(spark):
    """A page of 100,000 links under 1,000 sources: each source takes the smallest targets, and the walk never meets all links."""
    hub = spark.range(100_000).select(F.lit("hub").alias("src"), F.concat(F.lit("p"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("dst"))
    entry = spark.range(1_000).select(F.concat(F.lit("e"), "id").alias("src"), F.lit("hub").alias("dst"))
    back = spark.range(50).select(F.concat(F.lit("p"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("src"), F.lit("p000500").alias("dst"))
    roots = spark.range(1_000).select(F.col("id").cast("string").alias("source_id"), F.concat(F.lit("e"), "id").alias("url"))
    walked = crawl.reachable_pages(roots, hub.unionByName(entry).unionByName(back), limit=20)
    assert walked.count() == 20_000
    assert {r.url for r in walked.where("depth = 2").select("url").distinct().collect()} == {f"p{k:06d}" for k in range(18)}


def test_rejected_pages_are_visited_and_not_expanded(spark):
    long = "words that say enough " * 10
    link = lambda *to: "".join(f'<a href="{t}"></a>' for t in to)
    site = "https://a.example.org"
    data = [("/d/", long, ("/d/thin", "/d/b", "/d/none", "/other", "/d/x.pdf", "https://b.example.net/d/")), ("/d/thin", "short", ("/d/hidden",)), ("/d/hidden", long, ()),
            ("/d/b", long, ("/d/", "c", "#top")), ("/d/c", long, ("/d/thin",)), ("/other", long, ())]
    pages = spark.createDataFrame([(k, site + path, f"<html><body><article><p>{text}</p>{link(*to)}</article></body></html>") for k, (path, text, to) in enumerate(data)],
                                  "page_id long, url string, html string")
    sources = spark.createDataFrame([("s", site + "/d/"), ("t", site + "/d/c"), ("u", site + "/missing")], "source_id string, url string")
    got = {(r.source_id, r.url.removeprefix(site), r.depth, r.drop_reason) for r in crawl.crawl_site(pages, sources).collect()}
    assert got == {("s", "/d/", 0, None), ("s", "/d/thin", 1, "short"), ("s", "/d/b", 1, None), ("s", "/d/c", 2, None), ("t", "/d/c", 0, None)}
    assert crawl.crawl_site(pages, sources, limit=2).where("source_id = 's'").count() == 2


def test_embedding_equals_plain_python(spark):
    import hashlib
    import math
    import re
    from collections import Counter

    texts = ["one two\ntwo three", "three", "", None, "Drei drei é 12", "one " * 50]
    df = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "id string, child_text string")
    model = embedding.fit_embedder(df, "child_text", width=16)
    bags = [Counter(int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % 16 for t in re.findall(r"[^\W_]+", (text or "").lower())) for text in texts]
    df_of = Counter(b for bag in bags for b in bag)
    for r in embedding.embed_texts(df, "child_text", model).collect():
        weights = [bags[int(r.id)][b] * math.log((len(texts) + 1) / (df_of[b] + 1)) for b in range(16)]
        norm = math.sqrt(sum(w * w for w in weights)) or 1
        assert r.embedding == pytest.approx([w / norm for w in weights], abs=1e-6)


def slow_walk(roots: list, links: list, limit: int | None) -> set:
    """Level by level in Python: the smallest unseen targets of all pages of a level, as many as still fit."""
    targets, out = {}, set()
    for src, dst in links:
        targets.setdefault(src, set()).add(dst)
    for source in {s for s, _ in roots}:
        level, seen, depth = {u for s, u in roots if s == source}, set(), 0
        while level:
            out |= {(source, u, depth) for u in level}
            seen |= level
            room = None if limit is None else max(0, limit - len(seen))
            level, depth = set(sorted({t for u in level for t in targets.get(u, ())} - seen)[:room]), depth + 1
    return out


@pytest.mark.parametrize("limit", [None, 7, 30])
def test_walk_equals_a_slow_walk_on_uneven_pages(spark, limit):
    draw = random.Random(5)
    name = lambda n: f"u{n * 7919 % 997:03d}"
    links = [(name(draw.randrange(150)), name(draw.randrange(300))) for _ in range(900)]
    links += [(name(p), name(t)) for p in range(0, 150, 3) for t in range(12)]  # the same menu on many pages
    links += [(name(p), name(t)) for p in (1, 2, 4) for t in range(200)] + [(name(5), name(5))]
    roots = [(f"s{k}", name(draw.randrange(150))) for k in range(25)] + [("s0", name(1)), ("alone", "nowhere")]
    found = crawl.reachable_pages(spark.createDataFrame(roots, "source_id string, url string"), spark.createDataFrame(links, "src string, dst string"), limit)
    got = [tuple(r) for r in found.select("source_id", "url", "depth").collect()]
    assert len(got) == len(set(got)) and set(got) == slow_walk(roots, links, limit)


def test_a_level_is_pruned_before_it_is_gathered(spark, monkeypatch):
    """40 pages of 200 targets each: what their source takes is known from a few of each, and the rest stays where it is."""
    links = [("root", f"p{k:02d}") for k in range(40)] + [(f"p{k:02d}", f"t{k + 40 * j:05d}") for k in range(40) for j in range(200)]
    gathered = []
    monkeypatch.setattr(crawl, "written", lambda df, name: (gathered.append((name, cut_lineage(df))), gathered[-1][1])[1])
    walked = crawl.reachable_pages(spark.createDataFrame([("s", "root")], "source_id string, url string"), spark.createDataFrame(links, "src string, dst string"), 100)
    assert walked.count() == 100 and {r.url for r in walked.where("depth = 2").collect()} == {f"t{n:05d}" for n in range(59)}
    assert [df.count() for name, df in gathered if name == "met"] == [59]


def test_cut_sources_looks_behind_a_visited_largest_target(spark):
    """The largest target of ``s`` was visited and a smaller one was not; ``t`` is full and has seen everything; ``u`` is not full."""
    walked = [("s", "a", 0), ("s", "z", 1), ("t", "b", 0), ("t", "c", 1), ("u", "d", 0), ("v", "e", 0), ("v", "f", 1)]
    links = [("a", "k"), ("a", "z"), ("b", "c"), ("c", "b"), ("d", "x"), ("e", "f"), ("f", "zz"), ("f", "e")]
    found = crawl.cut_sources(spark.createDataFrame(walked, "source_id string, url string, depth int"), spark.createDataFrame(links, "src string, dst string"), 2)
    assert rows(found) == [("s", 2, True), ("t", 2, False), ("u", 1, False), ("v", 2, True)]


def test_crawl_reads_the_html_of_a_page_once(spark):
    read = spark.sparkContext.accumulator(0)
    texts = {SITE + path: page(links) for path, links in LINKS.items()}

    @F.udf("string")
    def html(url):
        read.add(1)
        return texts[url]

    pages = spark.createDataFrame([(i, url) for i, url in enumerate(texts)], "page_id long, url string").withColumn("html", html("url"))
    sources = spark.createDataFrame([("s", SITE + "/docs")], "source_id string, url string")
    walked = crawl.crawl_site(pages, sources)
    assert rows(walked.select("url", "depth")) == [(SITE + "/docs", 0), (SITE + "/docs/a", 1), (SITE + "/docs/b", 2), (SITE + "/docs2", 1)]
    assert read.value == len(texts)


def stored_bytes(spark):
    from pathlib import Path

    from gleanloom.scale import shared_dir

    shared_dir(spark)
    top = Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:"))
    return sum(f.stat().st_size for f in top.rglob("*") if f.is_file())


@pytest.mark.parametrize("query", ["recursive_split_words", "chunk_hierarchy_recursive_words"])
def test_checks_of_cuts_store_no_pieces(spark, query):
    from gleanloom.plans import registry

    before = stored_bytes(spark)
    assert registry.all_queries()[query](spark, "/root/testdata/sf0.001").count() > 100
    assert stored_bytes(spark) == before


def test_check_of_cuts_equals_plain_python(spark):
    import hashlib
    import re

    from gleanloom.plans import registry

    pages = [("u", "One two, two three"), ("v", "alpha beta"), ("v", "gamma"), ("w", "..."), ("x", None), ("y", "no pieces"), (None, "a")]
    cut = [("u", "One two, ", "One two, two three"), ("u", "two four", "One two, two three"), ("u", "...", None), ("v", "Beta gamma ?", "Beta gamma ? and"),
           ("v", None, "x"), ("w", "!", "..."), ("x", "word", "word"), ("z", "a", "a"), (None, "a", "a")]
    words = lambda rows, url: {w for u, t, *_ in rows if u == url for w in re.findall(r"[^\W_]+", (t or "").lower())}
    wanted = []
    for url in "uvwxyz":
        own, both = [r[1:] for r in cut if r[0] == url], words(pages, url) & words(cut, url)
        if both:
            wanted.append((url, sum(len(c or "") > 8 for c, _ in own), sum(c is None or h is None or c not in h for c, h in own), len(both),
                           hashlib.md5(" ".join(sorted(both)).encode()).hexdigest()))
    got = registry._cut_check(spark.createDataFrame(pages, "page_url string, content string"), spark.createDataFrame(cut, "page_url string, piece string, whole string"), "piece", "whole", 8)
    assert rows(got) == wanted and len(wanted) == 2


def test_a_level_is_dealt_by_source_once(spark, monkeypatch):
    plans, write = [], crawl.written

    def kept(df, name, **options):
        if name == "level":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name, **options)

    monkeypatch.setattr(crawl, "written", kept)
    links = spark.createDataFrame([("r", "a"), ("r", "b"), ("a", "c"), ("b", "c"), ("c", "r")], "src string, dst string")
    roots = spark.createDataFrame([("s", "r"), ("t", "a")], "source_id string, url string")
    walked = crawl.reachable_pages(roots, links, 3)
    assert rows(walked) == [("s", "a", 1), ("s", "b", 1), ("s", "r", 0), ("t", "a", 0), ("t", "c", 1), ("t", "r", 2)]
    assert len(plans) > 2 and not any(re.search(r"hashpartitioning\(s#\w+, n#", p) for p in plans)


def test_links_are_grouped_once_for_cut_sources(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(url):
        read.add(1)
        return url

    edges = [("r", "a"), ("r", "b"), ("a", "r"), ("a", "c"), ("x", "y"), ("y", "x"), ("p", "q"), ("q", "p")]
    links = spark.createDataFrame(edges, "src string, dst string").select("src", seen("dst").alias("dst"))
    walked = spark.createDataFrame([("s", "r", 0), ("s", "a", 1), ("t", "x", 0), ("t", "y", 1), ("u", "p", 0)], "source_id string, url string, depth int")
    got = rows(crawl.cut_sources(walked, links.where("src IN ('r', 'a', 'x', 'y')"), 2))
    assert got == [("s", 2, True), ("t", 2, False), ("u", 1, False)]
    # once for the largest target of every page, and once more for the undecided source
    assert read.value <= 2 * len(edges)
