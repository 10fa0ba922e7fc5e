import math

import pytest
from pyspark.sql import functions as F

from gleanloom.llm import mixing


def slow_targets(sizes, weights=mixing.WEIGHTS, share=1.5, cap=2.0):
    """Share, cut at the caps, share the excess again, until nothing is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    fixed, target = {}, {}
    while True:
        open_ = [s for s in names if s not in fixed]
        rest = share * sum(sizes.values()) - sum(fixed.values())
        target = {s: rest * weight[s] / sum(weight[o] for o in open_) for s in open_}
        above = {s: cap * sizes[s] for s in open_ if target[s] > cap * sizes[s]}
        if not above:
            return {**fixed, **target}
        fixed.update(above)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix(docs.select("doc_id", "text", "source")).collect()
    sizes, taken = {}, {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    want = slow_targets(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], want[r["source"]])
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)


def test_curriculum(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    order = mixing.curriculum(docs).select("doc_id", "source", "position", "copies").collect()
    positions = [r["position"] for r in order]
    assert positions == sorted(positions) and 0 <= positions[0] and positions[-1] < 1
    per_doc = {}
    for r in order:
        per_doc[r["doc_id"]] = per_doc.get(r["doc_id"], 0) + 1
    assert all(per_doc[r["doc_id"]] == r["copies"] for r in order)
    early = sorted({r["source"] for r in order})[0]
    own = [r["position"] for r in order if r["source"] == early]
    assert sum(p < 0.5 for p in own) > 0.6 * len(own)


@pytest.mark.parametrize("knots", mixing.SCHEDULES)
def test_inverse_of_the_integral(spark, knots):
    rows = spark.range(0, 1000).select((F.col("id") / 1000).alias("f")).select("f", mixing.inverted(F.col("f"), knots).alias("t")).collect()
    total = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))

    def integral(t):
        out = 0.0
        for (a, x), (b, y) in zip(knots, knots[1:]):
            h = max(0.0, min(t, b) - a)
            out += h * (x + (x + (y - x) * h / (b - a))) / 2
        return out / total

    assert all(abs(integral(r["t"]) - r["f"]) < 1e-9 for r in rows)


def test_edges(spark):
    rows = [(1, "a b c d", "x", 1), (2, None, "x", 1), (3, "", None, 1), (None, "one two", None, 1), (4, "w " * 50_000, "y", 1), (5, "  ", "z", 1),
            (6, "q r", "y", 1), (6, "q r", "y", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    mixed = mixing.mix(docs)
    got = mixed.collect()
    assert mixed.columns.count("size") == 1 and len(got) == len(rows)
    assert {r["doc_id"]: r["size"] for r in got if r["doc_id"] in (2, 3, 5)} == {2: 0, 3: 0, 5: 0}
    assert all(r["position"] is None and r["taken"] == 0 for r in got if r["size"] == 0)
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda r: (str(r["doc_id"]), r["taken"], r["position"])
    assert sorted(map(key, got), key=repr) == sorted(map(key, again), key=repr)
    assert mixing.mix(docs.limit(0)).collect() == [] and mixing.curriculum(docs.limit(0)).collect() == []
