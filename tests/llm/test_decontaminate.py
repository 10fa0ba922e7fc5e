import re

import pytest

from gleanloom.llm import decontaminate as d

FOLDER = "/root/testdata/sf0.01"


def words(text):
    return re.findall(r"\w+", (text or "").lower())


def brute_force(docs: dict, items: list) -> dict:
    """Best stretch of every document and item over all diagonals that some seed hits, by plain loops."""
    found = {}
    for key, text in docs.items():
        own = words(text)
        for item in set(items):
            it = words(item)
            diagonals = set()
            for mask in d.MASKS:
                at = {}
                for q in range(len(it) - mask[-1]):
                    at.setdefault(tuple(it[q + k] for k in mask), []).append(q)
                for p in range(len(own) - mask[-1]):
                    diagonals.update(p - q for q in at.get(tuple(own[p + k] for k in mask), ()))
            best = 0
            for diagonal in diagonals:
                now = 0
                for j, token in enumerate(it):
                    if 0 <= diagonal + j < len(own):
                        now = max(0, now + (1 if own[diagonal + j] == token else -2))
                        best = max(best, now)
            if best and best >= min(d.FLOOR, -(-len(it) * d.PART // 1)):
                found[key] = max(found.get(key, 0), best)
    return found


@pytest.mark.parametrize("limit", [d.BROADCAST_BYTES, -1])
def test_documents_equal_brute_force(spark, limit):
    docs, items = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    got = d.contamination(docs, items, broadcast_bytes=limit).collect()
    assert len(got) == docs.count()
    want = brute_force({r["doc_id"]: r["text"] for r in docs.collect()}, [r["text"] for r in items.collect()])
    assert want and {r["doc_id"]: r["matched"] for r in got if r["contaminated"]} == want


def test_substitutions_and_edges(spark):
    item = " ".join(f"token{k}" for k in range(30))
    changed = item.split()
    for k in (6, 13, 22):
        changed[k] = "other"
    rows = [(1, item.upper() + "!", 0), (2, "before it " + " ".join(changed) + " after", 0), (3, None, 0), (4, "", 0), (5, "token0 token1 token2", 0),
            (None, item, 0), (7, item, 0), (7, item, 0), (8, "x " * 50_000 + item, 0), (9, " ".join(reversed(item.split())), 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, matched int")
    items = spark.createDataFrame([(1, item), (1, item), (None, "too short here"), (3, None)], "item_id long, text string")
    got = {(r["doc_id"], r["contaminated"], r["n_items"]) for r in d.contamination(docs, items).collect()}
    assert got == {(1, True, 1), (2, True, 1), (3, False, 0), (4, False, 0), (5, False, 0), (None, True, 1), (7, True, 1), (8, True, 1), (9, False, 0)}
    kept = d.decontaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 9]
    assert d.contamination(docs.limit(0), items).collect() == []
    assert d.decontaminated(docs, items.limit(0)).count() == len(rows)


def test_documents_are_not_shuffled(spark):
    docs, items = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    plan = d.leaks(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan


@pytest.mark.parametrize("limit", [d.BROADCAST_BYTES, -1])
def test_repeated_tokens(spark, limit):
    """Every position of the text hits every position of the item: a row per diagonal, not per hit, is compared."""
    item, text = " ".join(["same"] * 60), " ".join(["same"] * 20_000)
    docs = spark.createDataFrame([(1, text), (2, "same other " * 3_000), (3, text[:-5] + " end")], "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r["doc_id"]: (r["contaminated"], r["matched"]) for r in d.contamination(docs, items, broadcast_bytes=limit).collect()}
    assert got == {1: (True, 60), 2: (False, 0), 3: (True, 60)}
