from collections import Counter

import pytest
from pyspark.sql import functions as F

from gleanloom.llm import sharding


def slow_fill(names, size):
    """Turn by turn over written-out permutations."""
    orders = [[(a + j * b) % size for j in range(size)] for a, b in (sharding.preference(n, size) for n in names)]
    assert all(sorted(o) == list(range(size)) for o in orders)
    owner = {}
    while len(owner) < size:
        for k, order in enumerate(orders):
            if len(owner) < size:
                owner[next(s for s in order if s not in owner)] = k
    return [owner[s] for s in range(size)]


@pytest.mark.parametrize("names, size", [(["a"], 7), (["a", "b", "c"], 101), (sharding.shard_names(13), 251)])
def test_table_equals_slow_fill(names, size):
    assert sharding.fill_table(names, size) == slow_fill(names, size)


def test_even_and_little_disruption():
    names = sharding.shard_names(16)
    before, after = sharding.fill_table(names), sharding.fill_table(names[:7] + names[8:])
    counts = Counter(before).values()
    assert max(counts) - min(counts) <= 1
    left = [n for n in names if n != names[7]]
    moved = sum(names[a] != left[b] for a, b in zip(before, after) if a != 7)
    assert moved / len(before) < 0.15


@pytest.mark.parametrize("names, size", [(["a", "a"], 7), (["a"], 8), ([], 7), (sharding.shard_names(8), 7)])
def test_bad_tables(names, size):
    with pytest.raises(ValueError):
        sharding.fill_table(names, size)


def test_rows(spark, tmp_path):
    rows = [(k, "t" * k, "hot", 1) for k in range(300)] + [(None, None, None, 1), (5, "", "hot", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string, other int")
    got = sharding.assign_shards(docs, F.col("doc_id"), sharding.shard_names(4), 101)
    assert got.columns == ["doc_id", "text", "other", "slot", "shard"]
    found = got.collect()
    assert len(found) == len(rows) and {r["shard"] for r in found} == {0, 1, 2, 3}
    assert len({r["shard"] for r in found if r["doc_id"] == 5}) == 1
    assert sharding.assign_shards(docs.limit(0), F.col("doc_id")).collect() == []
    sharding.write_shards(got, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == len(rows)
