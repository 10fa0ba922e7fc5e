import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gleanloom.llm import exact, queries


def brute_force(rows: list[tuple]) -> list[tuple]:
    """(doc_id, keep_id, group_size, kept, sha256) by a plain dictionary of texts."""
    groups: dict[str, list] = {}
    for doc_id, text in rows:
        groups.setdefault(text or "", []).append(doc_id)
    out = []
    for text, ids in groups.items():
        top = max((i for i in ids if i is not None), default=None)
        digest, stays = hashlib.sha256(text.encode()).hexdigest(), True
        for i in ids:
            out.append((i, top, len(ids), i == top and stays, digest))
            stays = stays and i != top
    return out


def plain(df):
    return Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r[4]) for r in df.collect())


ROWS = [(k * 37 % 500, f"text {k % 60}" if k % 3 else "the hot text") for k in range(500)]
ROWS += [(None, "the hot text"), (None, "only nulls"), (None, "only nulls"), (7, None), (8, ""), (9, " "), (10, "Text 1"), (11, "text 1 "),
         (900, "twice"), (900, "twice"), (900, "twice"), (3, "long " * 100_000), (4, "long " * 100_000), (5, "é"), (6, "é")]


@pytest.mark.parametrize("salts", [1, 3, 256])
def test_groups_equal_brute_force(spark, salts):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(7)
    assert plain(exact.exact_groups(docs, salts=salts)) == Counter(brute_force(ROWS))


def test_texts_of_one_digest_stay_apart(spark):
    """A digest of four values: nearly all groups share theirs with other texts."""
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(5)
    weak = lambda text: F.unhex(F.hex(F.crc32(text.cast("binary")) % 4))
    got = exact.exact_groups(docs, salts=3, digest=weak)
    assert Counter((r[0], r[1], r[2], r[3]) for r in got.collect()) == Counter(r[:4] for r in brute_force(ROWS))


def test_shuffle_way(spark, no_broadcast):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(7)
    assert plain(exact.exact_groups(docs)) == Counter(brute_force(ROWS))


def test_kept_rows_have_all_columns(spark):
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(ROWS)], "doc_id long, text string, _key long")
    docs = docs.withColumn("_digest", F.lit("x")).withColumn("_ID", F.lit(1)).withColumn("keep_id", F.lit(2))
    got = exact.kept_rows(docs)
    assert got.columns == docs.columns
    want = Counter((r[0], r[4]) for r in brute_force(ROWS) if r[3])
    assert Counter((r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in got.collect()) == want


def test_text_ids_and_empty_table(spark):
    docs = spark.createDataFrame([("a", "x"), ("b", "x"), (None, "x")], "doc_id string, text string")
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in exact.exact_groups(docs).collect()} == {("a", "b", False), ("b", "b", True), (None, "b", False)}
    assert exact.exact_groups(docs.limit(0)).collect() == [] and exact.kept_rows(docs.limit(0)).collect() == []


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert plain(queries.op11_salted_exact(spark, folder)) == Counter(brute_force(rows))
