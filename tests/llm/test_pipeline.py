import zlib

import __spark_entry__
import corpus_pipeline
from gleanloom.llm import queries
from gleanloom.llm.common import written


def test_stages(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names, counts = docs.columns, [docs.count()]
    ids = [{r["doc_id"] for r in docs.select("doc_id").collect()}]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, folder), "stage")
        ids.append({r["doc_id"] for r in docs.select("doc_id").collect()})
        counts.append(docs.count())
        assert ids[-1] <= ids[-2]
        assert docs.columns[: len(names)] == names
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == names
    assert counts[0] > counts[1] > counts[2] > counts[3]
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    good = [r["doc_id"] for r in labels if r["quality"] == 1 and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert sum(k in ids[1] for k in good) > 0.97 * len(good)
    assert len(ids[5]) == len(ids[4])


def test_empty_documents(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, folder), "stage")
    assert docs.count() == 0


def test_registration():
    own = [q for q in __spark_entry__.queries() if q.startswith("op")]
    assert sorted(int(q[2:].split("_")[0]) for q in own) == list(range(1, 14))
    assert set(queries.oracles()) <= set(queries.QUERIES) and "pipeline" in __spark_entry__.queries()
