import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gleanloom import scale
from gleanloom.llm import records

FILE = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "plain words, words", "it's 12,5  two\n\n three\t", "<|endoftext|> in text", "tab\x1cfs \u0085  nbsp　wide", "日本語 \U0001f600 ok",
       "naïve Ünïcode ßſ", " lead", "trail  ", "x" * 50_000, "á e​z", " line", "don't I'LL 've"]


def test_segments_encode_like_whole_texts(monkeypatch):
    tokenizer, encoder = Tokenizer.from_file(FILE), records.SegmentEncoder(FILE)
    monkeypatch.setattr(records, "CACHE", 12)
    texts = [*ODD, *[a + b for a in ODD for b in ODD[:12]]]
    for text, ids in zip(texts, [i for k in range(0, len(texts), 5) for i in encoder.encode(texts[k : k + 5])]):
        assert np.frombuffer(ids, "<u2").tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 0]


def test_files_index_and_shuffled_reads(spark, tmp_path):
    rows = [(k * 7 % 1000 - 50, f"{k} " + ODD[k % len(ODD)][:3000], "x") for k in range(300)]
    rows += [(None, "no id", "x"), (5, None, "x"), (5, None, "x"), (1 << 60, "long id", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(5)
    path, index_path = str(tmp_path / "files"), str(tmp_path / "index")
    records.write_records(docs, path, FILE, file_bytes=20_000)
    index = records.with_starts(records.write_index(spark, path, index_path))
    got = sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in index.collect()), key=lambda r: r[1])
    assert index.select("file").distinct().count() > 3
    tokenizer, at, want = Tokenizer.from_file(FILE), 0, []
    ids_of = lambda t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [g[0] for g in got] == [r[0] for r in order]
    for doc_id, start, n, _ in got:
        assert start == at
        at += n
    by_row = sorted((repr(r[0]), len(ids_of(r[1])), zlib.crc32(np.array(ids_of(r[1]), "<u4").tobytes())) for r in rows)
    assert sorted((repr(g[0]), g[2], g[3]) for g in got) == by_row
    back = records.shuffled_records(spark, path, index, 3).collect()
    assert sorted((repr(r["doc_id"]), len(r["ids"]), zlib.crc32(np.array(r["ids"], "<u4").tobytes())) for r in back) == by_row
    assert [r["doc_id"] for r in back] != [g[0] for g in got]


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    records.write_records(docs, str(tmp_path / "f"), FILE)
    assert records.write_index(spark, str(tmp_path / "f"), str(tmp_path / "i")).count() == 0


def test_damage_is_found():
    good = records.frame(7, np.array([1, 2, 0], "<u2").tobytes(), 2)
    assert records.read_frame(good)[0] == 7
    for k in range(len(good)):
        bad = bytearray(good)
        bad[k] ^= 4
        with pytest.raises(Exception):
            records.read_frame(memoryview(bytes(bad)))


def test_files_are_ordered_by_number(spark):
    """Names of six digits sort before those of five that end in larger ones."""
    rows = [(f"part-{k:05d}-x.txt", 5) for k in (7, 99_999, 100_000, 100_001)]
    index = spark.createDataFrame([(f, 0, t) for f, t in rows], "file string, tokens_before long, file_tokens long")
    assert {r["file"]: r["start"] for r in records.with_starts(index).collect()} == {f: 5 * k for k, (f, _) in enumerate(rows)}


def test_identical_rows_can_be_dealt_to_several_files(spark, tmp_path):
    docs = spark.createDataFrame([(1, "same words in every row")] * 400, "doc_id long, text string").repartition(4)
    records.write_records(docs, str(tmp_path / "f"), FILE, file_bytes=4_000)
    index = records.with_starts(records.write_index(spark, str(tmp_path / "f"), str(tmp_path / "i"))).collect()
    assert len({r["file"] for r in index}) > 1
    assert sorted(r["start"] for r in index) == [k * index[0]["n_tokens"] for k in range(400)]


def test_texts_reach_python_in_small_batches(spark, tmp_path, monkeypatch):
    """A task holds a few MB of a file's texts at a time."""
    def sizes(_):
        def frames(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([str(batch.nbytes).encode()], pa.binary())], ["frame"])
        return frames

    before = spark.conf.get(scale.BATCH_BYTES)
    docs = spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "repeat('word ', 2000) AS text")
    monkeypatch.setattr(records, "framer", sizes)
    records.write_records(docs, str(tmp_path / "sizes"), FILE)
    seen = [int(r[0]) for r in spark.read.text(str(tmp_path / "sizes")).collect()]
    assert sum(seen) > 30_000_000 and max(seen) < 8 << 20
    assert spark.conf.get(scale.BATCH_BYTES) == before
