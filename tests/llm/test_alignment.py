import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from gleanloom.llm import alignment, queries
from gleanloom.llm.segments import segments

FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["plain words, words", "it's 12,5  two\n\n three\t", "<|endoftext|> in </s> text <s>", "tab\x1cfs \u0085  nbsp　wide   x", "日本語 \U0001f600 ok\U0001f468‍\U0001f469",
       "naïve Ünïcode ßſ", " lead", "trail  ", "  ", " ", "\n", "a\n b \n  c", "under▁score", "▁", "<0x41> \x00 nul", "é ​ z", "ﬁ ① Ⅷ ½", "﻿bom", "x" * 5000, "ab" * 3000 + " end", "ༀ༁"]


def brute_force(rows: list[tuple]) -> Counter:
    """Whole texts are encoded, bytes are compared one by one, and all links are listed."""
    a, b = Tokenizer.from_file(FILES[0]), sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    a.encode_special_tokens = True
    alphabet = alignment.byte_alphabet()
    bytes_b = lambda k: bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode()
    found, holders = [], Counter()
    for _, text in rows:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        parts_a = [bytes(alphabet[ch] for ch in a.id_to_token(k)) for k in ids_a]
        parts_b = [bytes_b(k) for k in ids_b]
        if not text or b"".join(parts_a) != (" " + text).encode() or b"".join(parts_b) != (" " + text).encode():
            found.append([])
            continue
        ends_a, ends_b = np.cumsum([len(p) for p in parts_a]).tolist(), np.cumsum([len(p) for p in parts_b]).tolist()
        groups, i, j = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            group = ([], [])
            while i < len(ends_a) and ends_a[i] <= end:
                group[0].append(ids_a[i])
                i += 1
            while j < len(ends_b) and ends_b[j] <= end:
                group[1].append(ids_b[j])
                j += 1
            groups.append(group)
        found.append(groups)
        holders.update({(x, y) for g in groups for x in g[0] for y in g[1]})
    highest = {}
    for (x, _), n in holders.items():
        highest[x] = max(highest.get(x, 0), n)
    out = Counter()
    for (doc_id, _), groups in zip(rows, found):
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        out[doc_id, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links),
            sum(holders[p] == highest[p[0]] for p in links), sum(holders[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if text else ""] += 1
    return out


def result(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())


def made() -> list[tuple]:
    rows = [(k * 31 % 400, f"{ODD[k % len(ODD)]} {ODD[k * 7 % len(ODD)][:40]} shared words {k % 5}") for k in range(200)]
    rows += list(enumerate(ODD, 1000)) + [(None, "no id"), (5, None), (5, ""), (7, "twice"), (7, "twice")]
    return rows


def test_rows_equal_brute_force(spark):
    rows = made()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute_force(rows)
    assert any(r[1] == 0 for r in want) and any(r[1] > 500 for r in want)
    assert result(alignment.align(docs, *FILES)) == want


def test_many_blocks_small_trees_and_cleared_caches(spark, monkeypatch):
    monkeypatch.setattr(alignment, "CACHE", 20)
    monkeypatch.setattr(alignment, "MANY_LINKS", 3)
    rows = made()
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, _id int, _block int").repartition(5)
    assert result(alignment.align(docs, *FILES, block_chars=1500, fan=3, parts=5)) == brute_force(rows)


def test_a_lone_blank_at_the_end(spark):
    rows = list(enumerate(["x ", "word and end ", "a b ", "end ", "end", "tab\t ", "a\n b ", "two  ", " ", "naïve 日本 ", "▁ "]))
    want = brute_force(rows)
    assert {r[0] for r in want if not r[1]} == {10}
    assert result(alignment.align(spark.createDataFrame(rows, "doc_id long, text string"), *FILES)) == want


def test_links_of_a_group_beyond_32_bits(spark):
    rows = [(1, "l" * 100_000), (2, "two l" + "l" * 99_999 + " ")]
    found = {r["doc_id"]: r for r in alignment.align(spark.createDataFrame(rows, "doc_id long, text string"), *FILES).collect()}
    assert found[1]["n_groups"] == 1 and found[1]["n_links"] == found[1]["n_a"] * found[1]["n_b"] > 2**31
    assert found[1]["n_best"] <= found[1]["n_links"] <= found[1]["count_sum"] and found[2]["n_links"] > 0


def test_text_ids_and_empty_table(spark):
    docs = spark.createDataFrame([("a", "one two"), (None, None)], "doc_id string, text string")
    assert result(alignment.align(docs, *FILES)) == brute_force([("a", "one two"), (None, None)])
    assert alignment.align(docs.limit(0), *FILES).collect() == []


@pytest.mark.parametrize("text", ODD)
def test_segments_encode_like_whole_texts(text):
    a, b = Tokenizer.from_file(FILES[0]), sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    a.encode_special_tokens = True
    cut = segments(" " + text)[1:]
    ids = lambda t: a.encode(t, add_special_tokens=False).ids
    assert [k for s in cut for k in ids(" " + s)] == ids(" " + text)
    assert [k for s in cut for k in b.encode(s)] == b.encode(text)


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert result(queries.op13_token_alignment(spark, folder)) == brute_force(rows)
