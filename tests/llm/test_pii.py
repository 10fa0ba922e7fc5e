import hashlib
import re

import pytest
from pyspark.sql import functions as F

from gleanloom.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def passes(kind, value):
    digits = re.sub(r"\D", "", value)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in value.split(".")),
            "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def base(text):
    spans = [(m.start(), n, m.end(), k) for n, (k, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "", re.ASCII) if passes(k, m.group())]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))


def test_base_spans_equal_plain_patterns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r for r in pii.personal_data(docs).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        want, row = base(r["text"]), got[r["doc_id"]]
        assert row["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert [row[f"n_{k}"] for k in PLAIN] == [len(re.findall(rf"\b{k}:", want)) for k in PLAIN]
        assert set(filter(None, want.split(","))) <= set(row["spans"].split(","))
    keyed = [r for r in rows if re.search(r"password=|token = ", r["text"])]
    assert keyed and all("secret:" in got[r["doc_id"]]["spans"] for r in keyed)
    clean = [r for r in rows if not re.search(r"[0-9@]", r["text"])]
    assert all(got[r["doc_id"]]["spans"] == "" for r in clean)


ODD = [None, "", "é\U0001f600 a@b.c_d@e.f, x@y.zz.", "1.2.3.4.5.6.7.8 999.1.1.1 0001.02.3.4 256.1.1.1", "4012888888881881 4012-8888-8888-1881 x4012 8888 8888 1882",
       "+1 (979) 555-5854 +49(((( +4", "call 979-555-5854 or 123-45-6789", "1 2 3 4 5", "a@b", "user.name+tag@sub-domain.example.co.uk..", "9" * 50]


def test_edges(spark):
    texts = [*ODD, "12-3 " * 60_000 + "a" * 200_000 + "1." * 60_000, " ".join(f"{k}.1.1.1" for k in range(30_000))]
    rows = [(k, t, 1) for k, t in enumerate(texts)] + [(None, "me@here.org", 1), (1, "me@here.org", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    got = pii.personal_data(docs).collect()
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], []).append(r["base_sha256"])
    for key, text, _ in rows:
        assert hashlib.sha256(base(text).encode()).hexdigest() in by_id[key]
    assert pii.personal_data(docs.limit(0)).collect() == []


@pytest.mark.parametrize("bins, want", [([], {}), ([(4, 90, 10, 10), (4, 40, 10, 9), (4, 10, 100, 0)], {4: 0.5}), ([(5, 80, 10, 2)], {})])
def test_thresholds(bins, want):
    rows = [dict(zip(("kind", "bin", "n", "good"), b)) for b in bins]
    assert pii.thresholds(rows, 0.9) == want


def test_a_rare_kind_and_copies_keep_their_cuts(spark):
    """One spelled-out address in many texts with other candidates, and a text copied often."""
    texts = [f"note {k} token = abc{k}x{k * 7919} end" if k % 2 else f"note {k} secret: plainwords{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}x end" for k in range(400)]
    rare = [t for t in ("write to jane at example dot com please", "ask bob (at) site (dot) org now")]
    docs = spark.createDataFrame(list(enumerate(texts + rare + [texts[1]] * 3_000)), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(docs, per_group=50).collect()}
    assert all("address:" in got[k] for k in (400, 401))
    assert all("secret:" in got[k] for k in range(1, 400, 2))
    assert got[1] == got[402] == got[3401]


def test_a_kind_without_held_out_rows_has_the_default_cut(spark):
    some = spark.range(1).select(F.struct(F.lit(7).alias("kind"), F.array(F.lit(0.0)).alias("features")).alias("c"))
    pick = lambda margin, cuts: some.select(pii.Trees([margin], cuts).selected(F.col("c"))).first()[0]
    assert pick(1.0, {}) and not pick(-1.0, {}) and not pick(1.0, {7: pii.NEVER})


def test_uncovered_numbers_are_learnt_from_words_and_groups(spark):
    """Phones and SSNs without a plus are added, also where no word stands before them; hex runs and failed card numbers are not."""
    phones = [f"please {'call' if k % 4 else 'write'} {200 + k}-555-{1000 + k * 13 % 9000} soon" for k in range(240)]
    ssns = [f"ssn {100 + k}-{10 + k % 80}-{1000 + k * 7} given" for k in range(120)]
    cards = [f"paid with card 4012 8888 8888 {1000 + k * 10 + (k + 1) % 10} today" for k in range(120)]
    hexes = [f"blob 3fa{7_000_000 + k * 31}c9e end" for k in range(120)]
    dotted = ["pay 4012.8888.8888.1881 now"]
    docs = spark.createDataFrame(list(enumerate(phones + ssns + cards + hexes + dotted)), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(docs).collect()}
    assert all("number:" in got[k] for k in range(360))
    assert not any("number:" in got[k] for k in range(360, 600))
