import itertools
import math
import re
from collections import Counter

from gleanloom.llm import minhash
from gleanloom.llm.common import opened


def brute_force(texts: dict, threshold=minhash.THRESHOLD) -> dict:
    """Classes by comparing all pairs with weights made from tuples of words in plain counters."""
    words = {key: tuple(re.findall(r"\w+", (text or "").lower())) for key, text in texts.items()}
    counted = {own: Counter(zip(*[own[j:] for j in range(min(5, len(own)))])) for own in set(words.values())}
    holders_of = Counter(s for bag in counted.values() for s in bag)
    top = len(counted)
    idf = {s: 1 + math.log((1 + top) / (1 + n)) / math.log(1 + top) for s, n in holders_of.items()}
    weighed = {own: {s: (1 + math.log(c)) * idf[s] for s, c in bag.items()} for own, bag in counted.items()}
    bags = {key: weighed[own] for key, own in words.items()}
    parent = {k: k for k in texts}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    holders = {}
    for k, bag in bags.items():
        for h in bag:
            holders.setdefault(h, []).append(k)
    pairs = {p for ks in holders.values() for p in itertools.combinations(ks, 2)}
    for a, b in pairs:
        if root(a) == root(b):
            continue
        shared = sum(min(w, bags[b][h]) for h, w in bags[a].items() if h in bags[b])
        if shared / (sum(bags[a].values()) + sum(bags[b].values()) - shared) >= threshold:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {k: root(k) for k in texts}


def test_classes_equal_brute_force_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: r["class_id"] for r in minhash.duplicate_classes(docs).collect()}
    want = brute_force({r["doc_id"]: r["text"] for r in docs.collect()})
    assert len(set(want.values())) < len(want)
    assert got == want


def test_samples_agree_as_often_as_texts_are_similar():
    import numpy as np

    rng = np.random.default_rng(0)
    hashes = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    one, two = rng.uniform(0.5, 3, 300), rng.uniform(0.5, 3, 300)
    left, right = dict(zip(hashes[:300], one)), dict(zip(hashes[100:], two))
    jaccard = sum(min(left[h], right[h]) for h in hashes[100:300]) / sum(max(left.get(h, 0), right.get(h, 0)) for h in hashes)
    samples = minhash.Sampler(3000)(np.concatenate([hashes[:300], hashes[100:]]), np.concatenate([one, two]), np.array([0, 300]))
    assert abs((samples[0] == samples[1]).mean() - jaccard) < 0.03


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    near = long.replace("w77 ", "other ")
    rows = [(1, long, 5), (2, near, 5), (3, None, 5), (4, "", 5), (5, "!!!", 5), (6, "??", 5), (7, "two words", 5), (8, "Two words.", 5),
            (9, "a b c d e f", 5), (9, "a b c d e f", 5), (None, "a b c d e f", 5), (None, "alone", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class_id int")
    got = sorted(((r["doc_id"], r["class_id"], r["class_rows"]) for r in minhash.duplicate_classes(docs).collect()), key=repr)
    assert got == sorted([(1, 1, 2), (2, 1, 2), (3, 3, 2), (4, 3, 2), (5, 5, 1), (6, 6, 1), (7, 7, 2), (8, 7, 2),
                          (9, 9, 3), (9, 9, 3), (None, 9, 3), (None, None, 1)], key=repr)
    kept = minhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 3, 5, 6, 7, 9]
    assert minhash.duplicate_classes(docs.limit(0)).collect() == []


def test_a_chain_is_one_class_and_leaders_do_not_hide_links(spark):
    """Neighbours of a chain are near, its ends are not; every text shares a large passage with all others."""
    words = [f"word{i}" for i in range(400)]
    chain = [" ".join([f"new{j}" for j in range(k * 12)] + words[k * 12 :]) for k in range(12)]
    shared = " ".join(f"s{i}" for i in range(150))
    apart = [shared + " " + " ".join(f"own{k}x{i}" for i in range(100)) for k in range(40)]
    docs = spark.createDataFrame(list(enumerate(chain + apart)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in minhash.duplicate_classes(docs).collect()}
    assert {got[k] for k in range(12)} == {0}
    assert all(got[k] == k for k in range(12, 52))


def test_document_frequencies_are_exact(spark):
    """The counts of all shingles over many blocks and parts equal those of plain tuples of words."""
    import numpy as np

    texts = [" ".join(f"w{k}x{i}" if i % 40 > 12 else f"common{(k % 7) * (i // 40)}x{i}" for i in range(400)) for k in range(60)]
    plain = [Counter(zip(*[t.split()[j:] for j in range(5)])) for t in texts]
    holders = Counter(s for bag in plain for s in bag)
    frame = minhash.normalised(spark.createDataFrame([(t,) for t in texts], "text string"), "text").select("_key", "_words")
    got = minhash.signed(frame, len(texts), block_chars=20_000, part_chars=30_000).join(frame, "_key").collect()
    assert len(got) == len(texts)
    want = {t: sorted(holders[s] for s in bag) for t, bag in zip(texts, plain)}
    assert all(sorted(opened(bytes(r["_df"]), np.int64).tolist()) == want[r["_words"]] for r in got)
    assert max(holders.values()) == 60 and min(holders.values()) == 1


def test_columns_of_the_same_names_stay(spark):
    rows = [(1, "a b c d e f", "x", "y", "z"), (2, "a b c d e f", "x2", "y2", "z2"), (3, "other", "x3", "y3", "z3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _words string, _KEY string, _id string")
    got = minhash.deduplicated(docs)
    assert got.columns == docs.columns
    assert sorted(tuple(r) for r in got.collect()) == [rows[0], rows[2]]


def test_copies_that_are_not_near_are_hardly_compared(spark, monkeypatch):
    """Each text changes words of its own in one long text: pairs agree in many samples, but few can reach the threshold."""
    import random

    random.seed(5)
    words = [f"w{i}" for i in range(150)]
    texts = {}
    for k in range(60):
        own = list(words)
        for i in random.sample(range(150), 1 if k % 15 == 0 else 5):
            own[i] = f"own{k}x{i}"
        texts[k] = " ".join(own)
    met, compared = [], minhash.compared

    def counting(pairs, *rest):
        met.append(pairs.count())
        return compared(pairs, *rest)

    monkeypatch.setattr(minhash, "compared", counting)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in minhash.duplicate_classes(docs).collect()}
    assert got == brute_force(texts)
    assert len(set(got.values())) < 60
    assert sum(met) < 300


def test_components_meet_least_neighbours_by_broadcast_or_shuffle(spark, monkeypatch):
    """Both ways give the components of a union-find, and small steps join without a shuffle."""
    chains = [(k, k + 1) for k in range(40) if k % 7] + [(100, k) for k in range(101, 130)] + [(5, 5), (36, 104)]
    links = spark.createDataFrame([(a.to_bytes(2, "big"), b.to_bytes(2, "big")) for a, b in chains], "_a binary, _b binary")
    parent = {k: k for pair in chains for k in pair}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in chains:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    plans, plain = [], minhash.written
    monkeypatch.setattr(minhash, "written", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or plain(df, name))
    for limit in (minhash.BROADCAST_BYTES, 0):
        monkeypatch.setattr(minhash, "BROADCAST_BYTES", limit)
        plans.clear()
        found = {int.from_bytes(r["_key"], "big"): int.from_bytes(r["_component"], "big") for r in minhash.components(links).collect()}
        assert found == {k: root(k) for k in parent}
        joins = [p for p in plans if "Join" in p]
        assert joins and all(("strategy=broadcast" in p) == (limit > 0) for p in joins)
