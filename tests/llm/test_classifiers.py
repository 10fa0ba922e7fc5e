import zlib

import numpy as np
import pytest

from gleanloom.llm import quality, toxicity

FOLDER = "/root/testdata/sf0.1"


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


@pytest.mark.parametrize("run, label, least", [(quality.quality, "quality", 0.98), (toxicity.toxicity, "toxic", 0.98)])
def test_held_out_accuracy(spark, run, label, least):
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    got = {r["doc_id"]: r for r in run(docs.select("doc_id", "text"), labels).collect()}
    assert len(got) == docs.count()
    assert all(r["held_out"] == held(k) and 0 <= r["score"] <= 1 for k, r in got.items())
    true = {r["doc_id"]: r[label] for r in labels.collect() if held(r["doc_id"])}
    assert np.mean([got[k]["predicted"] == v for k, v in true.items()]) >= least
    for value in (0, 1):
        assert np.mean([got[k]["predicted"] == value for k, v in true.items() if v == value]) >= 0.85


@pytest.mark.parametrize("run, label, cut", [(quality.quality, "quality", 0.5), (toxicity.toxicity, "toxic", 0.7)])
def test_edges(spark, run, label, cut):
    good, bad = "plain words in a row that read well", "LOUD!! LOUD!! scum LOUD!! scum"
    rows = [(k, good + f" {k}" if k % 2 else bad + f" {k}", 0.1) for k in range(60)] + [(100, None, 0.1), (101, "", 0.1), (None, good, 0.1), (102, good * 20_000, 0.1), (1, good + " 1", 0.1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(k, k % 2 if label == "quality" else 1 - k % 2, None) for k in range(60)] + [(None, 1, 1), (3, 0, 0), (7, None, 1)],
                                   f"doc_id long, {label} int, other int")
    got = run(docs, labels).collect()
    assert len(got) == len(rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= cut) for r in got)
    empty = [r["score"] for r in got if r["doc_id"] in (100, 101)]
    assert empty[0] == empty[1]
    want = lambda k: k % 2 if label == "quality" else 1 - k % 2
    if label == "quality":
        assert np.mean([r["predicted"] == want(r["doc_id"]) for r in got if r["doc_id"] is not None and r["doc_id"] < 60]) > 0.95
    assert run(docs.limit(0), labels).collect() == []
    assert len(run(docs, labels.limit(0)).collect()) == len(rows)


def test_labels_of_held_out_rows_are_not_read(spark):
    docs = spark.createDataFrame([(k, f"text number {k} " * 5) for k in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(held(k))) for k in range(50)], "doc_id long, quality int")
    assert {r["score"] for r in quality.quality(docs, labels).collect()} == {0.0}


def test_votes_equal_plain_cosines():
    rng = np.random.default_rng(3)
    model = quality.Model(None, quality.unit(rng.normal(size=(40, 8))).astype(np.float32), rng.integers(0, 2, 40).astype(np.float32), 0.5)
    asked = quality.unit(rng.normal(size=(5, 8))).astype(np.float32)
    for vector, score in zip(asked, quality.votes(asked, model, 7, 2.0)):
        near = sorted(((max(0.0, float(vector @ v)), k) for k, v in enumerate(model.vectors)), key=lambda c: (-c[0], c[1]))[:7]
        assert np.isclose(score, sum(c**2 * model.labels[k] for c, k in near) / sum(c**2 for c, _ in near), atol=1e-5)


def test_folding():
    assert toxicity.folded("1d10t 1o5er ѕсum p@thetic! 12345 +1 555") == ["idiot", "ioser", "scum", "pathetic"]
    assert toxicity.folded("ＳＣＵＭ") == ["scum"] and toxicity.folded("") == []


def test_lexicon_exceptions_and_length():
    rng = np.random.default_rng(0)
    fill = lambda n: " ".join(f"w{k}x" for k in rng.integers(0, 50, n))
    toxic = [f"{fill(10)} scum {fill(10)} {k}" for k in range(60)]
    clean = [f"{fill(20)} pond scum {k}" if k < 4 else f"{fill(20)} {k}" for k in range(80)]
    lexicon = toxicity.learn(toxic + clean, [1] * 60 + [0] * 80, least_weight=2.5)
    assert " scum " in lexicon.weights or any(" scum ".startswith(e) for e in lexicon.weights)
    assert " pond scum " in lexicon.exceptions
    automaton, exempt = toxicity.built(lexicon), frozenset(lexicon.exceptions)
    measure = lambda t: toxicity.measures(" ".join(toxicity.folded(t)), automaton, exempt)
    assert measure("green pond scum here") == (0.0, 0.0)
    assert measure("you scum") > measure("you scum" + " and so on" * 100) > (0.0, 0.0)


def plain_measures(text, lexicon):
    """Hits and exceptions by plain searches, every hit against every exception."""
    padded = f" {text} "
    at = lambda e: [k for k in range(len(padded)) if padded.startswith(e, k)]
    free = [(k, k + len(e)) for e in lexicon.exceptions for k in at(e)]
    total = 0.0
    for e in sorted(lexicon.weights):
        n = 0 if e in lexicon.exceptions else sum(not any(a <= k and k + len(e) <= b for a, b in free) for k in at(e))
        total += lexicon.weights[e] * (1 + np.log(n)) if n else 0.0
    return np.log1p(total), np.log1p(100 * total / (1 + padded.count(" ")))


def test_measures_equal_a_plain_search():
    rng = np.random.default_rng(1)
    lexicon = toxicity.Lexicon({" scum ": 3.0, " scu": 1.5, " vile ": 2.0, " pond ": 0.5}, [" pond scum ", " scum of the ", " vile scum vile "])
    automaton, exempt = toxicity.built(lexicon), frozenset(lexicon.exceptions)
    for _ in range(300):
        text = " ".join(rng.choice(["scum", "pond", "vile", "scull", "of", "the", "x"], rng.integers(0, 30)))
        assert np.allclose(toxicity.measures(text, automaton, exempt), plain_measures(text, lexicon))


def test_many_hits_and_exceptions_in_one_text():
    lexicon = toxicity.Lexicon({" scum ": 3.0}, [" pond scum "])
    automaton, exempt = toxicity.built(lexicon), frozenset(lexicon.exceptions)
    total, _ = toxicity.measures("pond scum x scum y " * 20_000, automaton, exempt)
    assert np.isclose(total, np.log1p(3.0 * (1 + np.log(20_000))))


def test_the_quality_model_is_fitted_without_the_whole_matrix():
    """As the driver's memory is small, the matrix of texts and features is laid out in parts; the vectors equal those of the whole."""
    import tracemalloc

    import numpy as np

    from gleanloom.llm import quality

    rng = np.random.default_rng(3)
    texts = [" ".join(f"word{k}" for k in rng.integers(0, 4000, 60)) for _ in range(700)]
    tracemalloc.start()
    model = quality.fit(texts, [k % 2 for k in range(700)])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 700 * quality.FEATURES * 4
    cache = quality.Shapes()
    again = np.stack([quality.latent_vector(t, model, cache) for t in texts])
    assert np.allclose(again, model.vectors, atol=1e-4)
