import itertools
import zlib

import numpy as np
import pytest

from gleanloom.llm import chat, queries

TRANSCRIPT = "System: be kind\nUser: hi there\nmore of it\nAssistant: hello\n- one\n- two\n\nand what is it?\nQ: why?\nA: because"


@pytest.fixture(scope="module")
def model():
    return chat.Model({}, {})


def test_markers_alone_decide_without_labels(model):
    path = [chat.STATES[s] for s in model.path(TRANSCRIPT.split("\n"))]
    assert [r for r, b in path if b] == ["system", "user", "assistant", "user", "assistant"]
    assert [b for _, b in path] == [True, True, False, True, False, False, False, False, True, True]


def test_path_is_the_best_of_all_paths(model):
    lines = TRANSCRIPT.split("\n")[1:6]
    emissions = model.emissions(lines)
    score = lambda p: model.start[p[0]] + sum(model.move[a, b] for a, b in zip(p, p[1:])) + sum(emissions[k, s] for k, s in enumerate(p))
    best = max(itertools.product(range(6), repeat=len(lines)), key=score)
    assert np.isclose(score(best), score(tuple(model.path(lines))))


@pytest.mark.parametrize("size", [1, 2, 3, 7])
def test_pieces_give_the_same_path(model, size):
    lines = TRANSCRIPT.split("\n") * 3
    cut = [lines[k : k + size] for k in range(0, len(lines), size)]
    states = chat.seams([model.summary(c) for c in cut])
    assert sum([model.path(c, a, b) for c, (a, b) in zip(cut, states)], []) == model.path(lines)


def test_rows(spark, model):
    rows = [(1, 0, TRANSCRIPT, "x"), (2, 0, "User: a", "x"), (2, 1, None, "x"), (2, 1, None, "x"), (None, None, "AI: b", "x"), (3, 5, "", "x")]
    rows += [(9, k, f"{'User' if k % 2 else 'Assistant'}: turn {k}\nline", "x") for k in range(500)]
    parts = spark.createDataFrame(rows, "id long, place long, text string, role string").select("id", "place", chat.whole_text("text").alias("text"))
    whole = chat.parsed(parts, model).collect()
    cut = chat.parsed(parts, model, limit=7).collect()

    def rendered(found):
        out = {}
        for r in sorted(found, key=lambda r: (r["piece"], r["number"])):
            out[r["id"]] = out.get(r["id"], "") + r["rendered"]
        return out

    assert rendered(whole) == rendered(cut)
    assert set(rendered(whole)) == {1, 2, 3, 9, None}
    assert rendered(whole)[9].startswith("<|assistant|>\nturn 0\nline\n<|user|>\nturn 1\nline\n")
    assert sum(r["begins"] for r in whole if r["id"] == 9) == 500
    assert chat.parsed(parts.limit(0), model).collect() == []


def test_roles_of_documents_are_recovered(spark):
    folder = "/root/testdata/sf0.01"
    found = queries.QUERIES["op8_transcript_roles"](spark, folder).collect()
    true = {(r["conv_id"], r["turn"]): r["role"] for r in spark.read.parquet(f"{folder}/conversations.parquet").collect()}
    starts = {(r["conv_id"], r["place"]): r["role"] for r in found if r["begins"]}
    held = {k for k in true if zlib.crc32(str(k[0]).encode()) % 3 == 1}
    right = sum(starts.get(k) == true[k] for k in held)
    assert right / len(held) > 0.85
    assert sum(k in true for k in starts) == len(starts)


def test_repeated_turns_do_not_multiply(spark):
    """Counts of a conversation that is copied 300 times are 300 times its counts, and a single one counts as before."""
    one = [(1, 0, "user", "hi\nthere\nagain"), (1, 1, "assistant", "a"), (1, 2, "user", "b"), (1, 3, "assistant", "c\nd")]
    other = [(2, k, "user", "x") for k in range(3)]
    schema, names = "c long, t long, r string, x string", ("c", "t", "r", "x")
    u, a = chat.STATES.index(("user", True)), chat.STATES.index(("assistant", True))
    for copies in (1, 300):
        model = chat.fit(spark.createDataFrame(one * copies + other, schema), *names)
        want = {(-1, u): copies + 1, (u + 1, a): copies, (a, u): copies, (u, a): copies, (u, u): 2, (u, u + 1): copies, (u + 1, u + 1): copies, (a, a + 1): copies}
        expected = chat.Model(want, {})
        assert np.allclose(model.start, expected.start) and np.allclose(model.move, expected.move)
    mixed = chat.fit(spark.createDataFrame([(1, 0, "user", "x"), (1, 0, "system", "x"), (1, 1, "assistant", "x")], schema), *names)
    s = chat.STATES.index(("system", True))
    assert np.allclose(mixed.move, chat.Model({(u, a): 0.5, (s, a): 0.5}, {}).move)


def test_markers_are_looked_for_in_whole_lines():
    """A marker behind deep indentation counts; a line whose first characters merely begin like one does not."""
    assert chat.marker_of(" " * 90 + "User: hi") == (chat.ROLES.index("user"), 96)
    assert chat.marker_of(" " * 76 + "Users of the town came") == (3, 0)
