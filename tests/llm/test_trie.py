import hashlib
import random
import re
import zlib
from collections import Counter

import pytest

from gleanloom.llm import queries, trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute_force(rows: list[tuple]) -> set[tuple]:
    """The trie from tuples of turns."""
    own: dict[int, list] = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    members: dict[tuple, list] = {}
    ends: dict[tuple, list] = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - c % 20 if c >= 0 else c + (-c) % 20
        path = tuple(own.get(base, [])[:h] + turns[h:])
        ends.setdefault(path, []).append(c)
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    children = Counter(path[:-1] for path in members if path)
    leaves, saved = Counter(), Counter()
    for path, ids in members.items():
        worth = (len(ids) - 1) * len(re.findall(r"[^\x20\x09-\x0d]+", path[-1][1])) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += worth
    return {(min(ids), len(path), min(members[path[:-1]]) if path else None, len(ids), children[path], leaves[path], saved[path],
             hashlib.sha256(",".join(map(str, sorted(ends.get(path, [])))).encode()).hexdigest()) for path, ids in members.items()}


def nodes(df):
    found = [tuple(r[c] for c in COLUMNS) for r in df.select(COLUMNS).collect()]
    assert len(found) == len(set(found))
    return set(found)


def made(seed: int, convs: int) -> list[tuple]:
    rng, rows = random.Random(seed), []
    for _ in range(convs):
        c = rng.randrange(-30, 3 * convs)
        for turn in range(rng.choice([0, 1, 2, 3, 9, 30])):
            rows.append((c, turn, rng.choice(["user", "assistant", None]), rng.choice(["hi", "hello there", "a  b\tc", "", None])))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard, block", [(2048, 64), (3, 4), (1, 1), (5, 7)])
def test_nodes_equal_brute_force(spark, shard, block):
    """Many shared prefixes, repeated turns and conversations of several blocks."""
    rows = made(1, 120) + [(500, None, "user", "first"), (500, None, None, None), (None, 1, "user", "no conversation"), (501, 1, "r", "é 日本")]
    rows += [(k, t, "user", f"same {t}") for k in range(1000, 1030) for t in range(20)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    assert nodes(trie.prefix_trie(df, shard, block)) == brute_force(rows)


def test_one_conversation_of_many_turns(spark, no_broadcast):
    """Two copies of a long conversation share all their turns, over many blocks; every turn of another is repeated."""
    rows = [(c, t, "user", f"turn {t}") for c in (40, 60) for t in range(700)] + [(61, t // 3, "user", "again") for t in range(90)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    assert nodes(trie.prefix_trie(df, 2, 16)) == brute_force(rows)


def test_turnless_and_empty(spark):
    """A conversation whose turns all give way to those of an absent one ends at the root."""
    c = next(k for k in range(21, 40) if zlib.crc32(str(k).encode()) % 4 == 3)
    rows = [(c, 0, "user", "a"), (c, 1, "user", "b")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert nodes(trie.prefix_trie(df)) == brute_force(rows) == {(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())}
    assert trie.prefix_trie(df.limit(0)).collect() == []


def test_many_ends_are_hashed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE_IDS", 3)
    rows = [(20 * k, 0, "user", "hot") for k in range(200)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert nodes(trie.prefix_trie(df, 16)) == brute_force(rows)


def test_other_columns_are_ignored(spark):
    rows = made(2, 20)
    df = spark.createDataFrame([(*r, 1, 2, b"x") for r in rows], SCHEMA + ", c long, depth long, node binary")
    assert nodes(trie.prefix_trie(df)) == brute_force(rows)


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert nodes(queries.op12_bitmap_trie(spark, folder)) == brute_force(rows)
