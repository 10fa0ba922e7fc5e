"""The trie of conversation prefixes, from vertical bitmaps.

A conversation c of the table is rebuilt first: the first h turns of conversation ``c - c % 20`` (h is the CRC-32 of the decimal id modulo 4),
then its own turns after its first h. A node is a distinct sequence of first turns; its members are the conversations that start with it.

1. Turns are ranked by a range sort over (conversation, turn, role, text); ranks are counted per range and then added up per conversation, so
   that no task needs a whole conversation. A turn is reduced to 128 bits of the SHA-256 of its role and text, and its number of words.
2. Conversations are dealt into shards of about ``SHARD``, and positions into blocks of ``BLOCK``. In the unit of a shard and a block, every
   (position, turn) has the bitset of the conversations that hold it. Depth-first, a node's bitset is cut with the posting of the
   turn of its first conversation left, which gives a child, its popcount and its least member; conversations that stop
   there are the node's end list. A node is named by the chained hash of its turns; a block starts from the chained
   hash of the blocks before it, which is computed from one row per block.
3. Nodes of equal names are added up over the shards. Sums over subtrees take one round per doubling of the depth: what a node has collected
   over 2^k levels goes to its ancestor 2^k levels up. Only nodes of two and more members take part; below them every path is a
   single conversation's.
4. End lists are sorted by (node, conversation) over ranges, written as pieces of text in parallel, and the pieces of a node are hashed in order.

Edge cases: rows of null ``conv_id`` belong to no conversation and are left out; null turns come first, rows of equal turn follow each
other by role and text, and repeated rows count as often as they occur; null role and text are empty; a rebuilt conversation
without turns ends at the root; an empty table has no nodes; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanloom.llm.common import WORD, hot_join, written
from gleanloom.scale import cut_lineage

SHARD = 2048
BLOCK = 64
FAMILY = 20
MOST_BORROWED = 4
ROOT = bytes(16)
PIECE_IDS = 4096
UNIT = "node binary, parent binary, depth long, words long, members long, least long, ends array<long>"


def short_hash(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()[:16]


def turn_hash(role: str, text: str) -> Column:
    """128 bits of role and text; the role's length keeps both apart."""
    both = F.concat(F.octet_length(role).cast("string"), F.lit(":"), F.col(role), F.col(text))
    return F.substring(F.unhex(F.sha2(both.cast("binary"), 256)), 1, 16)


def borrowed(conv: Column) -> Column:
    return F.crc32(conv.cast("string").cast("binary")) % MOST_BORROWED


def ranked(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (c, part, at, key, words) in order, and (c, part, first, n, before): the rows of c in a range, and those of the ranges before."""
    order = ["c", F.col("t").asc_nulls_first(), "role", "text", "copy"]
    rows = turns.withColumn("copy", F.monotonically_increasing_id())  # rows that repeat can be dealt to several ranges
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.select("c", F.monotonically_increasing_id().alias("at"), turn_hash("role", "text").alias("key"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))
    rows = written(rows, "turns").withColumn("part", F.shiftright("at", 33))
    parts = rows.groupBy("c", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return rows, cut_lineage(parts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(c, pos, key, words, length) of the rebuilt conversations, and (c, base, length) of all of them."""
    rows, parts = ranked(turns)
    sizes = parts.groupBy("c").agg(F.sum("n").alias("n"))
    convs = sizes.withColumn("base", F.col("c") - F.col("c") % FAMILY).withColumn("h", borrowed(F.col("c")))
    known = sizes.select(F.col("c").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(known, "base", "left").withColumn("k", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = cut_lineage(convs.select("c", "base", "h", "k", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")))
    placed = rows.join(parts.join(convs, "c"), ["c", "part"]).withColumn("pos", F.col("before") + F.col("at") - F.col("first"))
    own = placed.where("pos >= h").select("c", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "key", "words", "length")
    heads = placed.where((F.col("pos") < MOST_BORROWED - 1) & (F.col("c") % FAMILY == 0))
    heads = heads.select(F.col("c").alias("base"), "pos", "key", "words")
    taken = convs.where("k > 0").join(heads, "base").where("pos < k").select("c", "pos", "key", "words", "length")
    return own.unionByName(taken), convs.select("c", "base", "length")


def chained(batches):
    """The names of the nodes at which blocks start and end, along each conversation; rows come in order."""
    last, name = None, ROOT
    for batch in batches:
        out = []
        for c, block, digest in zip(*[column.to_pylist() for column in batch.columns]):
            if c != last:
                last, name = c, ROOT
            after = short_hash(name + digest)
            out.append((c, block, after))
            name = after
        columns = list(zip(*out)) if out else [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())], ["c", "block", "name"])


def block_names(rows: DataFrame, size: int) -> DataFrame:
    """(c, block, name) of the node at the end of every full block."""
    full = rows.where(F.floor(F.col("pos") / size + 1) * size <= F.col("length"))
    keys = F.array_sort(F.collect_list(F.struct("pos", F.hex("key").alias("key"))))
    chunks = full.groupBy("c", F.floor(F.col("pos") / size).alias("block")).agg(keys.alias("keys"))
    joined = F.array_join(F.transform("keys", lambda t: t["key"]), "")
    chunks = chunks.select("c", "block", F.unhex(F.sha2(joined.cast("binary"), 256)).alias("digest"))
    return chunks.repartition("c").sortWithinPartitions("c", "block").mapInArrow(chained, "c long, block long, name binary")


def walker(size: int):
    def walk(unit: pa.Table) -> pa.Table:
        """All nodes of a unit. Rows of position -1 hold the name at which a conversation enters, those of -2 the one at which it leaves."""
        rows = list(zip(*[unit[name].to_pylist() for name in ("c", "pos", "key", "words", "length")]))
        convs = sorted({r[0] for r in rows})
        bit = {c: k for k, c in enumerate(convs)}
        start = unit["block"][0].as_py() * size
        turns, postings, words, stops, enters, leaves, lengths = {}, {}, {}, {}, {}, {}, {}
        for c, pos, key, n, length in rows:
            k = bit[c]
            if pos == -1:
                enters[k] = key
            elif pos == -2:
                leaves[k] = key
            else:
                turns[k, pos] = key
                postings[pos, key] = postings.get((pos, key), 0) | 1 << k
                words[key] = n
                lengths[k] = length
        for k, length in lengths.items():
            stops[length] = stops.get(length, 0) | 1 << k
        roots: dict[bytes, int] = {}
        for k in lengths:
            name = enters.get(k, ROOT)
            roots[name] = roots.get(name, 0) | 1 << k
        out, stack = [], [(name, members, start) for name, members in roots.items()]
        while stack:
            name, left, pos = stack.pop()
            left &= ~stops.get(pos, 0)
            while left:
                first = (left & -left).bit_length() - 1
                key = turns[first, pos]
                child = left & postings[pos, key]
                left ^= child
                whole = pos + 1 == start + size
                below = leaves[first] if whole else short_hash(name + key)
                ends = child & stops.get(pos + 1, 0)
                ended = []
                while ends:
                    low = ends & -ends
                    ended.append(convs[low.bit_length() - 1])
                    ends ^= low
                out.append((below, name, pos + 1, words[key], child.bit_count(), convs[first], ended or None))
                if not whole:
                    stack.append((below, child, pos + 1))
        columns = list(zip(*out)) if out else [()] * 7
        kinds = [pa.binary(), pa.binary(), *[pa.int64()] * 4, pa.list_(pa.int64())]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["node", "parent", "depth", "words", "members", "least", "ends"])

    return walk


def units(rows: DataFrame, shards: int, size: int) -> DataFrame:
    """The nodes of all units, each shard's on their own."""
    names = block_names(rows, size)
    marks = names.select("c", "block", F.lit(-2).cast("long").alias("pos"), "name").unionByName(
        names.select("c", (F.col("block") + 1).alias("block"), F.lit(-1).cast("long").alias("pos"), "name"))
    marks = marks.select("c", "block", "pos", F.col("name").alias("key"), F.lit(None).cast("long").alias("words"), F.lit(None).cast("long").alias("length"))
    turns = rows.select("c", F.floor(F.col("pos") / size).alias("block"), "pos", "key", "words", "length")
    both = turns.unionByName(marks)
    both = both.withColumn("shard", F.pmod(F.xxhash64(F.col("c") - F.col("c") % FAMILY), F.lit(shards)))
    return both.groupBy("shard", "block").applyInArrow(walker(size), UNIT)


def pieces(batches):
    """Ids of a node, in order, as pieces of comma-joined text."""
    node, first, ids, out = None, None, [], []

    def cut():
        if ids:
            out.append((node, first, ",".join(ids)))

    def batch_of(rows):
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], ["node", "first", "ids"])

    for batch in batches:
        for name, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if name != node or len(ids) >= PIECE_IDS:
                cut()
                node, first, ids = name, c, []
            ids.append(str(c))
        if out:
            yield batch_of(out)
            out.clear()
    cut()
    if out:
        yield batch_of(out)


def hashed(batches):
    """SHA-256 of each node's pieces, which come in order; only the state of one hash is kept."""
    node, state = None, None
    for batch in batches:
        out = []
        for name, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if name != node:
                if state is not None:
                    out.append((node, state.hexdigest()))
                node, state = name, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.string())], ["node", "ends_sha256"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["node", "ends_sha256"])


def end_hashes(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) from (node, c)."""
    ordered = ends.repartitionByRange("node", "c").sortWithinPartitions("node", "c")
    cut = ordered.mapInArrow(pieces, "node binary, first long, ids string")
    return cut.repartition("node").sortWithinPartitions("node", "first").mapInArrow(hashed, "node binary, ends_sha256 string")


def subtree_sums(nodes: DataFrame) -> DataFrame:
    """(node, n_leaves, saved_tokens) from (node, parent, depth, n_leaves, saved_tokens), where each node has its own share at first."""
    state, reach = cut_lineage(nodes.withColumnRenamed("parent", "up")), 1
    while state.where("up IS NOT NULL").limit(1).count():
        sent = state.where("up IS NOT NULL").groupBy(F.col("up").alias("node")).agg(
            F.sum("n_leaves").alias("more"), F.sum("saved_tokens").alias("saved"), F.count("*").alias("size"))
        sent = cut_lineage(sent)
        # an ancestor that has one itself: only below twice the reach, so the root, which all would ask for, is never looked up
        above = sent.select("node", "size").join(state.select("node", F.col("up").alias("next")), "node").where("next IS NOT NULL")
        far = state.where(F.col("depth") >= 2 * reach)
        far = hot_join(far.select(F.col("node").alias("low"), F.col("up").alias("node")), above, "node", "size").select(F.col("low").alias("node"), "next")
        added = state.join(sent, "node", "left").withColumn("n_leaves", F.col("n_leaves") + F.coalesce("more", F.lit(0)))
        added = added.withColumn("saved_tokens", F.col("saved_tokens") + F.coalesce("saved", F.lit(0))).select("node", "depth", "n_leaves", "saved_tokens")
        state = cut_lineage(added.join(far, "node", "left").withColumnRenamed("next", "up"))
        reach *= 2
    return state.select("node", "n_leaves", "saved_tokens")


def prefix_trie(conversations: DataFrame, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("c"), F.col("turn").alias("t"), text("role"), text("text"))
    rows, convs = rebuilt(turns)
    rows = written(rows, "rebuilt")
    total, least = convs.agg(F.count("*"), F.min("c")).first()
    shards = max(1, -(-total // shard))
    found = written(units(rows, shards, block), "units")
    nodes = found.groupBy("node", "parent", "depth", "words").agg(F.sum("members").alias("n_convs"), F.min("least").alias("conv_id"))
    root = convs.agg(F.count("*").alias("n_convs"), F.min("c").alias("conv_id")).where("n_convs > 0")
    root = root.select(F.lit(ROOT).alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("words"), "n_convs", "conv_id")
    nodes = written(nodes.unionByName(root), "nodes")

    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(
        F.count("*").alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("alone"))
    counted = nodes.join(children, "node", "left").fillna(0, ["n_children", "alone"])
    counted = written(counted, "counted")
    shared = counted.where("n_convs > 1 OR depth = 0").select(
        "node", "parent", "depth", (F.col("alone") + F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    sums = subtree_sums(shared)

    parents = counted.where("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    named = hot_join(counted.where("parent IS NOT NULL").select("node", "parent"), parents, "parent", "n_children").select("node", "parent_conv_id")
    ends = found.select("node", F.explode("ends").alias("c")).unionByName(convs.where("length = 0").select(F.lit(ROOT).alias("node"), "c"))
    out = counted.join(named, "node", "left").join(sums, "node", "left").join(end_hashes(ends), "node", "left")
    empty = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"),
                      F.coalesce("saved_tokens", F.lit(0)).cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))
