"""Sharding by a permutation-filled lookup table.

Every shard has a permutation of the slots of a table of prime size, drawn from its name. The shards take
turns, each claiming the first slot of its permutation that is still free, until the table is full: no two
shards differ by more than one slot, and when a shard joins or leaves few slots change hands. The table is
bounded by ``table_size``, which proves the size of the broadcast; a row is placed by one hash and one lookup.

Edge cases: a null key is placed like an empty one; equal keys share a shard; an empty table gives no rows.
Input columns named like a result column give way to it.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanloom.llm.common import hash60, put

TABLE_SIZE = 65_537
SHARDS = 64


def shard_names(count: int = SHARDS) -> list[str]:
    return [f"shard-{i:05d}" for i in range(count)]


def is_prime(number: int) -> bool:
    return number > 1 and all(number % d for d in range(2, int(number**0.5) + 1))


def preference(name: str, size: int) -> tuple[int, int]:
    """First slot and step of a shard's permutation; any step from 1 to size - 1 visits every slot of a prime-sized table."""
    digest = hashlib.md5(name.encode()).hexdigest()
    return int(digest[:15], 16) % size, int(digest[15:30], 16) % (size - 1) + 1


def fill_table(names: list[str], size: int = TABLE_SIZE) -> list[int]:
    """For each slot the index of its shard. Names must be distinct, and the size a prime no smaller than their number."""
    if not is_prime(size) or not 0 < len(names) <= size or len(set(names)) != len(names):
        raise ValueError("the table needs a prime size and one to that many distinct shard names")
    owner = [-1] * size
    places = [preference(name, size) for name in names]
    turn = [0] * len(names)
    free = size
    while free:
        for shard, (first, step) in enumerate(places):
            slot = (first + turn[shard] * step) % size
            while owner[slot] >= 0:
                turn[shard] += 1
                slot = (first + turn[shard] * step) % size
            owner[slot] = shard
            turn[shard] += 1
            free -= 1
            if not free:
                break
    return owner


def lookup_table(spark: SparkSession, names: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """The filled table as rows (slot, shard)."""
    return spark.createDataFrame(list(enumerate(fill_table(names, size))), "slot long, shard int")


def assign_shards(df: DataFrame, key: Column, names: list[str] | None = None, size: int = TABLE_SIZE) -> DataFrame:
    """Add ``slot`` and ``shard``. No shuffle: rows meet the broadcast table where they lie.

    The key should be one that no large part of the rows shares (a document id, not a source).
    """
    names = names or shard_names()
    table = lookup_table(df.sparkSession, names, size).toDF("_slot", "_shard")
    placed = df.withColumn("_slot", hash60(key) % size).join(F.broadcast(table), "_slot", "left")
    return put(placed, {"slot": F.col("_slot"), "shard": F.col("_shard")}).drop("_slot", "_shard")


def write_shards(df: DataFrame, path: str) -> None:
    """Write one folder per shard. The rebalance hint splits a large shard over several tasks and files."""
    df.hint("rebalance", "shard").write.partitionBy("shard").parquet(path)
