"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanloom.scale import written  # noqa: F401  (taken from here by the operators of this subpackage)

#: A key that holds more than one of so many parts of all rows is hot; there are at most so many of them.
HOT = 10_000

#: Separators of words in the contract of the mixing operator: blank and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def whole_text(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def hash60(key: Column) -> Column:
    """60 bits of a key's MD5 as a long: the same value in every engine and on every rerun; null hashes as ''."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def sql_hash60(key: str) -> str:
    """The same number in DuckDB."""
    return f"CAST('0x' || substr(md5(coalesce(CAST({key} AS VARCHAR), '')), 1, 15) AS BIGINT)"


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text leaves 1 on division by 3; a null id counts as ''."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3) == 1


def squeezed(values: np.ndarray) -> bytes:
    """A column of numbers, byte by byte and compressed."""
    if not len(values):
        return b""
    values = np.ascontiguousarray(values)
    planes = values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()
    return len(values).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def opened(data: bytes, dtype) -> np.ndarray:
    """The numbers of ``squeezed``."""
    if not data:
        return np.zeros(0, dtype)
    n, width = int.from_bytes(data[:8], "little"), np.dtype(dtype).itemsize
    planes = pa.decompress(data[8:], n * width, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, n).T).reshape(-1).view(dtype)


def packed(values: np.ndarray) -> bytes:
    """Ascending unsigned numbers as differences."""
    return squeezed(np.diff(values, prepend=values.dtype.type(0)))


def unpacked(data: bytes, dtype) -> np.ndarray:
    return np.cumsum(opened(data, dtype), dtype=dtype)


def put(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add result columns; an input column of the same name (in any case) gives way to the result."""
    names = {name.lower() for name in columns}
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in names]
    return df.select(*kept, *[value.alias(name) for name, value in columns.items()])


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that the frame lacks, in any case."""
    taken = {c.lower() for c in df.columns}
    while f"_{name}".lower() in taken:
        name += "_"
    return f"_{name}"


def hot_join(rows: DataFrame, facts: DataFrame, key: str, size: str, hot: int = HOT) -> DataFrame:
    """Inner join with facts of unique keys, of which ``size`` tells the number of rows that hold the key.

    Keys of more than one of ``hot`` parts of all these rows are at most ``hot`` in number: they are broadcast, and their rows stay where
    they are. What is left is joined by shuffle, without hot keys. Both frames are read twice, so they should be written tables.
    """
    total = facts.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    large = facts.where(F.col(size) * hot > total).where(F.col(size) > 1)
    small = facts.where((F.col(size) * hot <= total) | (F.col(size) <= 1))
    cold = rows.join(F.broadcast(large.select(key)), key, "left_anti").join(small, key)
    return cold.unionByName(rows.join(F.broadcast(large), key))
