"""Cutting texts into segments that tokenizers never join, so that each distinct segment is encoded once."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Segments that are encoded as one text: long enough to save calls, short enough for the processor's cache.
JOINED = 50

GLUED = re.compile(r"\s ")
_CUTS = re.compile(r"(?<!\s) ")


def segments(text: str) -> list[str]:
    """The text cut at each blank that follows no white space. All but the first are written without the blank before them.

    Byte-level pre-tokenizers never join a blank with a character before it that isn't white space, and piece vocabularies
    without a blank inside a piece cannot merge across it, so the tokens of a text are those of its segments.
    """
    return _CUTS.split(text) if GLUED.search(text) else text.split(" ")


def chunks_of(items: list[str], size: int = JOINED) -> list[list[str]]:
    """Segments that can be joined to one text; those that end in white space, or are a mere blank, stay alone."""
    open_ended = [s for s in items if not s or s[-1].isspace()]
    if open_ended:
        alone = set(open_ended)
        items = [s for s in items if s not in alone]
    return [items[i : i + size] for i in range(0, len(items), size)] + [[s] for s in open_ended]


def runs_of(batch: pa.RecordBatch, size: int = 1 << 20):
    """(ids, texts) of runs of rows (id, text) of about so many bytes; only a run's texts are Python strings at a time."""
    lengths = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
    start = 0
    while start < len(lengths):
        before = lengths[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(lengths, before + size, "right")))
        yield batch.column(0)[start:end], batch.column(1)[start:end].to_pylist()
        start = end
