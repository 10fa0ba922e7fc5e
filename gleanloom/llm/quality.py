"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

Fitting takes a bounded sample of labelled rows (``PER_LABEL`` per label, by the order of a hash of the id).
A text is a vector of hashed features: its words, their prefixes and suffixes, their shapes (case, digits, punctuation), neighbouring
shapes, and a few measures of the whole text (share of repeated words, lengths, kinds of characters) put
into bins. Counts are damped, weighted by inverse document frequency and normalised; the truncated singular value
decomposition of the sample's matrix gives the latent space. The labelled vectors and the projection have a size fixed
by the parameters and travel to every task, where each block of documents meets all labelled vectors in one exact
matrix product. The ``NEIGHBOURS`` nearest vote with the power ``SHARPNESS`` of their cosine.

Edge cases: null text is empty, and scored like any other; a text that shares nothing with the sample gets the sample's share
of label 1; without labelled rows every score is 0.5; repeated rows score alike; null ids count as an empty id;
labels other than 0 and 1 and rows of disagreeing labels are not learnt from; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanloom.llm.common import held_out, whole_text
from gleanloom.scale import cut_lineage

PER_LABEL = 700
FEATURES = 1 << 14
COLUMNS = 1 << 10
LATENT = 48
NEIGHBOURS = 15
SHARPNESS = 4.0
BLOCK = 256
CUT = 0.5
_SHAPES = ((re.compile(r"[^\W\d_]*[a-zß-öø-ÿ][^\W\d_]*"), "a"), (re.compile(r"[^\W\d_]+"), "A"), (re.compile(r"\d+"), "0"))


class Shapes(dict):
    """Feature numbers of a word: itself, its ends and its shape. Forgets all when it has grown large."""

    def __missing__(self, word: str) -> tuple[tuple[int, ...], str]:
        if len(self) > 300_000:
            self.clear()
        shape = word
        for pattern, letter in _SHAPES:
            shape = pattern.sub(letter, shape)
        value = self[word] = (numbers(f"s {shape[:12]}", f"w {word}", f"e {word[-3:].lower()}"), shape[:12])
        return value


def numbers(*names: str) -> tuple[int, ...]:
    return tuple(zlib.crc32(n.encode("utf-8", "surrogatepass")) % FEATURES for n in names)


def measures(text: str, words: list[str], kinds: int) -> list[str]:
    """Measures of the whole text, in bins."""
    size, letters = max(len(text), 1), sum(map(len, words))
    lines = text.split("\n")
    capitals = sum(map(str.isupper, words)) / max(len(words), 1)
    return [
        f"m repeated {int(10 * kinds / max(len(words), 1))}",
        f"m words {min(12, len(words).bit_length())}",
        f"m word length {min(15, letters // max(len(words), 1))}",
        f"m line length {min(14, (size // len(lines)).bit_length())}",
        f"m repeated lines {int(10 * len(set(lines)) / len(lines))}",
        f"m capitals {int(10 * capitals)}",
        f"m runs {int(10 * sum(map(str.__eq__, words, words[1:])) / max(len(words), 1))}",
    ]


def features(text: str, cache: Shapes) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and damped counts of a text."""
    words = text.split()
    counts = Counter(words)
    total: Counter = Counter()
    shapes: Counter = Counter()
    for word, n in counts.items():
        own, shape = cache[word]
        shapes[shape] += n
        for number in own[1:]:
            total[number] += n
    for shape, n in shapes.items():
        total[numbers(f"s {shape}")[0]] += 4 * n
    for number in numbers(*measures(text, words, len(counts))):
        total[number] += 8 + len(words) // 4
    index = np.fromiter(total.keys(), np.int64, len(total))
    return index, 1 + np.log(np.fromiter(total.values(), np.float64, len(total)))


@dataclass
class Model:
    """Everything a task needs; its size follows from the parameters alone."""

    projection: np.ndarray  # features x latent, with the idf in it
    vectors: np.ndarray  # labelled texts x latent, unit length
    labels: np.ndarray
    share: float


def fit(texts: list[str], labels: list[int], latent: int = LATENT) -> Model:
    """Singular vectors come from the matrix of the sample's inner products, which is as small as the sample.

    The matrix of texts and features is never whole: its entries are kept, and ``COLUMNS`` features of it are laid out at a time.
    """
    cache = Shapes()
    found = [features(text, cache) for text in texts]
    cache.clear()
    column = np.concatenate([index for index, _ in found])
    row = np.repeat(np.arange(len(texts)), [len(index) for index, _ in found])
    idf = np.log((1 + len(texts)) / (1 + np.bincount(column, minlength=FEATURES))) + 1
    value = np.concatenate([v.astype(np.float32) for _, v in found]) * idf.astype(np.float32)[column]
    value /= np.maximum(np.sqrt(np.bincount(row, value.astype(np.float64) ** 2, len(texts))), 1e-12).astype(np.float32)[row]
    order = np.argsort(column, kind="stable")
    row, column, value = row[order], column[order], value[order]

    def blocks():
        for start in range(0, FEATURES, COLUMNS):
            i, j = np.searchsorted(column, [start, start + COLUMNS])
            block = np.zeros((len(texts), COLUMNS), np.float32)
            block[row[i:j], column[i:j] - start] = value[i:j]
            yield start, block

    inner = np.zeros((len(texts), len(texts)))
    for _, block in blocks():
        inner += block @ block.T
    size, left = np.linalg.eigh(inner)
    order = np.argsort(-size)[: min(latent, len(texts))]
    order = order[size[order] > 1e-9]
    side, right, vectors = left[:, order].astype(np.float32), np.empty((FEATURES, len(order)), np.float32), np.zeros((len(texts), len(order)))
    for start, block in blocks():
        right[start : start + COLUMNS] = (block.T @ side) / np.sqrt(size[order]).astype(np.float32)
        vectors += block @ right[start : start + COLUMNS]
    projection = (right * idf[:, None]).astype(np.float32)
    return Model(projection, unit(vectors).astype(np.float32), np.array(labels, np.float32), float(np.mean(labels)))


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def latent_vector(text: str, model: Model, cache: Shapes) -> np.ndarray:
    index, value = features(text, cache)
    vector = value.astype(np.float32) @ model.projection[index]
    return vector / max(float(np.linalg.norm(vector)), 1e-12)


def votes(vectors: np.ndarray, model: Model, neighbours: int = NEIGHBOURS, sharpness: float = SHARPNESS) -> np.ndarray:
    """Scores of a block of documents. Equal cosines are taken in the order of the sample."""
    cosine = np.clip(vectors @ model.vectors.T, 0, 1)
    near = np.argsort(-cosine, axis=1, kind="stable")[:, :neighbours]
    weight = np.take_along_axis(cosine, near, axis=1).astype(np.float64) ** sharpness
    total = weight.sum(axis=1)
    score = (weight * model.labels[near]).sum(axis=1) / np.maximum(total, 1e-12)
    return np.where(total > 1e-9, np.clip(score, 0, 1), model.share)


def labelled_sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, per_label: int) -> list:
    """(_text, _label) of at most ``per_label`` rows of each label, by a hash of their id.

    The ids are chosen first, without texts; they are bounded by the parameter and broadcast to fetch their texts.
    """
    known = labels.where(F.col(f"`{label}`").isin(0, 1)).groupBy(F.col(f"`{doc_id}`").alias("_id")).agg(
        F.min(f"`{label}`").alias("_label"), F.max(f"`{label}`").alias("_other"))
    known = known.where("_label = _other").where(~held_out(F.col("_id")))
    known = known.select("_id", F.col("_label").cast("int").alias("_label"), F.xxhash64("_id").alias("_order"))
    known = known.join(docs.select(F.col(f"`{doc_id}`").alias("_id")), "_id", "left_semi")
    sides = [known.where(F.col("_label") == value).orderBy("_order", "_id").limit(per_label) for value in (0, 1)]
    chosen = cut_lineage(sides[0].unionByName(sides[1]))
    rows = docs.select(F.col(f"`{doc_id}`").alias("_id"), whole_text(text).alias("_text")).join(F.broadcast(chosen), "_id")
    first = rows.groupBy("_id", "_label", "_order").agg(F.min("_text").alias("_text"))
    return sorted(first.select("_label", "_order", "_text").collect(), key=lambda r: (r["_label"], r["_order"], r["_text"]))


def fitted(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
           per_label: int = PER_LABEL) -> Model | None:
    rows = labelled_sample(docs, labels, doc_id, text, label, per_label)
    return fit([r["_text"] for r in rows], [r["_label"] for r in rows]) if rows else None


def scorer(model: Model | None, position: int):
    def score(batches):
        cache = Shapes()
        for batch in batches:
            texts = batch.column(position).to_pylist()
            out = np.full(len(texts), 0.5)
            if model is not None:
                for start in range(0, len(texts), BLOCK):
                    block = texts[start : start + BLOCK]
                    out[start : start + BLOCK] = votes(np.stack([latent_vector(t or "", model, cache) for t in block]), model)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "_score"])

    return score


def scored(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The rows with one more column, ``_score``."""
    schema = T.StructType([*docs.schema.fields, T.StructField("_score", T.DoubleType())])
    return docs.mapInArrow(scorer(model, docs.columns.index(text)), schema)


def quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    out = scored(rows, fitted(docs, labels, doc_id, text))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"),
                      (F.col("_score") >= CUT).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that are predicted to be of quality, with their columns as they are."""
    return scored(docs, fitted(docs, labels, doc_id, text), text).where(F.col("_score") >= CUT).drop("_score")
