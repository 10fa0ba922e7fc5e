"""Chat formatting: roles of a plain transcript by a hidden Markov model, then canonical turns.

A transcript is a sequence of lines. Each line has a hidden state: a role, and whether the line begins a turn or continues
one. What is seen of a line is its speaker marker (if any), its length, and its form (blank, question, list or code).
The probabilities are counts over labelled turns, smoothed; the most likely path is found by Viterbi. Markers
that agree with the role found are cut off, and a turn is rendered as ``<|role|>``, its lines, and a line end.

Lines are range-sorted by transcript and place, and a task cuts its run of a transcript into pieces of at most ``PIECE``
lines. A piece is summarized by the best score from each state before it to each state at its end: such tables combine
in order, so a transcript of any length is decoded piece by piece, with the states at the seams settled by the
tables alone. The result is the same best path as over the whole transcript.

Edge cases: null text is empty, and an empty text is one blank line; null ids are one transcript, null places come first;
rows of equal id and place follow each other in the order of their text's hash; labels other than the three roles are
not learnt from; without labels the smoothing alone speaks, that is markers decide; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanloom.llm.common import whole_text, written
from gleanloom.scale import cut_lineage

ROLES = ("system", "user", "assistant")
STATES = [(role, begins) for role in ROLES for begins in (True, False)]
PIECE = 2_048
PIECE_CHARS = 4 << 20
#: Names of speakers by role.
SPEAKERS = {
    "system": "system|instructions?|sys",
    "user": "user|human|question|q|customer|me",
    "assistant": "assistant|ai|bot|answer|a|agent|model",
}
MARKER = re.compile(
    r"\s*(?:#{1,4}\s*|<\|?|\[|\*\*)?(?:" + "|".join(f"(?P<{r}>{names})" for r, names in SPEAKERS.items()) + r")\s*(?:\|?>|\]|\*\*)?\s*(?::|>|$|(?<=[>\]])\s)\s?", re.I
)
FORM = re.compile(r"\s*(?:[-*•]\s|\d+[.)]\s|```|\|)")
#: Kinds of observations and the number of codes of each.
CODES = {"marker": 4, "length": 9, "form": 4}


def marker_of(line: str) -> tuple[int, int]:
    """Role number of the line's speaker marker and the marker's length; (3, 0) without one."""
    found = MARKER.match(line)
    if not found:
        return 3, 0
    return next(k for k, role in enumerate(ROLES) if found.group(role) is not None), found.end()


def observed(line: str) -> tuple[int, int, int]:
    marker, cut = marker_of(line)
    rest = line[cut:]
    form = 0 if not rest.strip() else 1 if FORM.match(rest) else 2 if rest.rstrip().endswith("?") else 3
    return marker, min(8, len(rest.split()).bit_length()), form


class Model:
    """Log probabilities: start, transition and one table of emissions for each kind of observation."""

    def __init__(self, steps: dict[tuple[int, int], float], seen: dict[tuple[str, int, int], int]):
        n = len(STATES)
        start, move = np.full(n, -30.0), np.full((n, n), -30.0)
        begins = [k for k, (_, b) in enumerate(STATES) if b]
        first = np.array([1 + steps.get((-1, k), 0) for k in begins], float)
        start[begins] = np.log(first / first.sum())
        for k, (role, _) in enumerate(STATES):
            allowed = [j for j, (r, b) in enumerate(STATES) if b or r == role]
            counts = np.array([1 + steps.get((k, j), 0) for j in allowed], float)
            move[k, allowed] = np.log(counts / counts.sum())
        self.start, self.move, self.seen = start, move, {}
        for kind, codes in CODES.items():
            table = np.ones((n, codes))
            for k, (role, b) in enumerate(STATES):
                if kind == "marker":  # a marker speaks for its role, and hardly ever stands inside a turn
                    table[k] = [20.0 if b and ROLES[c] == role else 0.05 for c in range(3)] + [10.0 if b else 200.0]
                table[k] += [seen.get((kind, k, c), 0) for c in range(codes)]
            self.seen[kind] = np.log(table / table.sum(axis=1, keepdims=True))

    def emissions(self, lines: list[str]) -> np.ndarray:
        codes = np.array([observed(line) for line in lines], np.int64).reshape(-1, 3)
        return sum(self.seen[kind][:, codes[:, k]] for k, kind in enumerate(CODES)).T

    def summary(self, lines: list[str]) -> np.ndarray:
        """Best score to each state at the end: from the start of the transcript, then from each state before the piece."""
        emissions = self.emissions(lines)
        best = np.vstack([self.start, self.move]) + emissions[0]
        for row in emissions[1:]:
            best = (best[:, :, None] + self.move[None]).max(axis=1) + row
        return best

    def path(self, lines: list[str], entry: int = -1, leave: int = -1) -> list[int]:
        """Most likely states, given the state before the first line and that of the last one (-1: none, free)."""
        emissions = self.emissions(lines)
        best = (self.start if entry < 0 else self.move[entry]) + emissions[0]
        back = []
        for row in emissions[1:]:
            total = best[:, None] + self.move
            back.append(total.argmax(axis=0))
            best = total.max(axis=0) + row
        states = [int(best.argmax()) if leave < 0 else leave]
        for pointers in reversed(back):
            states.append(int(pointers[states[-1]]))
        return states[::-1]


def seams(summaries: list[np.ndarray]) -> list[tuple[int, int]]:
    """(state before, state at the end) of each piece of one transcript, in order."""
    best, back = summaries[0][0], []
    for summary in summaries[1:]:
        total = best[:, None] + summary[1:]
        back.append(total.argmax(axis=0))
        best = total.max(axis=0)
    ends = [int(best.argmax())]
    for pointers in reversed(back):
        ends.append(int(pointers[ends[-1]]))
    ends.reverse()
    return list(zip([-1, *ends[:-1]], ends))


def fit(turns: DataFrame, conversation: str, turn: str, role: str, text: str) -> Model:
    """Counts over all labelled turns: a few hundred numbers reach the driver.

    Rows of equal conversation and turn are reduced to counts before neighbouring turns meet, at most six for a turn. A row that repeats
    counts once for each time, as it does in the emissions, and its predecessor is the average of all rows of the turn before.
    """
    known = turns.select(F.col(f"`{conversation}`").alias("c"), F.col(f"`{turn}`").cast("long").alias("t"), F.lower(F.col(f"`{role}`").cast("string")).alias("r"),
                         whole_text(text).alias("x")).where(F.col("r").isin(*ROLES))
    sized = known.select("c", "t", "r", F.size(F.split("x", "\n")).alias("size"))
    sized = sized.groupBy("c", "t", "r", (F.col("size") > 1).alias("long")).agg(F.count("*").alias("n"), F.sum(F.greatest(F.col("size") - 2, F.lit(0))).alias("more"))
    sized = cut_lineage(sized)
    totals = sized.groupBy("c", (F.col("t") + 1).alias("t")).agg(F.sum("n").alias("before"))
    own = sized.groupBy("c", "t", "r").agg(F.sum("n").alias("n")).join(totals, ["c", "t"], "left")
    begin = {r: STATES.index((r, True)) for r in ROLES}
    steps: dict[tuple[int, int], float] = {}

    def add(a: int, b: int, n: float) -> None:
        steps[a, b] = steps.get((a, b), 0) + n

    previous = sized.select("c", (F.col("t") + 1).alias("t"), F.col("r").alias("p"), "long", F.col("n").alias("of"))
    # in millionths, so that the sums are whole and do not depend on their order
    part = F.round(F.col("n") * (F.col("of") / F.col("before")) * 1_000_000).cast("long")
    for row in own.where("before > 0").join(previous, ["c", "t"]).groupBy("p", "r", "long").agg(F.sum(part).alias("n")).collect():
        add(begin[row["p"]] + int(row["long"]), begin[row["r"]], row["n"] / 1_000_000)
    for row in own.where("before IS NULL").groupBy("r").agg(F.sum("n").alias("first")).collect():
        add(-1, begin[row["r"]], row["first"])
    for row in sized.groupBy("r").agg(F.sum(F.when(F.col("long"), F.col("n")).otherwise(0)).alias("two"), F.sum("more").alias("more")).collect():
        add(begin[row["r"]], begin[row["r"]] + 1, row["two"])
        add(begin[row["r"]] + 1, begin[row["r"]] + 1, row["more"])

    def count(batches):
        for batch in batches:
            seen: dict[tuple, int] = {}
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for k, line in enumerate(value.split("\n")):
                    for kind, code in zip(CODES, observed(line)):
                        key = (kind, STATES.index((name, k == 0)), code)
                        seen[key] = seen.get(key, 0) + 1
            yield pa.RecordBatch.from_pylist([{"kind": a, "state": b, "code": c, "n": n} for (a, b, c), n in seen.items()],
                                             pa.schema([("kind", pa.string()), ("state", pa.int32()), ("code", pa.int32()), ("n", pa.int64())]))

    found = known.select("r", "x").mapInArrow(count, "kind string, state int, code int, n long").groupBy("kind", "state", "code").agg(F.sum("n").alias("n"))
    return Model(steps, {(r["kind"], r["state"], r["code"]): r["n"] for r in found.collect()})


def pieces(parts: DataFrame, model: Model, limit: int = PIECE) -> DataFrame:
    """(id, piece, summary, places, lines) of rows (id, place, text): consecutive lines of one transcript."""
    def cut(batches):
        number, current, places, lines, chars = TaskContext.get().partitionId() << 32, None, [], [], 0

        def row():
            summary = model.summary(lines).reshape(-1)
            return pa.RecordBatch.from_arrays(
                [pa.array([current[0]], id_type), pa.array([number], pa.int64()), pa.array([summary.tolist()], pa.list_(pa.float64())),
                 pa.array([places], pa.list_(pa.int64())), pa.array([lines], pa.list_(pa.string()))], ["id", "piece", "summary", "places", "lines"])

        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for key, place, text in zip(*[c.to_pylist() for c in batch.columns]):
                for line in text.split("\n"):
                    if current is not None and (current[0] != key or len(lines) >= limit or chars > PIECE_CHARS):
                        yield row()
                        number, places, lines, chars = number + 1, [], [], 0
                    current = (key,)
                    places.append(place)
                    lines.append(line)
                    chars += len(line)
        if current is not None:
            yield row()

    key = parts.schema["id"].dataType.simpleString()
    spread = F.xxhash64("text")
    ordered = parts.repartitionByRange("id", "place", spread).sortWithinPartitions("id", "place", spread)
    return ordered.mapInArrow(cut, f"id {key}, piece long, summary array<double>, places array<long>, lines array<string>")


def settled(cut: DataFrame) -> DataFrame:
    """(id, piece, entry, leave) of the pieces of transcripts that have several; only their tables of 42 numbers are gathered."""
    key = cut.schema["id"].dataType.simpleString()
    several = cut.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("_id"))
    small = cut.select("id", "piece", "summary").join(several, F.col("id").eqNullSafe(F.col("_id"))).drop("_id")

    def settle(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("piece")
        states = seams([np.array(s).reshape(-1, len(STATES)) for s in frame["summary"]])
        return pd.DataFrame({"piece": frame["piece"], "entry": [a for a, _ in states], "leave": [b for _, b in states]})

    return small.groupBy("id").applyInPandas(settle, "piece long, entry int, leave int")


def parsed(parts: DataFrame, model: Model, limit: int = PIECE) -> DataFrame:
    """(id, piece, number, place, begins, role, n_lines, content, rendered): a row per turn, or per part of a turn that a seam divides.

    In the order of piece and number the rendered parts of a transcript make up its canonical form.
    """
    key = parts.schema["id"].dataType.simpleString()
    cut = written(pieces(parts, model, limit), "pieces", compression="zstd")
    states = settled(cut)
    joined = cut.select("id", "piece", "places", "lines").join(states, "piece", "left")
    joined = joined.select("id", "piece", "places", "lines", F.coalesce("entry", F.lit(-1)).alias("entry"), F.coalesce("leave", F.lit(-1)).alias("leave"))

    def decode(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(9)]
            for id_, piece, places, lines, entry, leave in zip(*[c.to_pylist() for c in batch.columns]):
                path = model.path(lines, entry, leave)
                starts = [k for k, s in enumerate(path) if k == 0 or STATES[s][1]]
                for number, (a, b) in enumerate(zip(starts, [*starts[1:], len(path)])):
                    role, begins = STATES[path[a]]
                    kept = [line[marker_of(line)[1] :] if STATES[s][1] and ROLES[min(marker_of(line)[0], 2)] == role else line for line, s in zip(lines[a:b], path[a:b])]
                    content = "\n".join(kept)
                    rendered = (f"<|{role}|>\n" if begins else "") + content + "\n"
                    for column, value in zip(out, (id_, piece, number, places[a], begins, role, b - a, content, rendered)):
                        column.append(value)
            kinds = [batch.schema.field(0).type, pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.string(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["id", "piece", "number", "place", "begins", "role", "n_lines", "content", "rendered"])

    return joined.mapInArrow(decode, f"id {key}, piece long, number int, place long, begins boolean, role string, n_lines int, content string, rendered string")


def as_transcript(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(id, place, role, text): turns as people paste them. Three of four begin with a speaker marker in one of some styles; some end with a blank line."""
    c, t = F.col(f"`{conversation}`"), F.col(f"`{turn}`").cast("long")
    style = F.pmod(F.xxhash64(F.lit("style"), c), F.lit(4))
    marked = F.pmod(F.xxhash64(F.lit("marked"), c, t), F.lit(4)) > 0
    r = F.lower(F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")))
    short = F.when(r == "user", "Q").when(r == "assistant", "A").otherwise("System")
    other = F.when(r == "user", "Human").when(r == "assistant", "AI").otherwise("System")
    marker = F.when(style == 0, F.concat(F.initcap(r), F.lit(": "))).when(style == 1, F.concat(F.lit("### "), other, F.lit(": "))).when(
        style == 2, F.concat(short, F.lit(": "))).otherwise(F.concat(F.lit("<|"), r, F.lit("|> ")))
    blank = F.when(F.pmod(F.xxhash64(F.lit("blank"), c), F.lit(3)) == 0, F.lit("\n")).otherwise(F.lit(""))
    body = F.concat(F.when(marked & r.isin(*ROLES), marker).otherwise(F.lit("")), whole_text(text), blank)
    return turns.select(c.alias("id"), t.alias("place"), r.alias("role"), body.alias("text"))
