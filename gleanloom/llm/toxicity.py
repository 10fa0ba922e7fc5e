"""Toxicity by a weighted lexicon, matched by Aho-Corasick after folding look-alike letters and digits.

Folding: lower case, look-alike letters of other scripts to Latin ones, digits and signs that stand for letters inside
words to those letters; whatever is left between letters becomes one blank. Entries of the lexicon are whole words
or beginnings of words. They are learnt from a bounded sample of labelled rows: the weight is the log odds of an
entry's share of toxic against clean texts; entries are chosen greedily so that each toxic text is met by up to
``COVER`` of them, which keeps words out that merely happen to be in copies of one toxic text. Where an entry also occurs in clean
texts, words and pairs of words around it that only clean texts have become exception phrases: a hit inside one does
not count. The score takes the summed weight of the hits, damped by repetition and normalised by the text's length, through a
logistic curve fitted on the sample.

Edge cases: null text is empty; a text without hits gets the curve's lowest score; without labels of both kinds every score is
0; null ids count as an empty id; repeated rows score alike; labels other than 0 and 1 and rows of disagreeing
labels are not learnt from; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanloom.llm.common import held_out, whole_text
from gleanloom.llm.quality import labelled_sample

PER_LABEL = 2_000
COVER = 5
LEAST = 8
LEAST_WEIGHT = 2.0
BEGINNINGS = (3, 4, 5, 6, 7)
CUT = 0.7

#: Letters of other scripts that look like Latin ones, after lower-casing.
LOOKALIKES = str.maketrans(
    "абвгдеёзикмнорстухіјѕԁһӏɑαβεηικνορτυχω",
    "abbrdee3ukmhopctyxijsdhlaabenikvoptuxw",
)
#: Digits and signs that stand for letters inside words; l and i fall together, as 1 stands for both.
DIGITS = str.maketrans("0134578@$!|l", "oieastbasiii")
_DISGUISED = re.compile(r"[^\W\d_]*(?:[0134578@$!|]+[^\W\d_]+)+[0134578@$|]*|[^\W\d_]+[0134578@$|]+(?=\W|$)")
_LETTERS = re.compile(r"[^\W\d_]+")
_SIGNS = re.compile(r"[0134578@$!|]")


def folded(text: str) -> list[str]:
    """The text's words in folded form."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = text.lower()
    if not text.isascii():
        text = text.translate(LOOKALIKES)
    if _SIGNS.search(text):
        text = _DISGUISED.sub(lambda m: m.group().translate(DIGITS), text)
    return _LETTERS.findall(text.replace("l", "i"))


def entries_of(word: str) -> list[str]:
    """A whole word is framed by blanks, a beginning has one in front."""
    return [f" {word} ", *[f" {word[:n]}" for n in BEGINNINGS if n < len(word)]]


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    curve: tuple[float, ...] = (0.0, 0.0, 0.0)
    trained: bool = False


def learn(texts: list[str], labels: list[int], least_weight: float = LEAST_WEIGHT) -> Lexicon:
    """Lexicon, exceptions and curve from the sample; equal texts count once."""
    sample = list(dict.fromkeys(zip(map(" ".join, map(folded, texts)), labels)))
    toxic, clean = [t for t, y in sample if y], [t for t, y in sample if not y]
    if not toxic or not clean:
        return Lexicon({})
    found = [frozenset(e for w in set(t.split()) for e in entries_of(w)) for t in toxic]
    hits = Counter(e for own in found for e in own)
    hits = {e: n for e, n in hits.items() if n >= LEAST}
    misses: Counter = Counter()
    for text in clean:
        misses.update({e for w in set(text.split()) for e in entries_of(w) if e in hits})

    def weight(e: str) -> float:
        return math.log((hits[e] + 0.5) / (len(toxic) + 1)) - math.log((misses[e] + 0.5) / (len(clean) + 1))

    weights = {e: w for e in hits if (w := weight(e)) >= least_weight}
    chosen = cover([own & weights.keys() for own in found], weights)
    lexicon = Lexicon({e: weights[e] for e in chosen})
    lexicon.exceptions = exceptions(lexicon, toxic, clean)
    lexicon.curve = curve(lexicon, sample)
    lexicon.trained = True
    return lexicon


def cover(found: list, weights: dict[str, float]) -> list[str]:
    """Entries by the toxic texts that they newly help to cover; longer ones, which say more, first where they tie.

    Of an entry and its own beginnings only those stay that differ in the texts they meet.
    """
    holders: dict[str, list[int]] = {}
    for k, own in enumerate(found):
        for e in own:
            holders.setdefault(e, []).append(k)
    times, chosen = [0] * len(found), []
    gains = {e: len(ks) for e, ks in holders.items()}
    while gains:
        while True:  # gains only shrink: recount the leader until it stays the leader
            best = max(gains, key=lambda e: (gains[e] * weights[e], len(e), e))
            now = sum(times[k] < COVER for k in holders[best])
            if now == gains[best]:
                break
            gains[best] = now
        if gains[best] < LEAST:
            break
        chosen.append(best)
        del gains[best]
        for k in holders[best]:
            times[k] += 1
        much = 1.1 * len(holders[best])
        same = {e for e in gains if e.startswith(best) or best.startswith(e) and len(holders[e]) <= much}
        gains = {e: n for e, n in gains.items() if e not in same and n >= LEAST}
    return chosen


def exceptions(lexicon: Lexicon, toxic: list[str], clean: list[str], least: int = 2) -> list[str]:
    """Phrases around hits that at least ``least`` clean texts and no toxic text hold."""
    if not lexicon.weights:
        return []
    automaton = built(lexicon)

    def phrases(text: str) -> set[str]:
        padded, out = f" {text} ", set()
        for end, (entry, _) in automaton.iter(padded):
            start = end - len(entry) + 2
            stop = padded.index(" ", start)
            before = padded.rfind(" ", 0, start - 1)
            after = padded.find(" ", stop + 1)
            out.add(padded[start - 1 : stop + 1])
            if before >= 0:
                out.add(padded[before : stop + 1])
            if after >= 0:
                out.add(padded[start - 1 : after + 1])
        return out

    seen = Counter(p for text in clean for p in phrases(text))
    if not seen:
        return []
    bad = {p for text in toxic for p in phrases(text)}
    return sorted(p for p, n in seen.items() if n >= least and p not in bad)


def built(lexicon: Lexicon) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for e, w in lexicon.weights.items():
        automaton.add_word(e, (e, w))
    for e in lexicon.exceptions:
        automaton.add_word(e, (e, lexicon.weights.get(e, 0.0)))
    automaton.make_automaton()
    return automaton


def outside(spans: list[tuple], free: list[tuple]) -> list[tuple]:
    """Spans that lie in none of the free ones. Both come in the order of their ends: one merge, with the free spans' starts kept as a
    stack in which only those count that begin before all later ones."""
    kept, stack, at = [], [], len(free)
    for span in reversed(spans):
        while at and free[at - 1][1] >= span[1]:
            at -= 1
            if not stack or free[at][0] < stack[-1]:
                stack.append(free[at][0])
        if not stack or stack[-1] > span[0]:
            kept.append(span)
    return kept[::-1]


def measures(text: str, automaton, exempt: frozenset) -> tuple[float, float]:
    """Damped weight of the hits, as it is and per hundred words."""
    if not len(automaton):
        return 0.0, 0.0
    padded = f" {text} "
    spans, free = [], []
    for end, (entry, weight) in automaton.iter(padded):
        (free if entry in exempt else spans).append((end - len(entry) + 1, end, entry, weight))
    if free:
        spans = outside(spans, free)
    counts = Counter(s[2] for s in spans)
    weights = {s[2]: s[3] for s in spans}
    total = sum(weights[e] * (1 + math.log(n)) for e, n in sorted(counts.items()))
    return math.log1p(total), math.log1p(100 * total / (1 + padded.count(" ")))


def curve(lexicon: Lexicon, sample: list, steps: int = 30, ridge: float = 0.05) -> tuple[float, ...]:
    """Logistic regression on the two measures by Newton's method."""
    automaton, exempt = built(lexicon), frozenset(lexicon.exceptions)
    x = np.array([(1.0, *measures(t, automaton, exempt)) for t, _ in sample])
    y = np.array([label for _, label in sample], float)
    b = np.zeros(3)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(3)
        b = b + np.linalg.solve(hessian, x.T @ (y - p) - ridge * b)
    return tuple(float(v) for v in b)


def scorer(lexicon: Lexicon):
    def score(batches):
        automaton, exempt = built(lexicon), frozenset(lexicon.exceptions)
        b = lexicon.curve
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                if lexicon.trained:
                    total, rate = measures(" ".join(folded(text or "")), automaton, exempt)
                    out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, b[0] + b[1] * total + b[2] * rate)))))
                else:
                    out.append(0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])

    return score


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
             per_label: int = PER_LABEL) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    rows = labelled_sample(docs, labels, doc_id, text, label, per_label)
    lexicon = learn([r["_text"] for r in rows], [r["_label"] for r in rows])
    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), whole_text(text).alias("text"))
    scores = own.mapInArrow(scorer(lexicon), f"doc_id {own.schema['doc_id'].dataType.simpleString()}, score double")
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= CUT).cast("int").alias("predicted"))
