"""Personal data: base patterns, and a boosted classifier of candidate spans.

Base spans are leftmost, non-overlapping matches of four patterns; those that fail their check (parts up to 255, Luhn
sum, numbers of digits) are dropped and nothing is tried in their place. Beyond them, generators with high recall propose
spans that may overlap: numbers with loose separators, secrets after a keyword, long mixed strings and
spelled-out mail addresses. Gradient-boosted trees score each by its format and context. The trees are fitted on distinct texts
(of each kind and label at most ``PER_GROUP`` candidates, by hash), with labels from the checks
that the trees do not see: checksums, a leading plus, a keyword. Candidates that repeat a base span are never added, so they are
neither learnt from nor counted for the cuts. On all candidates of a held-out third of the distinct texts each kind
gets the lowest threshold at which its precision reaches ``PRECISION``; a kind without any there gets ``DEFAULT_CUT``.

Everything is SQL functions on arrays within a row, without Python; only the candidates' features are shuffled. The patterns are written so that Java's matcher
runs in linear time and constant stack (possessive groups, no start inside a run), with the same matches as their plain forms.

Edge cases: null text is empty; rows without spans have an empty string; without candidates of both labels there are no trees, and
the base spans alone are returned; null and repeated ids are rows like others; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanloom.llm.common import whole_text, written
from gleanloom.scale import cut_lineage, explode_once, top_ranked

LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KEYWORD = r"(?i)(?:password|passwd|pwd|secret|token|api.?key|access.?key|auth)"
#: Kind, pattern, and a cheap test that a text must pass to be searched.
GENERATORS = {
    "number": (r"[0-9](?:[\x20().-]{0,2}[0-9]){6,}+", "[0-9]"),
    "secret": (KEYWORD + r"[\"']?\x20?[=:]\x20?[\"']?[A-Za-z0-9+/_.-]{6,}+", KEYWORD),
    "mixed": (r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+", "[A-Za-z0-9+/_-]{20}"),
    "address": (r"(?i)(?<![\w.%+-])[\w.%+-]{1,64}+\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?[\w-]{1,64}\x20?(?:\(dot\)|\[dot\]|\x20dot\x20)\x20?[a-z]{2,12}",
                r"(?i)[(\[\x20]dot[)\]\x20]"),
}
KINDS = [*BASE, *GENERATORS]
PER_GROUP = 2_000
PRECISION = 0.9
#: Cut of a kind without held-out candidates: what the trees hold more likely than not, the least of all cuts.
DEFAULT_CUT = 0.5
#: Cut of a kind whose held-out candidates reach the precision at no cut.
NEVER = 2.0
TREES = 12
DEPTH = 3
#: Words before a number and forms of numbers: the evidence of weak labels, which the features of numbers leave out.
PHONE_WORDS = r"\b(?:tel|phone|call|fax|mobil|cell|contact)"
SSN_WORDS = r"\b(?:ssn|social)"
OTHER_WORDS = r"\b(?:page|version|chapter|figure|table|isbn|id|order|no)\b"
PHONE_GROUPS = r"^(?:1[\x20.-]{1,2})?\(?[2-9][0-9]{2}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}$|^0[0-9]{1,4}\)?(?:[\x20.-]{1,2}[0-9]{2,8}){1,4}$"
SSN_GROUPS = r"^(?!000|666|9)[0-9]{3}([\x20-])(?!00)[0-9]{2}\1(?!0000)[0-9]{4}$"
CONTEXT_WORDS = ["tel|phone|call|fax|mobil|contact", "card|visa|account|iban|credit|konto", "mail|ssn|social|passport|born|address",
                 "page|version|chapter|figure|table|isbn|id"]
CHUNK = 256
CONTEXT = 30


def matches(text: Column, pattern: str, needs: str) -> tuple[Column, Column]:
    """The matches, and the pieces before, between and after them; nothing where the text lacks what every match needs."""
    none = F.array().cast("array<string>")
    asked = text.rlike(needs)
    return (F.when(asked, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none),
            F.when(asked, F.split(text, pattern, -1)).otherwise(none))


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, b: a + b)


def with_spans(df: DataFrame, text: str, sources: dict[str, tuple[str, str]], keep: list[str]) -> DataFrame:
    """Kept columns and per kind ``_s_<kind>``: array of (start, end, value, before, after), in code points, end exclusive.

    A match starts after the summed lengths of all pieces and matches before it. The sums go by chunks of matches, so that a
    text of 100,000 numbers needs no quadratic time. Every step is a column that the next refers to at least twice:
    the optimizer then keeps the step and does not move it into the loops over elements.
    """
    out = df.select(*keep, *[c.alias(f"_{n}_{k}") for k, (p, needs) in sources.items() for n, c in zip("mp", matches(F.col(text), p, needs))])
    lengths = {}
    for k in sources:
        pairs = F.zip_with(F.col(f"_m_{k}"), F.slice(F.col(f"_p_{k}"), F.lit(1), F.size(f"_m_{k}")), lambda m, p: F.char_length(m) + F.char_length(p))
        lengths[f"_l_{k}"] = pairs
    out = out.withColumns(lengths)
    out = out.withColumns({f"_t_{k}": chunk_totals(F.col(f"_l_{k}")) for k in sources})
    out = out.withColumns({f"_c_{k}": totals_before(F.col(f"_t_{k}")) for k in sources})
    spans = {}
    for k in sources:
        m, p = F.col(f"_m_{k}"), F.col(f"_p_{k}")
        parts = F.arrays_zip(m.alias("m"), starts(F.col(f"_l_{k}"), F.col(f"_c_{k}")).alias("at"), F.slice(p, F.lit(1), F.size(m)).alias("p"),
                             F.slice(p, F.lit(2), F.size(m)).alias("q"))
        spans[f"_s_{k}"] = F.transform(parts, lambda z: span(z["m"], z["at"], z["p"], z["q"]))
    return out.withColumns(spans).select(*keep, *spans)


def span(match: Column, at: Column, before: Column, after: Column) -> Column:
    start = at + F.char_length(before)
    return F.struct(start.alias("start"), (start + F.char_length(match)).alias("end"), match.alias("value"),
                    F.right(before, F.lit(CONTEXT)).alias("before"), F.left(after, F.lit(1)).alias("after"))


def chunk_totals(lengths: Column) -> Column:
    chunks = F.sequence(F.lit(0), F.floor(F.size(lengths) / CHUNK).cast("int"))
    return F.transform(chunks, lambda c: total(F.slice(lengths, c * CHUNK + 1, F.lit(CHUNK))))


def totals_before(totals: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(totals) - 1), lambda c: total(F.slice(totals, F.lit(1), c)))


def starts(lengths: Column, before: Column) -> Column:
    """For each match where the piece before it starts."""
    places = F.sequence(F.lit(0), F.size(lengths) - 1)
    chunk = lambda i: F.floor(i / CHUNK).cast("int")
    each = F.transform(places, lambda i: F.get(before, chunk(i)) + total(F.slice(lengths, chunk(i) * CHUNK + 1, i - chunk(i) * CHUNK)))
    return F.when((F.size(lengths) > 0) & (F.size(before) > 0), each).otherwise(F.array().cast("array<int>"))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether 12 to 19 digits pass the Luhn sum; longer strings are not looked at digit by digit."""
    turned = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(turned, i, F.lit(1)).cast("int")
        twice = digit * 2
        return total + F.when(i % 2 == 1, digit).when(twice > 9, twice - 9).otherwise(twice)

    fits = F.char_length(digits).between(12, 19)
    return F.when(fits, F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), add) % 10 == 0).otherwise(F.lit(False))


def address_parts(value: Column) -> Column:
    """Whether all parts between dots are numbers of at most 255."""
    plain = F.transform(F.split(value, r"\."), lambda part: F.regexp_replace(part, "^0+", ""))
    return F.forall(plain, lambda part: (F.char_length(part) < 3) | (F.char_length(part) == 3) & (part <= F.lit("255")))


def valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return address_parts(value)
    if kind == "card":
        return luhn(digits_of(value))
    return F.char_length(digits_of(value)).between(9, 15)


def flag(condition: Column) -> Column:
    return condition.cast("double")


def features(kind: str, c: Column) -> Column:
    """Format and context of a candidate; nothing that its label is made of."""
    value, before, after = c["value"], c["before"], c["after"]
    size = F.char_length(value).cast("double")
    digits = F.char_length(digits_of(value)) / size
    letters = F.char_length(F.regexp_replace(value, "[^A-Za-z]", "")) / size
    near = F.lower(before)
    return F.array(
        F.lit(float(KINDS.index(kind))),
        size,
        digits,
        letters,
        F.char_length(F.regexp_replace(value, "[^A-Z]", "")) / size,
        F.size(F.array_distinct(F.split(F.left(value, F.lit(200)), ""))) / F.least(size, F.lit(200.0)),
        F.size(F.split(value, "[^0-9A-Za-z]+")).cast("double"),
        F.char_length(F.regexp_extract(value, "^[0-9]*", 0)).cast("double"),
        F.char_length(F.regexp_extract(value, "[0-9]*$", 0)).cast("double"),
        flag(value.contains(".")),
        flag(value.contains("-")),
        flag(value.contains(" ")),
        flag(value.contains("(")),
        flag(value.contains('"')),
        flag(before.rlike(r"[\w]$")),
        flag(before.rlike(r"(^|\s)$")),
        flag(before.endswith("(")) if kind == "number" else flag(before.rlike(r"[+(]$")),
        flag(after.rlike(r"^\w")),
        flag(after.rlike(r"^(\s|$)")),
        *[F.lit(0.0) if kind == "number" else flag(near.rlike(words)) for words in CONTEXT_WORDS],
    )


def weak_label(kind: str, c: Column) -> Column:
    """What checks beyond the features say of a candidate; null where they say nothing.

    An uncovered number is good where a checksum, a plus, or a phone or SSN word with a number of that form speaks for it (a card
    is what passes its Luhn sum: a card word cannot mend one that fails). A free number in groups of a phone or SSN without such a word is
    left open, since many are written so; all others are bad.
    """
    value, before = c["value"], c["before"]
    if kind == "number":
        digits, near = digits_of(value), F.lower(before)
        grouped, ssn, card_size = value.rlike(PHONE_GROUPS), value.rlike(SSN_GROUPS), F.char_length(digits).between(12, 19)
        phone = near.rlike(PHONE_WORDS) & (grouped | value.rlike("^[0-9]{7,15}$") & ~card_size)
        checked = luhn(digits) | before.endswith("+") & F.char_length(digits).between(9, 15) | whole_address(value)
        free = ~before.rlike(r"[\w]$") & ~c["after"].rlike(r"^\w")
        backed = free & (phone | near.rlike(SSN_WORDS) & ssn)
        return F.when(checked | backed, True).when(~(free & (grouped | ssn)) | near.rlike(OTHER_WORDS), False)
    if kind == "mixed":
        return before.rlike(KEYWORD) & value.rlike("[0-9]")
    if kind == "secret":
        return value.rlike("[=:].*[0-9]")
    return F.lit(True)


def whole_address(value: Column) -> Column:
    return F.when(value.rlike(r"^[0-9]+(\.[0-9]+){3}$"), address_parts(value)).otherwise(F.lit(False))


def covered(kind: str, c: Column) -> Column:
    """Whether the candidate repeats a base span: it passes the check of a base pattern and has its form."""
    if kind != "number":
        return F.lit(False)
    digits = digits_of(c["value"])
    card = luhn(digits) & c["value"].rlike(r"^[0-9](?:[\x20-]?[0-9])*+$")
    return card | c["before"].endswith("+") & F.char_length(digits).between(9, 15) | whole_address(c["value"])


def candidates(df: DataFrame, keep: list[str]) -> DataFrame:
    """Kept columns and ``_cands``: all candidates as (kind, start, end, covered, label, features)."""
    found = with_spans(df, "_text", GENERATORS, keep)
    each = [F.transform(F.col(f"_s_{kind}"), candidate_of(kind)) for kind in GENERATORS]
    return found.select(*keep, F.concat(*each).alias("_cands"))


def candidate_of(kind: str):
    def made(c: Column) -> Column:
        return F.struct(F.lit(KINDS.index(kind)).alias("kind"), c["start"].alias("start"), c["end"].alias("end"), covered(kind, c).alias("covered"),
                        weak_label(kind, c).alias("label"), features(kind, c).alias("features"))

    return made


def base_spans(kind: str) -> Column:
    """The matches of a base pattern that pass its check, as (start, kind, end)."""
    good = F.filter(F.col(f"_s_{kind}"), lambda s: valid(kind, s["value"]))
    return F.transform(good, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end")))


class Trees:
    """Boosted trees as nested tuples (feature, threshold, left, right) or leaf values, with a threshold per kind."""

    def __init__(self, trees: list, cuts: dict[int, float]):
        self.trees, self.cuts = trees, cuts

    @staticmethod
    def grown(node, weight: float):
        if node.getClass().getSimpleName() == "LeafNode":
            return weight * node.prediction()
        return (node.split().featureIndex(), node.split().threshold(), Trees.grown(node.leftChild(), weight), Trees.grown(node.rightChild(), weight))

    def margin(self, values: Column) -> Column:
        def walk(node):
            if isinstance(node, float):
                return F.lit(node)
            return F.when(F.get(values, F.lit(node[0])) <= F.lit(node[1]), walk(node[2])).otherwise(walk(node[3]))

        out = F.lit(0.0)
        for tree in self.trees:
            out = out + walk(tree)
        return out

    def probability(self, values: Column) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(self.margin(values) * -2.0))

    def selected(self, c: Column) -> Column:
        """Whether a candidate's probability reaches its kind's threshold, or ``DEFAULT_CUT`` where none of the kind was held out."""
        cut = F.lit(DEFAULT_CUT)
        for kind, value in self.cuts.items():
            cut = F.when(c["kind"] == kind, F.lit(value)).otherwise(cut)
        return self.probability(c["features"]) >= cut


def fit(texts: DataFrame, per_group: int = PER_GROUP, precision: float = PRECISION) -> Trees | None:
    """Trees and thresholds from the candidates of all texts (``_text``); none without candidates of both labels.

    Only candidates that can be added (not covered by a base span) and have a label take part. They are written once,
    and copies of a text count once. A third of the texts is held out. The trees see at
    most ``per_group`` candidates of each kind and label of the others, the cuts all that are held out.
    """
    found = candidates(texts.select("_text", F.xxhash64("_text").alias("_hash")), ["_hash"])
    found = explode_once(found, F.col("_cands"), "_n", "c", ["_hash"]).where(~F.col("c.covered") & F.col("c.label").isNotNull())
    found = found.select("_hash", "c.kind", "c.start", flag(F.col("c.label")).alias("label"), "c.features")
    found = found.withColumns({"order": F.xxhash64("_hash", "kind", "start"), "held": F.pmod("_hash", F.lit(3)) == 0})
    found = written(found.select("kind", "order", "held", "label", "features"), "candidates", compression="zstd")
    free = found.where("not held").drop("held")
    sizes = free.groupBy("kind", "label").agg(F.approx_count_distinct("order").alias("n")).collect()
    if len({r["label"] for r in sizes}) < 2:
        return None
    # twice the bound by hash first, so that no task meets more candidates of a group on a larger input
    rate = F.lit(0)
    for r in sizes:
        rate = F.when((F.col("kind") == r["kind"]) & (F.col("label") == r["label"]), 1_000_000 * 2 * per_group // r["n"] + 1).otherwise(rate)
    few = free.where(F.pmod("order", F.lit(1_000_000)) < rate).distinct()
    train = cut_lineage(top_ranked(few, ["kind", "label"], [F.col("order")], per_group).select("order", "label", array_to_vector("features").alias("vector")))
    train = train.coalesce(1).sortWithinPartitions("order").select("label", "vector")
    model = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7).fit(train)
    trees = Trees([Trees.grown(t._java_obj.rootNode(), w) for t, w in zip(model.trees, model.treeWeights)], {})
    scored = found.where("held").select("kind", "order", "label", F.floor(trees.probability(F.col("features")) * 100).alias("bin")).distinct()
    bins = scored.groupBy("kind", "bin").agg(F.count("*").alias("n"), F.sum("label").alias("good")).collect()
    trees.cuts = {**{b["kind"]: NEVER for b in bins}, **thresholds(bins, precision)}
    return trees


def thresholds(bins: list, precision: float) -> dict[int, float]:
    """Per kind the lowest bin from which on at least ``precision`` of the held-out candidates are good; at most 101 bins each."""
    cuts: dict[int, float] = {}
    for kind in {b["kind"] for b in bins}:
        n = good = 0.0
        for b in sorted((b for b in bins if b["kind"] == kind), key=lambda b: -b["bin"]):
            n, good = n + b["n"], good + b["good"]
            if good >= precision * n:
                cuts[kind] = max(0.5, b["bin"] / 100)
    return cuts


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1), s["start"], s["end"])), ",")


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of every row."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), whole_text(text).alias("_text"))
    trees = fit(rows.select("_text"), **options)
    needs = {"email": "@", "ip": "[0-9]", "card": "[0-9]", "phone": r"\+[0-9]"}
    found = with_spans(rows, "_text", {k: (p, needs[k]) for k, p in BASE.items()}, ["doc_id", "_text"])
    kept = {f"_b_{k}": base_spans(k) for k in BASE}
    out = found.select("doc_id", "_text", *[c.alias(n) for n, c in kept.items()])
    counts = {f"n_{k}": F.size(f"_b_{k}").cast("long") for k in BASE}
    out = out.select("doc_id", "_text", *[c.alias(n) for n, c in counts.items()], F.array_sort(F.concat(*[f"_b_{k}" for k in BASE])).alias("_base"))
    if trees is None:
        out = out.withColumn("_added", F.array().cast("array<struct<start: int, kind: int, end: int>>"))
    else:
        out = candidates(out, [*[c for c in out.columns if c != "_text"]])
        chosen = F.filter(F.col("_cands"), lambda c: ~c["covered"] & trees.selected(c))
        out = out.withColumn("_added", F.transform(chosen, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"))))
    return out.select("doc_id", *counts, F.sha2(joined(F.col("_base")).cast("binary"), 256).alias("base_sha256"),
                      joined(F.array_sort(F.concat("_base", "_added"))).alias("spans"), F.size("_added").cast("long").alias("n_added"))


def redacted(spans: DataFrame, docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Documents joined with their spans as an array of (kind, start, end)."""
    parsed = F.transform(F.filter(F.split("spans", ","), lambda s: s != ""), lambda s: F.struct(
        F.split_part(s, F.lit(":"), F.lit(1)).alias("kind"), F.split_part(s, F.lit(":"), F.lit(2)).cast("int").alias("start"),
        F.split_part(s, F.lit(":"), F.lit(3)).cast("int").alias("end")))
    return docs.join(spans.select(F.col("doc_id").alias(doc_id), parsed.alias("pii")), doc_id, "left")
