"""Personal data by weak supervision, in DataFrame functions alone.

Candidate spans come from strict patterns (the base kinds) and from looser ones.
Labelers vote on every candidate: its pattern's own rules, gazetteers of
prefixes and domains, cue words before it, and the characters around it.
Expectation-maximisation over the counts of vote patterns estimates how reliable
each labeler is and how likely each pattern is personal data; a logistic span
classifier is trained on those probabilities and decides on the looser
candidates. Valid base spans always stay. Only counts of vote patterns reach
the driver, at most 8 x 3^4 x 2 of them.

Positions count code points. The patterns contain no unbounded group that Java
would match recursively and no start that rescans a run; positions, overlaps and
masked texts are built from running sums and maxima in blocks of BLOCK hits, and
contexts from the text between hits, so a text's work grows with its length and
its hits, not with their product.

Defined results: a null or empty text has no spans; of a looser candidate that
overlaps a base span only the base span stays; repeated rows are scanned alike;
an empty table trains nothing and gives an empty result; other columns are kept
by ``mask`` and ignored by ``find``.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.plans.scratch import materialize

# The kinds in the order in which spans of one start are listed, and their patterns.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
LOOSE = {
    "key": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![0-9A-Za-z])",
    "secret": r"(?<![A-Za-z0-9])(?i:password|passwd|pwd|token|secret|api_key) ?[=:] ?(?:\"[^\"\s]{6,}+\"|[^\s\"]{6,}+)",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "local": r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9-])",
}
#: What a text must hold before a pattern is tried on it.
_HINT = {
    "email": ("contains", "@"),
    "ip": ("rlike", r"[0-9]\.[0-9]+\.[0-9]"),
    "card": ("rlike", r"[0-9](?:[ -]?[0-9]){11}"),
    "phone": ("contains", "+"),
    "key": ("contains", "AKIA"),
    "secret": ("rlike", r"(?i:password|passwd|pwd|token|secret|api_key) ?[=:]"),
    "ssn": ("rlike", r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
    "local": ("rlike", r"[0-9]{3}[-. )]{1,2}[0-9]{3}[-. ][0-9]{4}"),
}
KINDS = [*BASE, *LOOSE]
MASKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "key": "[KEY]", "secret": "[SECRET]", "ssn": "[SSN]", "local": "[PHONE]"}
# Gazetteers and cue words.
_DOMAINS = "com net org edu gov info io de fr es uk it nl eu".split()
_CUES = {
    "email": "mail contact write reply an para por",
    "ip": "ip host server address from addr client",
    "card": "card visa credit payment carte karte tarjeta",
    "phone": "call tel phone mobile fax ruf appel llame",
    "key": "key access aws secret",
    "secret": "login user auth config",
    "ssn": "ssn social security",
    "local": "call tel phone mobile fax",
}
_AGAINST = "version isbn issn serial invoice order item page figure table section chapter no nr id"
CONTEXT = 32
#: Hits in a block of a running sum, and code points in a block of a text that is masked.
BLOCK, TEXT_BLOCK = 256, 4096


def _empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(values: Column, op, zero: int) -> Column:
    """For every element of an array of ints, ``op`` (associative) over all elements before it; in blocks, as an array grows by copying."""

    def plain(xs: Column) -> Column:
        start = F.struct(F.lit(zero).alias("at"), _empty("int").alias("out"))
        return F.aggregate(xs, start, lambda a, x: F.struct(op(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))

    def joined(xs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int")), lambda k: plain(F.slice(xs, k * BLOCK + 1, F.lit(BLOCK))))
        return _let(blocks, lambda bs: F.flatten(F.zip_with(bs, plain(F.transform(bs, lambda b: b["at"]))["out"], lambda b, before: F.transform(b["out"], lambda x: op(before, x)))))

    return _let(values, lambda xs: F.when(F.size(xs) > BLOCK, joined(xs)).otherwise(plain(xs)["out"]))


def _located(text: Column, kind: str) -> Column:
    """Leftmost matches of the kind's pattern as an array of (start, rank, end, kind, value, before, after), with the text just before and after as far as the neighbouring matches.

    The parts between matches and the matches themselves alternate, so their lengths add up to the positions.
    """
    pattern = (BASE | LOOSE)[kind]

    def spans(x: Column) -> Column:
        hits, gaps = x["hits"], x["gaps"]
        steps = F.zip_with(gaps, hits, lambda gap, hit: F.char_length(gap) + F.coalesce(F.char_length(hit), F.lit(0)))

        def placed(at: Column) -> Column:
            # The part after the last match has a place, but no match.
            own = F.zip_with(F.zip_with(hits, gaps, lambda v, gap: F.struct(v.alias("value"), gap.alias("gap"))), at, lambda v, s: F.struct(v["value"].alias("value"), v["gap"].alias("gap"), s.alias("at")))
            next_gap = F.slice(gaps, F.lit(2), F.size(gaps))
            full = F.zip_with(own, next_gap, lambda v, after: F.struct(v.alias("v"), F.substring(after, 1, 1).alias("after")))
            start = lambda y: y["v"]["at"] + F.char_length(y["v"]["gap"])
            return F.transform(
                F.filter(full, lambda y: y["v"]["value"].isNotNull()),
                lambda y: F.struct(start(y).alias("start"), F.lit(KINDS.index(kind)).alias("rank"), (start(y) + F.char_length(y["v"]["value"])).alias("end"), F.lit(kind).alias("kind"), y["v"]["value"].alias("value"), F.right(y["v"]["gap"], F.lit(CONTEXT)).alias("before"), F.coalesce(y["after"], F.lit("")).alias("after")),
            )

        return _let(_running(steps, lambda a, b: a + b, 0), placed)

    how, what = _HINT[kind]
    hint = F.contains(text, F.lit(what)) if how == "contains" else text.rlike(what)
    found = _let(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("gaps")), spans)
    return F.when(hint, found).otherwise(_empty("struct<start:int,rank:int,end:int,kind:string,value:string,before:string,after:string>"))


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.char_length(digits)
    if kind == "ip":
        parts = F.split(value, r"\.", -1)
        return F.forall(parts, lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])$"))
    if kind == "card":
        return n.between(12, 19) & F.coalesce(F.call_function("luhn_check", digits), F.lit(False))
    if kind == "phone":
        return n.between(9, 15)
    if kind == "ssn":
        return ~value.rlike("^(?:000|666|9)|-00-|-0000$")
    if kind == "local":
        return ~value.rlike(r"^\(?[01]")
    if kind == "secret":
        return value.rlike("[0-9]")
    return F.lit(True)


def _any_word(words: str) -> str:
    return "(?i)(?<![a-z])(?:" + "|".join(words.split()) + ")(?![a-z])"


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _voted(spans: Column, kind: str) -> Column:
    """Spans with validity and the votes of the regex, gazetteer, context and boundary labelers, and whether they are long."""

    def judge(x: Column) -> Column:
        value, valid = x["value"], _valid(kind, x["value"])
        before, after = x["before"], x["after"]
        if kind == "email":
            tail = F.lower(F.element_at(F.split(value, r"\.", -1), -1))
            known = _vote(tail.isin(_DOMAINS), tail.rlike("[0-9]"))
        elif kind == "ip":
            known = _vote(~value.rlike(r"^(?:0|10|127|255)\.|^192\.168\."), value.rlike(r"^0|^255\."))
        elif kind in ("card", "phone", "local"):
            known = _vote(value.rlike(r"^(?:4|5[1-5]|3[47]|6|\+(?:1|3[0-9]|4[0-9]|52|54|57)|\(?[2-9])"), value.rlike(r"^0"))
        elif kind == "secret":
            known = _vote(value.rlike("[0-9a-f]{8}|[A-Za-z][0-9]|[0-9][A-Za-z]"), value.rlike("(?i)example|changeme|none|null"))
        else:
            known = _vote(F.lit(kind == "key"), F.lit(False))
        return F.struct(
            *(x[c].alias(c) for c in ("start", "rank", "end", "kind")),
            F.lit(kind in BASE).alias("base"),
            valid.alias("valid"),
            _vote(valid, ~valid).alias("v0"),
            known.alias("v1"),
            _vote(before.rlike(_any_word(_CUES[kind])), before.rlike(_any_word(_AGAINST))).alias("v2"),
            _vote(~before.rlike(r"[\p{L}\p{N}]$") & ~after.rlike(r"^[\p{L}\p{N}]"), before.rlike(r"[\p{L}\p{N}]$") & after.rlike(r"^[\p{L}\p{N}]")).alias("v3"),
            (F.char_length(value) > 16).cast("int").alias("long"),
        )

    return F.when(F.size(spans) > 0, F.transform(spans, judge)).otherwise(_empty("struct<start:int,rank:int,end:int,kind:string,base:boolean,valid:boolean,v0:int,v1:int,v2:int,v3:int,long:int>"))


def candidates(text: Column) -> Column:
    """Every candidate span of a text with its votes."""
    return F.concat(*(_voted(_located(text, kind), kind) for kind in KINDS))


_FAR = (1 << 31) - 1
VOTES = ("v0", "v1", "v2", "v3")


def estimate(patterns: list[tuple], rounds: int = 50) -> tuple[list[float], list[dict]]:
    """EM over (kind, v0..v3, long, n): each pattern's probability and each labeler's table of vote probabilities by class."""
    prior, tables = 0.5, [{c: {v: (0.6 if v == c else 0.1 if v == -c else 0.3) for v in (-1, 0, 1)} for c in (1, -1)} for _ in VOTES]
    share: list[float] = []
    for _ in range(rounds):
        share = []
        for row in patterns:
            like = {c: (prior if c == 1 else 1 - prior) * math.prod(t[c][v] for t, v in zip(tables, row[1:5], strict=True)) for c in (1, -1)}
            share.append(like[1] / (like[1] + like[-1]))
        total = sum(row[6] for row in patterns)
        prior = (1 + sum(s * row[6] for s, row in zip(share, patterns, strict=True))) / (2 + total)
        for k, table in enumerate(tables):
            for c in (1, -1):
                mass = {v: 0.1 for v in (-1, 0, 1)}
                for s, row in zip(share, patterns, strict=True):
                    mass[row[1 + k]] += row[6] * (s if c == 1 else 1 - s)
                table[c] = {v: m / sum(mass.values()) for v, m in mass.items()}
    return share, tables


def _features(row: tuple) -> list[float]:
    return [1.0, *map(float, row[1:5]), float(row[5]), *(float(row[0] == k) for k in KINDS)]


def train(patterns: list[tuple], share: list[float], rounds: int = 300, rate: float = 0.5, decay: float = 1e-3) -> list[float]:
    """Weights of a logistic classifier fitted to the estimated probabilities, each pattern weighted by its count."""
    weights = [0.0] * (6 + len(KINDS))
    rows = [(_features(p), s, p[6]) for p, s in zip(patterns, share, strict=True)]
    total = sum(n for *_, n in rows) or 1
    for _ in range(rounds):
        slope = [decay * w for w in weights]
        for x, s, n in rows:
            z = sum(a * b for a, b in zip(weights, x, strict=True))
            off = (1 / (1 + math.exp(-z)) - s) * n / total
            for i, v in enumerate(x):
                slope[i] += off * v
        weights = [w - rate * g for w, g in zip(weights, slope, strict=True)]
    return weights


class SpanModel:
    """The trained classifier as column expressions."""

    def __init__(self, weights: list[float], reliabilities: list[dict]):
        self.weights, self.reliabilities = weights, reliabilities

    def keeps(self, x: Column) -> Column:
        kind_weights = self.weights[6:]
        by_kind = reduce(lambda c, k: c.when(x["kind"] == k, kind_weights[KINDS.index(k)]), KINDS, F.when(F.lit(False), F.lit(0.0)))
        z = F.lit(self.weights[0]) + self.weights[5] * x["long"] + by_kind
        for k, v in enumerate(VOTES):
            z = z + self.weights[1 + k] * x[v]
        return z >= 0

    def spans(self, found: Column) -> Column:
        """Of candidates: valid base spans, and what the classifier keeps of the looser ones that overlap none of them; in order."""
        chosen = F.array_sort(F.filter(found, lambda x: (x["base"] & x["valid"]) | (~x["base"] & self.keeps(x))))

        def apart(xs: Column) -> Column:
            # In order of start: the furthest end of the base spans before, and the start of the next one.
            ends = _running(F.transform(xs, lambda x: F.when(x["base"], x["end"]).otherwise(0)), F.greatest, 0)
            starts = F.reverse(_running(F.reverse(F.transform(xs, lambda x: F.when(x["base"], x["start"]).otherwise(_FAR))), F.least, _FAR))
            sided = F.zip_with(xs, F.zip_with(ends, starts, lambda e, s: F.struct(e.alias("e"), s.alias("s"))), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
            return F.transform(F.filter(sided, lambda z: z["x"]["base"] | ((z["y"]["e"] <= z["x"]["start"]) & (z["y"]["s"] >= z["x"]["end"]))), lambda z: z["x"])

        return F.when(F.size(found) > 0, _let(chosen, apart)).otherwise(found)


def fit(found: DataFrame) -> SpanModel:
    """Estimate and train on stored candidates (a column named spans)."""
    rows = found.select(F.explode("spans").alias("x")).groupBy(*(F.col(f"x.{c}").alias(c) for c in ("kind", *VOTES, "long"))).count()
    patterns = sorted(tuple(r) for r in rows.collect())
    share, tables = estimate(patterns)
    return SpanModel(train(patterns, share), tables)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and candidate spans of every document, stored in the shared folder."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), candidates(text).alias("spans")), "pii")


def find(docs: DataFrame) -> DataFrame:
    """doc_id and its spans (start, rank, end, kind, base, ...) in order of start and kind."""
    found = scan(docs)
    return found.select("doc_id", fit(found).spans(F.col("spans")).alias("spans"))


def mask(docs: DataFrame) -> DataFrame:
    """The documents with every span of their texts replaced by its kind's mark; other columns stay.

    Texts are scanned once: rows and candidates are stored together, and masked from there.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = F.struct(*(F.col(c) for c in docs.columns)).alias("_row")
    stored = materialize(docs.select(row, candidates(text).alias("spans")), "pii-rows")
    spans = fit(stored).spans(F.col("spans"))
    marks = F.create_map(*(F.lit(v) for pair in MASKS.items() for v in pair))
    whole = F.col("_row.text").cast("string")

    def masked(x: Column) -> Column:
        def part(start: Column, size: Column) -> Column:
            """A part of the text, from the blocks it lies in."""
            first, last = F.floor(start / TEXT_BLOCK).cast("int"), F.floor((start + size - 1) / TEXT_BLOCK).cast("int")
            return F.when(size > 0, F.substring(F.array_join(F.slice(x["blocks"], first + 1, last - first + 1), ""), start % TEXT_BLOCK + 1, size)).otherwise("")

        # A span that begins inside those before it has no mark of its own.
        pieces = F.zip_with(x["spans"], x["ends"], lambda s, end: F.when(s["start"] >= end, F.concat(part(end, s["start"] - end), marks[s["kind"]])).otherwise(""))
        return F.concat(F.array_join(pieces, ""), part(F.array_max(F.transform(x["spans"], lambda s: s["end"])), F.char_length(whole) - F.array_max(F.transform(x["spans"], lambda s: s["end"]))))

    blocks = F.regexp_extract_all(whole, F.lit(f"(?s).{{1,{TEXT_BLOCK}}}"), F.lit(0))
    ends = _running(F.transform("_spans", lambda s: s["end"]), F.greatest, 0)
    changed = stored.select("_row", spans.alias("_spans"))
    new = F.when(F.size("_spans") > 0, _let(F.struct(F.col("_spans").alias("spans"), ends.alias("ends"), blocks.alias("blocks")), masked)).otherwise(whole)
    return changed.select(*(new.alias("text") if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns))


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns from ``find``."""

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in BASE]
    return found.select("doc_id", *counts, F.sha2(listed(F.filter("spans", lambda x: x["base"])), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
