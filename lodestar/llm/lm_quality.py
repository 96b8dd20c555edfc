"""Quality by the perplexity of an interpolated modified Kneser-Ney character model.

The model's 4-grams are of Unicode characters of any script as they stand (only
digits are read as one digit and capitals as one capital), without a bound on their
number, so the model grows with the texts it is trained on. Counts of all trusted texts are
summed in shards by n-gram; joins of the sharded counts with their contexts and with
the probabilities of the next lower order give the probability of every n-gram that
was seen, and a back-off weight of every context. Scoring is a join with these
tables: a task sums what the most frequent n-grams cost (a table of HEAD entries,
a fixed bound, that is broadcast and saves rows only) and leaves every other n-gram
of a document, once with its count, to the join; the different n-grams among these
are looked up in all orders, and a document's costs are summed. A document is
rejected if its mean log perplexity lies outside its language's interval, which
quantiles of held-out trusted documents give on either side: junk is too surprising,
mere repetition too little.

Defined results: a null or empty text has no perplexity and is rejected; a null
or unknown language is judged by the interval of all trusted documents; texts
are scored whole; characters that no trusted text has are one unknown symbol, and
character 0, which stands before a text, is read as U+FFFD inside one; costs are
summed as integers, so results do not depend on an order; repeated rows are scored
alike; without trusted documents nothing is rejected but empty texts; other columns
are kept or ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.plans.scratch import free_shuffles, materialize, release

ORDER = 4
#: The n-grams of the broadcast table, the slots it has, and the parts of a nat in which costs are counted.
HEAD, SLOTS, UNIT = 1 << 18, 1 << 20, 1 << 20
#: Held-out share of trusted documents, which sets thresholds only: one in so many.
HELD_OUT = 5
#: The quantiles of a language, and how far beyond them (as a share of their distance to the median) its interval reaches for one held-out document; it falls with the root of their number, as a quantile's error does.
LOW, HIGH, SLACK = 0.02, 0.98, 2.0
#: Half-widening of the interval for a text of one character; it falls with the root of the length, as a mean's error does.
SPREAD = 1.5
#: n-grams that a task looks at together.
PORTION = 1_000_000

# The dense table over 64 symbols (``train``): the same weights by arrays. No query uses it; tests hold it, and so ``_weights``, against the textbook.
BITS = 6
SIZE = 1 << BITS
#: n-grams counted together by a training task.
BUFFER = 4_000_000
# The symbols of the dense table; each string is one symbol, each letter of the long ones a symbol of its own.
_LETTERS = "abcdefghijklmnopqrstuvwxyzäöüßéèêëçàâîïôùûñáíóú"
_CLASSES = [" \t", "\n\r", "0123456789", ".", ",", "!?", ";:", "'’\"«»“”", "-–—", "()[]{}<>", "#$%&*+=@/\\^_|~§"]


#: Code points that have a symbol of their own or a class; all beyond are one symbol.
_POINTS = 0x30000


def _symbols() -> np.ndarray:
    """The symbol of each code point below _POINTS; at the end that of all others. 0 stands before a text.

    A letter that is not listed, of any script, shares the symbol of one that is, by a
    hash, so that words of other scripts are sequences of symbols too. Capital letters
    are one symbol: where they stand tells prose from shouting.
    """
    table = np.full(_POINTS + 1, 63, np.uint32)
    listed = {c: k + 1 for k, c in enumerate(_LETTERS)}
    for c in range(_POINTS):
        char = chr(c)
        if char.isupper():
            table[c] = 62
        elif char.isalpha():
            table[c] = listed.get(char) or 1 + (c * 2654435761 >> 12) % len(_LETTERS)
        elif char.isdigit():
            table[c] = len(_LETTERS) + 3
        elif char.isspace():
            table[c] = len(_LETTERS) + 1
    for k, chars in enumerate(_CLASSES):
        for c in chars:
            table[ord(c)] = len(_LETTERS) + 1 + k
    return table


SYMBOLS = _symbols()


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the 4-gram that ends at each character, for all texts in a row, and the texts' lengths."""
    pad = np.zeros(ORDER - 1, np.uint32)
    parts, lengths = [], np.array([len(t) for t in texts], np.int64)
    for t in texts:
        parts += [pad, SYMBOLS[np.minimum(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4"), _POINTS)]]
    s = np.concatenate([*parts, pad])
    codes = s.copy()
    for k in range(1, ORDER):
        codes[k:] |= s[:-k] << np.uint32(BITS * k)
    inside = np.ones(len(s), bool)
    ends = np.cumsum(lengths + ORDER - 1)
    for k in range(ORDER - 1):
        inside[np.concatenate([[0], ends]) + k] = False
    return codes[inside] & np.uint32((1 << BITS * ORDER) - 1), lengths


def count_ngrams(texts: DataFrame) -> DataFrame:
    """(code, n) of the 4-grams of a one-column table of texts, summed in shards by code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            codes, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64)), pa.array(n.astype(np.int64))], ["code", "n"])

        for batch in batches:
            codes, _ = ngrams([t for t in batch.column(0).to_pylist() if t])
            held.append(codes)
            size += len(codes)
            if size >= BUFFER:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    return texts.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _weights(counts: DataFrame, context: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """For one order: (code, alpha) of the seen n-grams and (context, gamma), by modified Kneser-Ney discounts."""
    context = F.shiftright("code", BITS) if context is None else context
    of = counts.agg(*(F.coalesce(F.sum(F.when(F.col("n") == k, 1)), F.lit(0)).alias(f"n{k}") for k in (1, 2, 3, 4))).first()
    n1, n2, n3, n4 = (max(1, v) for v in of)
    y = n1 / (n1 + 2 * n2)
    d = [min(max(k - (k + 1) * y * b / a, 0.05), k - 0.05) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    cut = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
    grams = counts.select("code", context.alias("context"), "n", cut.alias("cut"))
    totals = grams.groupBy("context").agg(F.sum("n").alias("total"), F.sum("cut").alias("mass"))
    alpha = grams.join(totals, "context").select("code", ((F.col("n") - F.col("cut")) / F.col("total")).alias("alpha"))
    return alpha, totals.select("context", (F.col("mass") / F.col("total")).alias("gamma"))


def train(texts: DataFrame) -> np.ndarray:
    """The log probability of every 4-gram code, as float16, from all texts."""
    counts = {ORDER: materialize(count_ngrams(texts), "ngrams")}
    for k in range(ORDER - 1, 0, -1):
        # Of lower orders only the number of distinct symbols before counts.
        lower = F.col("code").bitwiseAND(F.lit((1 << BITS * k) - 1))
        counts[k] = counts[k + 1].groupBy(lower.alias("code")).agg(F.count(F.lit(1)).alias("n"))
    prob = np.full(1, 1.0 / SIZE, np.float32)
    for k in range(1, ORDER + 1):
        # At most 2^24 and 2^18 rows, whatever the corpus.
        alpha, gamma = (x.toArrow() for x in _weights(counts[k]))
        back = np.ones(1 << BITS * (k - 1), np.float32)
        back[gamma["context"].to_numpy()] = gamma["gamma"].to_numpy()
        lower = prob.reshape(-1, SIZE) if k > 1 else prob.reshape(1, 1)
        # The context without its first symbol is its place modulo the rows of the lower table.
        prob = np.empty((len(back), SIZE), np.float32)
        for start in range(0, len(back), len(lower)):
            prob[start : start + len(lower)] = back[start : start + len(lower), None] * lower
        prob = prob.ravel()
        prob[alpha["code"].to_numpy()] += alpha["alpha"].to_numpy().astype(np.float32)
        del alpha, gamma
    pa.default_memory_pool().release_unused()
    return np.log(np.maximum(prob, 1e-7), out=prob).astype(np.float16)


def _folded() -> np.ndarray:
    """The character that each code point is read as: itself, but digits are one character, and so are capitals: where they stand tells prose from shouting."""
    table = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        char = chr(c)
        if char.isupper():
            table[c] = ord("A")
        elif char.isdecimal():
            table[c] = ord("0")
    return table


FOLDED = _folded()


def portions(texts: list[str | None], of: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All n-grams of the texts, about so many at a time: rows of ORDER code points, one ending at each character, and the texts' places."""
    held, places, size = [], [], 0

    def windows() -> tuple[np.ndarray, np.ndarray]:
        points = FOLDED[np.frombuffer("".join(held).encode("utf-32-le", "surrogatepass"), "<u4")]
        lengths = np.array([len(p) for p in held], np.int64)
        inside = np.ones(len(points), bool)
        for k in range(ORDER - 1):
            inside[np.cumsum(lengths) - lengths + k] = False
        grams = np.lib.stride_tricks.sliding_window_view(points, ORDER)[inside[ORDER - 1 :]]
        return grams, np.repeat(np.array(places, np.int64), lengths - ORDER + 1)

    for i, text in enumerate(texts):
        # A piece of a long text begins with the characters before it.
        whole = "\0" * (ORDER - 1) + (text or "").replace("\0", "\ufffd")
        for start in range(0, len(whole) - ORDER + 1, of):
            held.append(whole[start : start + of + ORDER - 1])
            places.append(i)
            size += len(held[-1])
            if size >= of:
                yield windows()
                held, places, size = [], [], 0
    if held:
        yield windows()


def hashed(grams: np.ndarray) -> np.ndarray:
    """64 bits of each row of code points."""
    out = np.zeros(len(grams), np.uint64)
    for k in range(ORDER):
        out = (out ^ grams[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out * np.uint64(0xBF58476D1CE4E5B9)


def strings(grams: np.ndarray) -> pa.Array:
    """Rows of code points as strings."""
    return pa.array(np.ascontiguousarray(grams, "<u4").view(f"<U{ORDER}").ravel().tolist(), pa.string())


def count_grams(texts: DataFrame) -> DataFrame:
    """(code, n) of the strings of ORDER characters of a one-column table of texts, summed in shards by string."""
    together = PORTION

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for grams, _ in portions(batch.column(0).to_pylist(), together):
                _, first, n = np.unique(hashed(grams), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([strings(grams[first]), pa.array(n.astype(np.int64))], ["code", "n"])

    return texts.mapInArrow(run, "code string, n long").groupBy("code").agg(F.sum("n").alias("n"))


class KneserNey:
    """The model of a one-column table of texts: for each order the probabilities of the n-grams seen and the back-off weights of their contexts, in shards."""

    def __init__(self, texts: DataFrame):
        counts = {ORDER: materialize(count_grams(texts), "grams")}
        free_shuffles(texts.sparkSession)
        for k in range(ORDER - 1, 0, -1):
            # Of lower orders only the number of distinct characters before counts.
            lower = counts[k + 1].groupBy(F.substring("code", 2, k).alias("code")).agg(F.count(F.lit(1)).alias("n"))
            counts[k] = materialize(lower, "grams")
        self.prob, self.back = {}, {}
        for k in range(1, ORDER + 1):
            alpha, gamma = _weights(counts[k], F.substring("code", 1, k - 1))
            self.back[k] = materialize(gamma, "grams-back")
            if k == 1:
                # Unseen characters are one more symbol.
                weight = self.back[1].first()
                self.unseen = (weight["gamma"] if weight else 1.0) / (counts[1].count() + 1)
                self.prob[1] = materialize(alpha.select("code", (F.col("alpha") + F.lit(self.unseen)).alias("p")), "grams-prob")
                continue
            own = alpha.withColumns({"context": F.substring("code", 1, k - 1), "lower": F.substring("code", 2, k - 1)})
            below = self.prob[k - 1].select(F.col("code").alias("lower"), F.col("p").alias("q"))
            both = own.join(self.back[k], "context").join(below, "lower")
            self.prob[k] = materialize(both.select("code", (F.col("alpha") + F.col("gamma") * F.col("q")).alias("p")), "grams-prob")
        # At most HEAD rows, whatever the corpus.
        often = counts[ORDER].orderBy(F.desc("n"), "code").limit(HEAD)
        head = often.join(self.prob[ORDER], "code").select("n", "code", _cost("p")).orderBy(F.desc("n"), "code").toArrow()
        self.table = slots(head["code"].to_pylist(), head["cost"].to_numpy())
        release(*counts.values())

    def probabilities(self, grams: DataFrame, k: int = ORDER) -> DataFrame:
        """(code, p) of distinct strings (code) of k characters, seen or not."""
        if k == 0:
            return grams.select("code", F.lit(self.unseen).alias("p"))
        # Of each order the different strings are looked up, so no key is hot.
        named = grams.select("code", F.substring("code", 1, k - 1).alias("context"), F.substring("code", 2, k - 1).alias("lower"))
        own = named.join(self.prob[k].withColumnRenamed("p", "seen"), "code", "left")
        if k == 1:
            return own.select("code", F.coalesce("seen", F.lit(self.unseen)).alias("p"))
        below = self.probabilities(named.select(F.col("lower").alias("code")).distinct(), k - 1).select(F.col("code").alias("lower"), F.col("p").alias("q"))
        both = own.join(self.back[k], "context", "left").join(below, "lower")
        return both.select("code", F.coalesce("seen", F.coalesce("gamma", F.lit(1.0)) * F.col("q")).alias("p"))

    def scores(self, docs: DataFrame) -> DataFrame:
        """doc_id, text_hash, lang, surprise (the mean negative log probability of a text's characters; null for an empty one) and length of every row."""
        spark = docs.sparkSession
        shared, together = spark.sparkContext.broadcast(self.table.tobytes()), PORTION

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = np.frombuffer(shared.value, _SLOT)
            names, kinds = ["rid", "doc_id", "text_hash", "lang", "known", "length", "code", "n"], [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            for batch in batches:
                texts = batch.column(3).to_pylist()
                cost, lost = np.zeros(len(texts), np.int64), []
                for grams, at in portions(texts, together):
                    places, codes, n = known_cost(table, grams, at, cost)
                    lost.append(pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(places)), *(pa.nulls(len(n), t) for t in kinds[1:6]), strings(codes), pa.array(n)], names))
                lengths = pa.array([len(t or "") for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], batch.column(4), pa.array(cost), lengths, pa.nulls(len(texts), pa.string()), pa.nulls(len(texts), pa.int64())], names)
                yield from lost

        rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
        # A row for each text, and one for each of its n-grams that the table lacks.
        done = materialize(rows.mapInArrow(run, "rid long, doc_id long, text_hash long, lang string, known long, length long, code string, n long"), "surprise-known")
        rest = done.where("code is not null").select("rid", "code", "n")
        costs = materialize(self.probabilities(rest.select("code").distinct()).select("code", _cost("p")), "grams-cost")
        free_shuffles(spark)
        # Shuffled at every size, as the different n-grams grow with the corpus.
        added = materialize(rest.join(costs.hint("merge"), "code").groupBy("rid").agg(F.sum(F.col("n") * F.col("cost")).alias("added")), "surprise-added")
        free_shuffles(spark)
        total = (F.col("known") + F.coalesce("added", F.lit(0))) / F.lit(float(UNIT))
        out = done.where("code is null").join(added.hint("merge"), "rid", "left").select("doc_id", "text_hash", "lang", F.when(F.col("length") > 0, total / F.col("length")).alias("surprise"), "length")
        out = materialize(out, "surprise")
        release(done, costs, added)
        free_shuffles(spark)
        shared.destroy()
        return out


def _cost(p: str) -> Column:
    """The negative log of a probability, in UNITs of a nat."""
    return F.round(-F.log(p) * F.lit(float(UNIT))).cast("long").alias("cost")


_SLOT = np.dtype([("code", "<u8"), ("cost", "<i4")])


def _slots(codes: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two places at which a code may stand."""
    return (codes % np.uint64(len(table))).astype(np.int64), (codes >> np.uint64(40)).astype(np.int64) % len(table)


def slots(codes: list[str], costs: np.ndarray) -> np.ndarray:
    """A table of the codes (in descending order of their frequency) and their costs. One that finds both its places taken is left out."""
    table = np.zeros(SLOTS, _SLOT)
    points = np.frombuffer("".join(codes).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, ORDER)
    hashes, left = hashed(points), np.arange(len(points))
    for at in _slots(hashes, table):
        left = left[table["code"][at[left]] == 0][::-1]
        # Of several at a place the last assignment, the most frequent one, stays.
        table["code"][at[left]], table["cost"][at[left]] = hashes[left], costs[left]
        left = left[table["code"][at[left]] != hashes[left]][::-1]
    return table


def known_cost(table: np.ndarray, grams: np.ndarray, of: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Add to ``cost``, by a text's place (of), what the table has; return the n-grams that it lacks: the text's place, the n-gram and its count there."""
    codes = hashed(grams)
    first, second = _slots(codes, table)
    own = np.where(table["code"][first] == codes, table["cost"][first], -1).astype(np.int64)
    miss = np.flatnonzero(own < 0)
    again = second[miss]
    own[miss] = np.where(table["code"][again] == codes[miss], table["cost"][again], -1)
    miss = np.flatnonzero(own < 0)
    own[miss] = 0
    starts = np.flatnonzero(np.diff(of, prepend=-1))
    cost[of[starts]] += np.add.reduceat(own, starts)
    order = miss[np.lexsort((codes[miss], of[miss]))]
    new = np.ones(len(order), bool)
    new[1:] = (codes[order[1:]] != codes[order[:-1]]) | (of[order[1:]] != of[order[:-1]])
    starts = np.flatnonzero(new)
    return of[order[starts]], grams[order[starts]], np.diff(np.append(starts, len(order))).astype(np.int64)


def _held_out(of: str = "doc_id"):
    return F.pmod(F.xxhash64(of, F.lit(11)), F.lit(HELD_OUT)) == 0


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct()


def thresholds(scores: DataFrame, trusted: DataFrame) -> DataFrame:
    """(lang, low, high) by quantiles of held-out trusted documents' scores; lang null is for all of them."""
    held = scores.where(_held_out()).where("surprise is not null").join(trusted, "doc_id", "left_semi")
    marks = F.percentile_approx("surprise", [LOW, 0.5, HIGH], 10_000)
    slack = F.lit(SLACK) / F.sqrt(F.greatest(F.count(F.lit(1)), F.lit(1)))
    own = held.where("lang is not null").groupBy("lang").agg(marks.alias("q"), slack.alias("slack"))
    every = held.groupBy().agg(marks.alias("q"), slack.alias("slack")).where("q is not null").select(F.lit(None).cast("string").alias("lang"), "q", "slack")
    q = own.unionByName(every)
    return q.select("lang", (F.col("q")[0] - F.col("slack") * (F.col("q")[1] - F.col("q")[0])).alias("low"), (F.col("q")[2] + F.col("slack") * (F.col("q")[2] - F.col("q")[1])).alias("high"))


class QualityModel:
    """The trained model and the thresholds; ``filter`` takes any documents."""

    def __init__(self, docs: DataFrame, labels: DataFrame):
        trusted = trusted_ids(labels)
        # Shuffled at every size: the labels grow with the corpus, so a plan that broadcasts them is not the one that will run.
        texts = docs.where(~_held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(trusted.hint("merge"), "doc_id", "left_semi").select("text")
        self.model, self.docs = KneserNey(texts), docs
        self.scores = self.model.scores(docs)
        self.limits = materialize(thresholds(self.scores, trusted), "quantiles")

    def decide(self, scored: DataFrame) -> DataFrame:
        """Add perplexity and keep by the language's interval, else by that of all languages."""
        own = self.limits.where("lang is not null").select(F.col("lang").alias("_lang"), F.col("low").alias("_low"), F.col("high").alias("_high"))
        every = self.limits.where("lang is null").first()
        low, high = (every["low"], every["high"]) if every else (float("-inf"), float("inf"))
        joined = scored.join(own, scored["lang"] == own["_lang"], "left")
        wider = F.lit(SPREAD) / F.sqrt(F.greatest("length", F.lit(1)))
        inside = F.col("surprise").between(F.coalesce("_low", F.lit(low)) - wider, F.coalesce("_high", F.lit(high)) + wider)
        return joined.withColumn("keep", F.coalesce(inside, F.lit(False))).drop("_lang", "_low", "_high")

    def filter(self, docs: DataFrame) -> DataFrame:
        """The documents that are kept, with their own columns."""
        scores = self.scores if docs is self.docs else self.model.scores(docs)
        kept = self.decide(scores).where("keep").select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), F.col("lang").alias("_in"))
        row = F.struct(*(F.col(c) for c in docs.columns)).alias("_row")
        own = docs.select(row, F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_text"), F.col("lang").cast("string").alias("_of"))
        same = own["_id"].eqNullSafe(kept["_doc"]) & (own["_text"] == kept["_hash"]) & own["_of"].eqNullSafe(kept["_in"])
        return own.join(kept.hint("merge"), same, "left_semi").select("_row.*")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, perplexity and keep of every document."""
    model = QualityModel(docs, labels)
    release(*model.model.prob.values(), *model.model.back.values())
    return model.decide(model.scores).select("doc_id", "lang", F.exp("surprise").alias("perplexity"), "keep")
