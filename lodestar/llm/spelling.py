"""Spelling variants of words, grouped by anagram hashing.

A word's key is the sum of a power of each of its letters, so that anagrams share
it and one edit changes it by the value of a letter. Each word is posted under its
key and under its key less the value of each of its distinct letters. Words whose
keys differ by one added or removed letter meet where one's key is the other's
key less a letter; words whose keys differ by an exchange meet where both have
lost the exchanged letter. One edit leaves the first or the last three letters of
a word alone, and postings carry those: that splits hot keys, such as one class of
anagrams. The letter order of what meets is verified by the edit distance. Counting
is an aggregate before the shuffle in every task; the join is an equi-join.

Words follow their form (the much more frequent near word) to the last by pointer
doubling; counts grow fivefold at each step, so a few rounds are enough.

Defined results: a null text has no words; a null doc_id counts as an empty
decimal; rows that repeat are counted again; ties of a form go to the smallest word
in code-point order; an empty table gives an empty result; words of any length are
compared whole; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.plans.scratch import materialize, release

MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5
#: One (document, word) in so many loses a letter before it is counted.
DROPPED = 199
#: Words that a task counts before it hands them on.
HELD = 200_000
#: Letters at an end of a word that go into a posting: half of the shortest word.
END = MIN_LENGTH // 2
#: Power of a letter's code point, and the prime that keeps sums of any length in 64 bits.
POWER, PRIME = 5, (1 << 61) - 1

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def lowered(run: str) -> str:
    """A-Z in lower case, all other letters as they are."""
    return run.lower() if run.isascii() else run.translate(_LOWER)


def damaged(word: str, salt: int) -> str:
    """The word, or without one letter if its hash with the document's says so; ``salt`` is the crc32 of the document's id and a colon."""
    h = zlib.crc32(word.encode(), salt)
    if h % DROPPED:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all words of at least MIN_LENGTH letters."""
    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                salt = zlib.crc32(f"{doc.as_py() or ''}:".encode())
                for found, n in Counter(_RUN.findall(text.as_py())).items():
                    if len(found) >= MIN_LENGTH:
                        word = damaged(lowered(found), salt)
                        if len(word) >= MIN_LENGTH:
                            held[word] += n
                if len(held) > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
                    held.clear()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _value(letter: Column) -> Column:
    code, out = F.ascii(letter).cast("long"), F.lit(1).cast("long")
    for _ in range(POWER):
        out = out * code
    return out


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, n of the word, near_n): both directions of every two words (word, n) that differ by one edit."""
    letters = F.filter(F.split("word", ""), lambda c: c != "")
    keyed = words.select("word", "n", letters.alias("letters")).withColumn("key", F.aggregate("letters", F.lit(0).cast("long"), lambda s, c: (s + _value(c)) % PRIME))
    ends = F.array(F.struct(F.lit(0).alias("side"), F.left("word", F.lit(END)).alias("end")), F.struct(F.lit(1).alias("side"), F.right("word", F.lit(END)).alias("end")))
    less = F.transform(F.array_distinct("letters"), lambda c: F.pmod(F.col("key") - _value(c), F.lit(PRIME)))
    sided = keyed.select("word", "n", "key", less.alias("less"), F.explode(ends).alias("e")).select("word", "n", "key", "less", "e.side", "e.end")
    lost = sided.select("word", "n", "side", "end", F.explode("less").alias("key"))
    full = sided.select("word", "n", "side", "end", "key", F.lit(True).alias("whole"))
    left = lost.select(F.col("word").alias("near"), F.col("n").alias("near_n"), "side", "end", "key")
    met = left.join(lost.withColumn("whole", F.lit(False)).unionByName(full).hint("merge"), ["key", "side", "end"])
    # Exchanges meet from both sides, additions from one; what agrees at both ends has met already by the first.
    once = met.where("(whole or word < near) and (side = 0 or left(word, {0}) <> left(near, {0}))".format(END))
    pairs = once.where(F.levenshtein("word", "near", 1) == 1).select("word", "near", "n", "near_n").distinct()
    both = F.array(F.struct("word", "near", "n", "near_n"), F.struct(F.col("near").alias("word"), F.col("word").alias("near"), F.col("near_n").alias("n"), F.col("n").alias("near_n")))
    return pairs.select(F.explode(both).alias("x")).select("x.*")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms (word, form): the last word of each chain."""
    current = materialize(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = current.select(F.col("word").alias("root"), F.col("root").alias("further"))
        following = materialize(current.join(ahead.hint("merge"), "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        release(current)
        current = following.select("word", "root")
        current._lodestar_path = following._lodestar_path
        if following.where("moved").isEmpty():
            return current


def group(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word that occurs often enough.

    All joins are of two shuffled sides: the tables of words are small files for what they hold, so a plan may
    take one for small enough to be gathered by the driver and broadcast.
    """
    words = materialize(word_counts(docs).where(F.col("n") >= MIN_COUNT), "spelling-words")
    # The largest n, then the smallest word: the least of (-n, word).
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    near = materialize(near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best), "spelling-near")
    judged = words.join(near.hint("merge"), "word", "left").withColumn("good", F.col("n") * RATIO <= -F.col("best.less"))
    table = judged.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("good"), F.col("best.near")).alias("form"), F.when(F.col("good"), -F.col("best.less")).alias("form_n"))
    table = materialize(table, "spelling-forms")
    roots = _roots(table.where("form is not null"))
    return table.join(roots.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
