"""Document fingerprints by consistent weighted sampling.

The terms of a text are its words, lower-cased, weighted by how often they
occur. For each of SAMPLES independent draws every term gets two Gamma(2, 1)
values and an offset from a hash of the term and the draw; the term with the
smallest quantised value wins, and the sample is (term, quantised weight). Two
texts share a sample with probability sum(min) / sum(max) of their weights.

Defined results: a null text is empty; an empty text, or one without words, has
the empty fingerprint, whose likeness is 1 to another empty one and 0 to any
other; rows of equal doc_id are ordered by text; null ids come last in
descending order; a single row is its own neighbour; an empty table gives an
empty result; long texts are sampled whole, a block of terms at a time; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.plans.scratch import materialize

SAMPLES = 64
#: Terms whose draws a worker keeps (1 KB each), and terms compared at once.
CACHE_TERMS, BLOCK = 60_000, 4_096
#: Characters of a text that take part in the ranges.
PREFIX = 64
_WORD = re.compile(r"\w+")
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64."""
    x = x + _GOLDEN
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Sampler:
    """Draws by term, kept in each worker."""

    _kept: dict[int, Sampler] = {}

    def __init__(self, samples: int = SAMPLES):
        self.samples, self.rows = samples, {}
        shape = (CACHE_TERMS + BLOCK, samples)
        self.rate, self.cost, self.shift, self.once = (np.empty(shape, np.float32) for _ in range(4))
        self.names = np.empty(len(self.rate), np.uint64)
        self.streams = _mixed(np.arange(5 * samples, dtype=np.uint64)).reshape(5, 1, samples)

    @classmethod
    def of(cls, samples: int = SAMPLES) -> Sampler:
        if samples not in cls._kept:
            cls._kept[samples] = cls(samples)
        return cls._kept[samples]

    def draw(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gamma rate r, log of Gamma cost c, and offset of every term (rows) and draw (columns)."""
        u = ((_mixed(names[None, :, None] ^ self.streams) >> np.uint64(40)).astype(np.float32) + np.float32(0.5)) * np.float32(2**-24)
        return -np.log(u[0] * u[1]), np.log(-np.log(u[2] * u[3])), u[4]

    def _places(self, terms: list[str]) -> np.ndarray:
        rows = self.rows
        new = [t for t in terms if t not in rows]
        if len(rows) + len(new) > CACHE_TERMS:
            rows.clear()
            new = terms
        if new:
            at = len(rows)
            names = np.array([xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) for t in new], np.uint64)
            r, c, b = self.draw(names)
            own = slice(at, at + len(new))
            self.names[own], self.rate[own], self.cost[own], self.shift[own] = names, r, c, b
            # A term that occurs once has weight 1, whose log is 0.
            self.once[own] = c - r * (1 - b)
            rows.update(zip(new, range(at, at + len(new)), strict=True))
        return np.fromiter(map(rows.__getitem__, terms), np.int64, len(terms))

    def sample(self, counts: Counter) -> np.ndarray | None:
        """16 bits a draw that stand for (term, quantised weight)."""
        if not counts:
            return None
        terms, best, out = list(counts), None, None
        every = np.arange(self.samples)
        for k in range(0, len(terms), BLOCK):
            some = terms[k : k + BLOCK]
            at = self._places(some)
            weight = np.fromiter(map(counts.__getitem__, some), np.float64, len(some))
            value = self.once[at]
            level = np.zeros(value.shape, np.int64)
            many = np.flatnonzero(weight > 1)
            if len(many):
                r, c, b = self.rate[at[many]], self.cost[at[many]], self.shift[at[many]]
                level[many] = t = np.floor(np.log(weight[many])[:, None] / r + b)
                value[many] = c - r * (t - b + 1)
            win = value.argmin(0)
            low, ids = value[win, every], _mixed(self.names[at[win]] + level[win, every].astype(np.uint64) * _GOLDEN)
            if best is None:
                best, out = low, ids
            else:
                better = low < best
                best, out = np.where(better, low, best), np.where(better, ids, out)
        return (out >> np.uint64(48)).astype(">u2")

    def of_text(self, text: str) -> np.ndarray | None:
        return self.sample(Counter(_WORD.findall(text.lower())))


def shown(sample: np.ndarray | None) -> str:
    return "" if sample is None else sample.tobytes().hex()


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    """The share of draws on which two fingerprints agree."""
    return float(a is b) if a is None or b is None else float((a == b).mean())


def edit(text: str, following: str) -> str:
    """The text with its last third replaced by as much of the beginning of the following one."""
    m = len(text) // 3
    return text[: len(text) - m] + following[:m]


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "role", "part", "text"]
_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, role string, part int, text string"
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string(), pa.int32(), pa.string()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES)], _NAMES)


def _finished(sampler: Sampler, doc: int | None, text: str, own: np.ndarray | None, following: str, theirs: np.ndarray | None, part: int) -> tuple:
    edited = edit(text, following)
    changed = sampler.of_text(edited)
    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return doc, len(text), digest, shown(own), shown(changed), likeness(own, changed), likeness(own, theirs), "whole", part, None


def with_neighbours(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every document and of its text edited with the next one's, in descending order of doc_id.

    Texts are shuffled once, by ranges of doc_id. A range's last row waits for the
    first row of the next range; both are kept aside, two rows a range, and joined.
    """
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # Rows of one id are dealt by the beginnings of their texts, in the order of the texts.
    ordered = chosen.repartitionByRange(F.desc_nulls_last("doc_id"), F.left("text", F.lit(PREFIX))).sortWithinPartitions(F.desc_nulls_last("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, part, last = Sampler.of(samples), TaskContext.get().partitionId(), None
        for batch in batches:
            rows = []
            for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = sampler.of_text(text)
                if last is None:
                    rows.append((doc, len(text), None, None, None, None, None, "first", part, text))
                else:
                    rows.append(_finished(sampler, *last, text, own, part))
                last = doc, text, own
            if rows:
                yield _batch(rows)
        if last is not None:
            yield _batch([(last[0], len(last[1]), None, None, None, None, None, "last", part, last[1])])

    done = materialize(ordered.mapInArrow(run, _SCHEMA), "fingerprints")
    firsts = done.where("role = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    parts = done.where("role = 'last'").select("part")
    by_part = Window.orderBy("part")
    lowest = F.min("part").over(by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    order = parts.select("part", F.coalesce(F.lead("part").over(by_part), lowest).alias("next_part"))
    waiting = done.where("role = 'last'").select("doc_id", "text", "part").join(order, "part").join(firsts, "next_part").select("doc_id", "text", "next_text", "part")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler.of(samples)
        for batch in batches:
            rows = [_finished(sampler, doc, text, sampler.of_text(text), then, sampler.of_text(then), part) for doc, text, then, part in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            if rows:
                yield _batch(rows)

    return done.where("role = 'whole'").unionByName(waiting.mapInArrow(finish, _SCHEMA)).drop("role", "part", "text")
