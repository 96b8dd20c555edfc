"""Exact top-k search by BM25 over sharded inverted indexes with block-max WAND pruning.

Every shard is an inverted index of a bounded number of documents, built where
they are read. N, the mean length and document frequencies are those of the whole
corpus. Documents of a shard stand in blocks of BLOCK; for every term, rare or
frequent, and every block it occurs in, the shard knows the term's largest
contribution there and where its postings of that block begin. For a query the
sum of these maxima bounds the scores of each block. Blocks are visited from the
highest bound down, and only their postings are read and scored; the k-th best
score so far, there or in the shards searched first, is the threshold, and the
pivot is the first block whose bound is below it: that block and all behind it
are skipped with their postings. A shard takes many queries at once: postings of its
frequent terms are dense columns, so that their bounds, and the scores of a block
for all queries that visit it, are matrix products in single precision; all other
postings are added one by one. What its possible error leaves in doubt is
computed again in the order of the terms' hashes, so scores do not depend on the
sharding. The shards' results are merged by score
(rounded to DIGITS decimals, as returned), then doc_id.

Queries are taken in blocks of a bounded number of terms, each broadcast to all
shards and destroyed afterwards; the broadcast's size does not depend on the corpus.

Defined results: terms are lower-cased runs of word characters; a term that
occurs twice in a query counts twice; null and empty texts are documents of
length 0 and match nothing; ties go to the smaller doc_id, null ids last; a
query has fewer than k rows if fewer documents share a term with it; repeated
rows are documents of their own; an empty table gives an empty result; texts are
used whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.plans.scratch import materialize, scratch_path

K1, B = 1.2, 0.75
#: A shard's bounds. A task holds one shard, so they bound a Python worker's memory.
SHARD_DOCS, SHARD_POSTINGS = 4096, 2_000_000
BLOCK = 64
#: Query terms that are broadcast at once (16 bytes each).
QUERY_TERMS = 1_000_000
#: One shard in so many is searched first, and of those one in so many before the others.
WAVE = 8
#: Blocks visited first; each further step visits four times as many as the one before.
STEP = 2
#: Queries that a shard answers together.
TOGETHER = 128
#: A shard's terms that are kept as dense columns: so many at most, each in so many documents at least (and in one of BLOCK).
DENSE, MIN_DENSE = 2048, 32
#: Decimals of the scores.
DIGITS = 6
_NULL = -(1 << 63)
_WORD = re.compile(r"\w+")

_SHARD = "ids binary, lengths binary, terms binary, starts binary, docs binary, tfs binary"


class Terms(dict):
    """64-bit hashes of words; forgets all when it has grown too large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return found


def tokens(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def build_index(docs: DataFrame, order: str | None = None) -> DataFrame:
    """One row a shard; ``order`` names a column by which a shard's documents are arranged, so that blocks are alike."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (F.col(order).cast("string") if order else F.lit("")).alias("arrange"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, size = Terms(), [], 0

        def flush() -> pa.RecordBatch:
            held.sort(key=lambda x: (x[0] or "", x[2]))
            counts = [len(x[3]) for x in held]
            names = np.concatenate([x[3] for x in held]) if held else np.zeros(0, np.uint64)
            tfs = np.concatenate([x[4] for x in held])
            own = np.repeat(np.arange(len(held), dtype=np.int32), counts)
            by = np.argsort(names, kind="stable")
            terms, starts = np.unique(names[by], return_index=True)
            columns = [np.array([_NULL if x[1] is None else x[1] for x in held], np.int64), np.array([x[2] for x in held], np.int64), terms, np.append(starts, len(by)).astype(np.int64), own[by], tfs[by].astype(np.int32)]
            return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], ["ids", "lengths", "terms", "starts", "docs", "tfs"])

        for batch in batches:
            for doc, text, arrange in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = tokens(text)
                count = Counter(words)
                held.append((arrange, doc, len(words), np.fromiter(map(hashes.__getitem__, count), np.uint64, len(count)), np.fromiter(count.values(), np.int64, len(count))))
                size += len(count)
                if len(held) >= SHARD_DOCS or size >= SHARD_POSTINGS:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return materialize(rows.mapInArrow(run, _SHARD).select(F.monotonically_increasing_id().alias("shard"), "*"), "index")


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def statistics(index: DataFrame) -> tuple[int, float, DataFrame]:
    """N, the mean length, and (term, df) over all shards."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [np.frombuffer(x, np.int64) for x in batch.column("lengths").to_pylist()]
            n, total = [len(x) for x in sizes], [int(x.sum()) for x in sizes]
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(total, pa.int64())], ["n", "total"])

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, starts in zip(batch.column("terms").to_pylist(), batch.column("starts").to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(_signed(np.frombuffer(terms, np.uint64))), pa.array(np.diff(np.frombuffer(starts, np.int64)))], ["term", "df"])

    row = index.select("lengths").mapInArrow(sizes, "n long, total long").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    n, total = row["n"] or 0, row["total"] or 0
    df = index.select("terms", "starts").mapInArrow(frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return n, (total / n if n and total else 1.0), df


def query_terms(queries: DataFrame) -> DataFrame:
    """(query, query_id, term, qtf): query numbers the rows."""
    rows = queries.select(F.monotonically_increasing_id().alias("query"), F.col("doc_id").cast("long").alias("query_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Terms()
        for batch in batches:
            out = [(q, i, h, n) for q, i, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) for h, n in ((hashes[w], n) for w, n in Counter(tokens(t)).items())]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array(_signed(np.array([x[2] for x in out], np.uint64))), pa.array([x[3] for x in out], pa.int64())], ["query", "query_id", "term", "qtf"])

    return rows.mapInArrow(run, "query long, query_id long, term long, qtf long")


def _flat(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices of all given ranges in a row."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    return np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())


class Shard:
    """A shard's index made ready for scoring: postings by term and, within a term, by block."""

    def __init__(self, row: dict, mean: float):
        self.ids, lengths = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["lengths"], np.int64)
        self.terms, starts = np.frombuffer(row["terms"], np.uint64), np.frombuffer(row["starts"], np.int64)
        self.docs, tfs = np.frombuffer(row["docs"], np.int32), np.frombuffer(row["tfs"], np.int32)
        self.blocks = -(-len(self.ids) // BLOCK)
        norm = K1 * (1 - B + B * lengths / mean)
        self.gain = norm[self.docs]
        self.gain += tfs
        np.divide(tfs * (K1 + 1), self.gain, out=self.gain)
        block = self.docs // BLOCK
        turn = np.ones(len(block), bool)
        turn[1:] = block[1:] != block[:-1]
        turn[starts[:-1][np.diff(starts) > 0]] = True
        #: A run is what a term has in a block: its first posting, its block and its largest contribution.
        first = np.flatnonzero(turn)
        self.run_block = block[first]
        self.run_best = np.maximum.reduceat(self.gain, first) if len(first) else np.zeros(0)
        self.run_start = np.append(first, len(block))
        self.term_runs = np.searchsorted(first, starts)
        self.read = 0
        self._split(starts)

    def _split(self, starts: np.ndarray) -> None:
        """Frequent terms as dense columns of each block, beside their block maxima; and the postings by document."""
        df = np.diff(starts)
        some = np.flatnonzero(df >= max(MIN_DENSE, len(self.ids) // BLOCK))
        some = np.sort(some[np.argsort(-df[some], kind="stable")[:DENSE]])
        self.column = np.full(len(self.terms), -1, np.int32)
        self.column[some] = np.arange(len(some))
        # One block at a time: a shard's documents by all its frequent terms would be most of its memory.
        postings, columns = _flat(starts[some], df[some]), np.repeat(np.arange(len(some), dtype=np.int32), df[some])
        by = np.argsort(self.docs[postings], kind="stable")
        postings, columns = postings[by], columns[by]
        ends = np.searchsorted(self.docs[postings], np.arange(self.blocks + 1) * BLOCK)
        self.best, self.dense = np.zeros((self.blocks, len(some)), np.float32), []
        for b in range(self.blocks):
            own, block = slice(ends[b], ends[b + 1]), np.zeros((BLOCK, len(some)), np.float32)
            block[self.docs[postings[own]] - b * BLOCK, columns[own]] = self.gain[postings[own]]
            if len(some):
                self.best[b] = block.max(0)
            c = np.flatnonzero(self.best[b])
            self.dense.append((c, np.ascontiguousarray(block[:, c].T), np.count_nonzero(block[:, c], axis=0)))
        del postings, columns, by
        #: What single precision may be off, as a share of a sum of positive numbers.
        self.error = (len(some) + 3) * 2.0**-23
        by = np.argsort(self.docs, kind="stable")
        self.own_slot = np.repeat(np.arange(len(df), dtype=np.int32), df)[by]
        self.own_gain = self.gain[by]
        self.own_start = np.searchsorted(self.docs[by], np.arange(len(self.ids) + 1))

    def search(self, starts: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions and scores of the best k documents of each query that score no less than ``least``; query i has the terms (in order of hash) from starts[i] to starts[i + 1]."""
        for first in range(0, len(starts) - 1, TOGETHER):
            some = starts[first : first + TOGETHER + 1]
            own = terms[some[0] : some[-1]]
            at = np.searchsorted(self.terms, own)
            at[at == len(self.terms)] = 0
            known = np.flatnonzero(self.terms[at] == own) if len(self.terms) else np.zeros(0, np.int64)
            query = np.repeat(np.arange(len(some) - 1), np.diff(some))
            yield from self._best(query[known], at[known], weights[some[0] : some[-1]][known], k, least[first : first + TOGETHER])

    def _best(self, query: np.ndarray, slots: np.ndarray, weights: np.ndarray, k: int, given: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The same for some queries at once. Scores of visited blocks are sums in single precision for frequent terms; those that may be good enough are computed again, exactly."""
        count, n = len(given), self.blocks * BLOCK
        column = self.column[slots]
        often = column >= 0
        asked = np.zeros((count, self.best.shape[1]), np.float32)
        asked[query[often], column[often]] = weights[often]
        used = asked.any(0)
        few = 2 * np.count_nonzero(used) < len(used)
        rare = ~often
        sizes = self.term_runs[slots[rare] + 1] - self.term_runs[slots[rare]]
        runs, weight, whose = _flat(self.term_runs[slots[rare]], sizes), np.repeat(weights[rare], sizes), np.repeat(query[rare], sizes)
        where = self.run_block[runs]
        bound = (asked @ self.best.T).astype(np.float64)
        bound += np.bincount(whose * self.blocks + where, self.run_best[runs] * weight, count * self.blocks).reshape(count, self.blocks)
        # A score is at most half a unit of its last decimal above what it is rounded to.
        slack = 10.0**-DIGITS
        bound = bound * (1 + self.error)
        order = np.argsort(-bound, axis=1, kind="stable")
        ordered = np.take_along_axis(bound, order, 1)
        near, least, at, step = np.zeros((count, n)), given * (1 - self.error) - slack, 0, STEP
        if (given > 0).all():
            # All of them know what is good enough: one step takes all blocks down to the pivot.
            step = self.blocks
        while at < self.blocks:
            # The pivot: blocks are in the order of their bounds, so all behind the first that is too low are too.
            good = ordered[:, at : at + step] >= np.maximum(least, 1e-12)[:, None]
            if not good.any():
                break
            todo = np.zeros((count, self.blocks), bool)
            np.put_along_axis(todo, order[:, at : at + step], good, 1)
            for b in np.flatnonzero(todo.any(0)).tolist():
                rows = np.flatnonzero(todo[:, b])
                columns, gains, postings = self.dense[b]
                if few:
                    some = np.flatnonzero(used[columns])
                    columns, gains, postings = columns[some], gains[some], postings[some]
                self.read += int(postings.sum())
                near[rows, b * BLOCK : (b + 1) * BLOCK] = asked.take(rows, 0).take(columns, 1) @ gains
            live = np.flatnonzero(todo[whose, where])
            own = runs[live]
            many = self.run_start[own + 1] - self.run_start[own]
            posting = _flat(self.run_start[own], many)
            self.read += len(posting)
            np.add.at(near.ravel(), np.repeat(whose[live], many) * n + self.docs[posting], self.gain[posting] * np.repeat(weight[live], many))
            full = np.flatnonzero((near >= np.maximum(least, 1e-12)[:, None]).sum(1) >= k)
            if len(full):
                least[full] = np.maximum(least[full], np.partition(near[full], n - k, axis=1)[:, n - k] * (1 - 2 * self.error) - slack)
            at, step = at + step, 4 * step
        whose, docs = np.nonzero(near >= np.maximum(least, 1e-12)[:, None])
        scores = np.round(self._exact(query, slots, weights, whose, docs), DIGITS)
        fit = (scores > 0) & (scores >= given[whose])
        whose, docs, scores = whose[fit], docs[fit], scores[fit]
        ids = self.ids[docs]
        by = np.lexsort((np.where(ids == _NULL, np.iinfo(np.int64).max, ids), -scores, whose))
        ends = np.searchsorted(whose[by], np.arange(count + 1))
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            some = by[a : min(b, a + k)]
            yield docs[some], scores[some]

    def _exact(self, query: np.ndarray, slots: np.ndarray, weights: np.ndarray, whose: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Scores of documents for queries, summed in the order of the terms' hashes."""
        sizes = self.own_start[docs + 1] - self.own_start[docs]
        posting, pair = _flat(self.own_start[docs], sizes), np.repeat(np.arange(len(docs)), sizes)
        # By query, then by slot.
        names = query * len(self.terms) + slots
        wanted = np.repeat(whose, sizes) * len(self.terms) + self.own_slot[posting]
        place = np.minimum(np.searchsorted(names, wanted), max(len(names) - 1, 0))
        hit = np.flatnonzero(names[place] == wanted) if len(names) else np.zeros(0, np.int64)
        return np.bincount(pair[hit], self.own_gain[posting[hit]] * weights[place[hit]], len(docs))


def search(docs: DataFrame, queries: DataFrame, k: int = 10, order: str | None = None) -> DataFrame:
    """query_id, rank, doc_id, score: the k best documents of every row of ``queries`` (doc_id, text)."""
    spark = docs.sparkSession
    index = build_index(docs, order)
    n, mean, df = statistics(index)
    terms = materialize(query_terms(queries), "query-terms")
    idf = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    blocks = max(1, -(-terms.count() // QUERY_TERMS))
    block = F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int")
    path = scratch_path(spark, "queries")
    weighted = terms.join(df, "term").select("query", "query_id", F.col("term"), (F.col("qtf") * idf).alias("weight"), block.alias("block"))
    weighted.repartition(blocks, "block").write.partitionBy("block").parquet(path)
    stored = spark.read.schema("query long, query_id long, term long, weight double, block int").parquet(path)
    found = None
    for number in range(blocks):
        # A block has about QUERY_TERMS terms whatever the corpus.
        rows = stored.where(F.col("block") == number).select("query", "query_id", "term", "weight").toArrow()
        query, term, weight = (rows.column(c).to_numpy() for c in ("query", "term", "weight"))
        term = term.view(np.uint64)
        by = np.lexsort((term, query))
        query, term, weight = query[by], term[by], weight[by]
        numbers, starts = np.unique(query, return_index=True)
        names = rows.column("query_id").take(pa.array(by[starts])).to_pylist()
        del rows
        given = (numbers, names, np.append(starts, len(query)), term, weight)
        # Few shards give each query a score that its k-th best document reaches, more of them a better one; the others return what is no worse.
        turn = F.pmod(F.xxhash64("shard"), F.lit(WAVE * WAVE))
        waves = (turn == 0, (turn > 0) & (turn % WAVE == 0), turn % WAVE > 0)
        least, own = np.zeros(len(numbers)), None
        for wave in waves:
            shared = spark.sparkContext.broadcast((*given, least.copy()))
            part = materialize(index.where(wave).drop("shard").mapInArrow(_scan(shared, mean, k), "query long, query_id long, doc_id long, score double"), "found")
            shared.destroy()
            own = part if own is None else own.unionByName(part)
            if wave is not waves[-1]:
                nth = own.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))).where(F.col("n") == k).select("query", "score").toArrow()
                least[np.searchsorted(numbers, nth.column("query").to_numpy())] = nth.column("score").to_numpy()
        found = own if found is None else found.unionByName(own)
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", "score")


def _scan(shared, mean: float, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, names, starts, terms, weights, least = shared.value
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        for batch in batches:
            # One shard at a time, read in place.
            for i in range(batch.num_rows):
                shard, out = Shard({c: batch.column(c)[i].as_buffer() for c in batch.schema.names}, mean), []
                for number, name, (at, scores) in zip(numbers.tolist(), names, shard.search(starts, terms, weights, k, least), strict=True):
                    out += [(number, name, None if d == _NULL else d, s) for d, s in zip(shard.ids[at].tolist(), scores.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate(kinds)], ["query", "query_id", "doc_id", "score"])

    return run
