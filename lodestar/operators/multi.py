"""One search over many collections: one scan, one plan, a report row a collection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from lodestar.functions.scores import bm25_gain, idf
from lodestar.functions.text import tokenize
from lodestar.operators import vector
from lodestar.operators.fusion import RRF_K
from lodestar.operators.keyword import part_of, query_terms, searchable

KEYS = ("collection", "source_key", "point_id")
REPORT = "collection string, status string, detail string, matched long, comparable long, hits long"


def _best(rows: DataFrame, k: int, ties: Sequence[str]) -> DataFrame:
    best = Window.partitionBy("collection").orderBy(F.desc("score"), *ties)
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def observed(rows: DataFrame, names: Sequence[str], dimension: int, seen: Observation) -> DataFrame:
    """The rows, with the number of each collection's rows and of those of the query's dimension observed on the way."""
    fits = F.size("vector") == dimension
    own = [F.count(F.when(F.col("collection") == n, 1)).alias(f"matched_{i}") for i, n in enumerate(names)]
    return rows.observe(seen, *own, *(F.count(F.when((F.col("collection") == n) & fits, 1)).alias(f"comparable_{i}") for i, n in enumerate(names)))


def report(spark, names: Sequence[str], failed: dict[str, str], seen: dict, hits: dict[str, int]) -> DataFrame:
    """REPORT rows: collections that could not be read, those whose rows the query cannot be compared with, and the others."""
    rows = [(n, "failed", why, 0, 0, 0) for n, why in failed.items()]
    for i, n in enumerate(names):
        matched, fit = int(seen.get(f"matched_{i}") or 0), int(seen.get(f"comparable_{i}") or 0)
        odd = matched > 0 and not fit
        rows.append((n, "failed" if odd else "ok", "vectors of another dimension" if odd else "", matched, fit, hits.get(n, 0)))
    return spark.createDataFrame(sorted(rows), REPORT)


def keyword_hits(terms: DataFrame, stats: DataFrame, query: str, k: int, among: DataFrame | None = None) -> DataFrame:
    """(keys, score, rank) of the k best rows of each collection by BM25, with statistics (collection, n, mean) of their own.

    With ``among`` (points) only those rows count, in statistics too.
    """
    asked = query_terms(terms, query)
    listed = F.array(*(F.lit(t) for t in asked)).cast("array<string>")
    parts = terms.sparkSession.range(1).select(F.transform(listed, part_of).alias("p")).first()["p"]
    hits = terms.where(F.col("term").isin(list(asked)) & F.col("part").isin(sorted(set(parts))))
    if among is not None:
        hits = hits.join(among.select(*KEYS), list(KEYS), "left_semi")
        sizes = F.size(tokenize(searchable(among, "text", "tags" if "tags" in among.columns else None)))
        stats = among.groupBy("collection").agg(F.count(F.lit(1)).alias("n"), F.avg(sizes).alias("mean"))
    weighed = hits.groupBy("collection", "term").agg(F.count(F.lit(1)).alias("df")).join(stats, "collection")
    times = F.create_map(*(F.lit(x) for pair in asked.items() for x in pair)) if asked else F.create_map().cast("map<string,int>")
    weighed = weighed.select("collection", "term", (times[F.col("term")] * idf(F.col("n"), F.col("df"))).alias("w"), "mean")
    scored = hits.join(weighed, ["collection", "term"]).groupBy(*KEYS).agg(F.sum(F.col("w") * bm25_gain(F.col("tf"), F.col("dl"), F.col("mean"))).alias("score"))
    return _best(scored, k, KEYS)


def fused_hits(near: DataFrame, words: DataFrame | None, k: int) -> DataFrame:
    """(keys, score, score_kind): both lists of each collection fused by rank; a collection without hits by words keeps its cosines."""
    votes = near.select(*KEYS, "rank", F.col("score").alias("cosine"))
    if words is None:
        return votes.select(*KEYS, F.col("cosine").alias("score"), F.lit("cosine").alias("score_kind"))
    votes = votes.unionByName(words.select(*KEYS, "rank", F.lit(None).cast("double").alias("cosine")))
    summed = votes.groupBy(*KEYS).agg(F.sum(1.0 / (RRF_K + F.col("rank"))).alias("rrf"), F.max("cosine").alias("cosine"))
    told = words.select("collection", F.lit(True).alias("_words")).distinct()
    both = summed.join(told, "collection", "left").withColumn("score", F.when(F.col("_words"), F.col("rrf")).otherwise(F.col("cosine")))
    return _best(both, k, KEYS).select(*KEYS, "score", F.when(F.col("_words"), "rrf").otherwise("cosine").alias("score_kind"))


def near_hits(rows: DataFrame, vec: Sequence[float], k: int, threshold: float) -> DataFrame:
    """(keys, score, rank) of the k nearest rows of each collection."""
    return vector.search_per_group(rows, vec, "collection", k, threshold, ties=("source_key", "chunk_index", "point_id")).select(*KEYS, "score", "rank")
