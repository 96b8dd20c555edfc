"""Exact nearest neighbours by cosine similarity."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.functions.scores import cosine, norm
from lodestar.operators.filters import apply_filter
from lodestar.plans.scratch import free_shuffles, materialize, release, scratch_path

#: Points that others are dealt to, of each dimension; points of a tile; queries that go through at once; queries of one product; tasks of a wave at most.
PIVOTS, BLOCK, WAVE, STEP, TASKS = 64, 8192, 16384, 256, 1024
#: Decimals that ranks go by, and what rounding may add to a bound.
DIGITS, SLACK = 9, 1e-6


def _literal(vector: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def scored(points: DataFrame, vector: Sequence[float], column: str = "vector") -> DataFrame:
    """Points of the query's dimension with their score; others are skipped."""
    size = float(np.sqrt(np.sum(np.square(np.asarray(vector, np.float64)))))
    stored = F.coalesce("norm", norm(F.col(column))) if "norm" in points.columns else None
    return points.where(F.size(column) == len(vector)).withColumn("score", cosine(_literal(vector), F.col(column), F.lit(size), stored))


def search(points: DataFrame, vector: Sequence[float], k: int = 10, threshold: float = 0.0, condition: dict | None = None, column: str = "vector", ties: Sequence[str] = ("point_id",)) -> DataFrame:
    """The k best points; a threshold counts only if positive. Ties go by the given columns."""
    out = scored(apply_filter(points, condition), vector, column)
    out = out.where(F.col("score") >= threshold) if threshold > 0 else out
    return out.orderBy(F.desc("score"), *ties).limit(k)


def check_dimension(points: DataFrame, size: int, column: str = "vector") -> None:
    """Raise if points exist but none has the query's dimension."""
    row = points.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.size(column) == size, 1)).alias("fit"), F.min(F.size(column)).alias("own")).first()
    if row["n"] and not row["fit"]:
        raise ValueError(f"stored vectors have dimension {row['own']}, the query has {size}")


def search_per_group(points: DataFrame, vector: Sequence[float], group: str, k: int = 10, threshold: float = 0.0, column: str = "vector", ties: Sequence[str] = ("point_id",)) -> DataFrame:
    """The k best points of every group (for a search over several collections), with their rank."""
    out = scored(points, vector, column)
    out = out.where(F.col("score") >= threshold) if threshold > 0 else out
    best = Window.partitionBy(group).orderBy(F.desc("score"), *ties)
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def search_many(points: DataFrame, queries: DataFrame, k: int = 10, threshold: float = 0.0, id_column: str = "point_id", column: str = "vector") -> DataFrame:
    """(query_id, point_id, score, rank) for a table of queries (query_id, vector), exact; both tables are distributed.

    Points are dealt to the nearest of PIVOTS of them; small clusters share a group, large ones are cut into several. A query first
    meets one group, that of its own pivot, which gives a score that its k-th best has at least. By the angles between query, pivots
    and points (a triangle on the sphere) it then meets only the groups that can hold a better one. Such a tile of points and queries
    is one matrix product and returns k rows a query at most. Queries go through in waves of about WAVE, each of which shuffles the
    points once, so that disk grows with the points and not with points x queries. Ranks go by the score rounded to DIGITS decimals,
    then by id. Points and queries without a vector are skipped, and so are points of another dimension than the query; a vector
    without length scores 0.
    """
    spark = points.sparkSession
    kind = lambda df, c: "array<float>" if df.schema[c].dataType == T.ArrayType(T.FloatType()) else "array<double>"
    held, told = kind(points, column), kind(queries, "vector")
    ours = points.select(F.col(id_column).cast("long").alias("id"), F.col(column).cast(held).alias("v")).where("v is not null")
    asked = queries.select(F.col("query_id").cast("long").alias("id"), F.col("vector").cast(told).alias("v")).where("v is not null")
    first = Window.partitionBy(F.size("v")).orderBy(F.xxhash64("id"), "id")
    pivots: dict[int, np.ndarray] = {}
    # PIVOTS rows for each dimension.
    for row in ours.withColumn("n", F.row_number().over(first)).where(F.col("n") <= PIVOTS).orderBy("n").collect():
        pivots.setdefault(len(row["v"]), []).append(row["v"])
    pivots = {n: _unit(np.array(rows, np.float64)) for n, rows in pivots.items()}
    if not pivots:
        return spark.createDataFrame([], "query_id long, point_id long, score double, rank int")
    placed = materialize(ours.mapInPandas(_placed(pivots), f"id long, v {held}, dim int, cluster int, angle double"), "vectors")
    whole = [r.asDict() for r in placed.groupBy("dim", "cluster").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")).orderBy("dim", "cluster").collect()]
    groups = _grouped(whole)
    span = F.create_map(*(x for c in whole for x in (F.lit(f"{c['dim']}:{c['cluster']}"), F.array(F.lit(c["first"]), F.lit(c["blocks"])))))
    own = F.try_element_at(span, F.concat_ws(":", "dim", "cluster"))
    group = (own[0] + F.pmod(F.xxhash64("id"), own[1])).cast("int").alias("group")
    cut = placed.select(group, "id", "v")
    # A query's pivot may have no points: then no group tells anything, and no score is known.
    mine = materialize(asked.mapInPandas(_placed(pivots), f"id long, v {told}, dim int, cluster int, angle double").select(group, "id", "v"), "queries")
    counts = [(r["group"], r["count"]) for r in mine.groupBy("group").count().where(F.col("count") > WAVE).collect()]
    waves = max(1, -(-mine.count() // WAVE))
    # Very many queries of one group are dealt to copies of it, one for WAVE queries.
    many = [F.lit(x) for g, n in counts if g is not None for x in (g, -(-n // WAVE))]
    parts = F.coalesce(F.try_element_at(F.create_map(*many), F.col("group")), F.lit(1)) if many else F.lit(1)
    home = mine.where("group is not null").select("group", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"), "id", "v", F.lit(None).cast("double").alias("least"))
    seen = materialize(_tiles(cut.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))), home, groups, k, threshold), "vector-home")
    known = seen.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).select(F.col("query_id").alias("id"), "least")
    least = F.coalesce("least", F.lit(max(threshold, -2.0) if threshold > 0 else -2.0)).alias("least")
    open_ = materialize(mine.join(known, "id", "left").select("id", "v", least).mapInPandas(_reaching(pivots, whole), f"id long, v {told}, least double, groups array<int>"), "vector-open")
    release(mine, seen)
    free_shuffles(spark)
    best, path = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", DIGITS)), "point_id"), scratch_path(spark, "vector-best")
    for wave in range(waves):
        dealt = open_.where(F.pmod(F.xxhash64("id"), F.lit(waves)) == wave).select(F.explode("groups").alias("group"), F.lit(0).alias("part"), "id", "v", "least")
        found = _tiles(cut.withColumn("part", F.lit(0)), dealt, groups, k, threshold)
        found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).write.mode("append").parquet(path)
        del dealt, found
        free_shuffles(spark)
    release(placed, open_)
    return spark.read.schema("query_id long, point_id long, score double, rank int").parquet(path)


def _grouped(whole: list[dict]) -> int:
    """Give each cluster its first group and number of groups, of at most about BLOCK points each; neighbours in the list share one if they fit. Returns the number of groups."""
    at, room, dim = -1, 0, None
    for c in whole:
        c["blocks"] = max(1, -(-c["n"] // BLOCK))
        if c["blocks"] > 1 or c["n"] > room or c["dim"] != dim:
            c["first"] = at + 1
            at, room = at + c["blocks"], BLOCK - c["n"] if c["blocks"] == 1 else 0
        else:
            c["first"], room = at, room - c["n"]
        dim = c["dim"]
    return at + 1


def _unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1, 1))


def _by_dimension(batch: pd.DataFrame, pivots: dict[int, np.ndarray]) -> Iterator[tuple[int, pd.DataFrame, np.ndarray]]:
    for dim, own in batch.groupby(batch["v"].map(len)):
        if dim in pivots:
            yield int(dim), own, _unit(np.stack(own["v"].to_numpy()).astype(np.float64))


def _placed(pivots: dict[int, np.ndarray]):
    """Vectors with their nearest pivot and the angle to it; a vector without length stands alone, at -1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, own, unit in _by_dimension(batch, pivots):
                angle = _angles(unit, pivots[dim])
                near = np.where(unit.any(1), angle.argmin(1), -1)
                yield pd.DataFrame({"id": own["id"].to_numpy(), "v": own["v"].to_numpy(), "dim": dim, "cluster": near, "angle": angle.min(1)})

    return run


def _reaching(pivots: dict[int, np.ndarray], whole: list[dict]):
    """Each query with the groups in which a point may score as much as it knows it has."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, own, unit in _by_dimension(batch, pivots):
                angle, least, reached = _angles(unit, pivots[dim]), own["least"].to_numpy(), [[] for _ in range(len(own))]
                for c in (r for r in whole if r["dim"] == dim):
                    to = angle[:, c["cluster"]]
                    gap = np.maximum(np.maximum(to - c["high"], c["low"] - to), 0)
                    can = (np.cos(gap) >= least - SLACK) | ~unit.any(1) if c["cluster"] >= 0 else np.ones(len(own), bool)
                    for i in np.flatnonzero(can):
                        reached[i] += range(c["first"], c["first"] + c["blocks"])
                yield pd.DataFrame({"id": own["id"].to_numpy(), "v": own["v"].to_numpy(), "least": least, "groups": [sorted(set(x)) for x in reached]})

    return run


def _best(scores: np.ndarray, k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k best scores (rounded to DIGITS) of each row, ties in the order of columns; what is below least (None or NaN: not known) may be left out."""
    n = scores.shape[1]
    if least is None or np.isnan(least).any():
        least = np.partition(scores, n - k, axis=1)[:, n - k] if n > k else np.full(len(scores), -np.inf)
    own, at = np.nonzero(scores >= (least - SLACK)[:, None])
    crowded = np.flatnonzero(np.bincount(own, minlength=len(scores)) > max(4 * k, 64)) if n > k else own[:0]
    if len(crowded):
        # Only k of these are sorted: those above the k-th, and the first of its equals.
        by = np.round(scores[crowded], DIGITS)
        kth = np.partition(by, n - k, axis=1)[:, n - k][:, None]
        above, equal = by > kth, by == kth
        rows, columns = np.nonzero(above | (equal & (np.cumsum(equal, axis=1) <= k - above.sum(1, keepdims=True))))
        rest = ~np.isin(own, crowded)
        own, at = np.concatenate([own[rest], crowded[rows]]), np.concatenate([at[rest], columns])
    order = np.lexsort((at, -np.round(scores[own, at], DIGITS), own))
    own, at = own[order], at[order]
    first = np.arange(len(own)) - np.searchsorted(own, own) < k
    return own[first], at[first]


def _tiles(points: DataFrame, queries: DataFrame, groups: int, k: int, threshold: float) -> DataFrame:
    """(query_id, point_id, score): of every tile (group, part) of points (id, v) and queries (id, v, least) the k best points of each of its queries."""
    keys, tasks = ["group", "part"], min(3 * groups, TASKS)

    def run(stored: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": [], "point_id": [], "score": []}).astype({"query_id": "int64", "point_id": "int64"})
        if stored.empty or asked.empty:
            return none
        stored = stored.sort_values("id")
        ids, matrix, out = stored["id"].to_numpy(), _unit(np.stack(stored["v"].to_numpy()).astype(np.float64)), []
        for start in range(0, len(asked), STEP):
            some = asked.iloc[start : start + STEP]
            scores = _unit(np.stack(some["v"].to_numpy()).astype(np.float64)) @ matrix.T
            own, at = _best(scores, k, some["least"].to_numpy(np.float64, na_value=np.nan))
            out.append(pd.DataFrame({"query_id": some["id"].to_numpy()[own], "point_id": ids[at], "score": scores[own, at]}))
        found = pd.concat(out)
        return found[found["score"] >= threshold] if threshold > 0 else found

    dealt = lambda df: df.repartition(tasks, *keys).groupBy(*keys)
    return dealt(points).cogroup(dealt(queries)).applyInPandas(run, "query_id long, point_id long, score double")


def killed_by_threshold(points: DataFrame, vector: Sequence[float], k: int, threshold: float, column: str = "vector", key: str = "point_id") -> DataFrame:
    """Of the k best points without a threshold, those that the threshold removes."""
    every = search(points, vector, k, 0.0, None, column, (key,))
    kept = search(points, vector, k, threshold, None, column, (key,))
    return every.join(kept.select(key), key, "left_anti")
