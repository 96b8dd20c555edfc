"""Checks and overviews of collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.scores import cosine
from lodestar.functions.text import collection_number, content_sha
from lodestar.plans.scratch import materialize

COVERAGE, MEDIAN, MILD = 0.7, 0.8, 0.98


def describe_collections(sources: DataFrame, registry: DataFrame) -> DataFrame:
    """Live counts of sources (collection, chunks) beside the registry (name, enabled, ...); names of either side stay."""
    live = sources.groupBy(F.col("collection").alias("name")).agg(F.count(F.lit(1)).alias("sources"), F.sum("chunks").alias("chunks")).withColumn("exists", F.lit(True))
    out = live.join(registry, "name", "full_outer")
    return out.withColumn("exists", F.coalesce("exists", F.lit(False))).withColumn("sources", F.coalesce("sources", F.lit(0).cast("long"))).withColumn("chunks", F.coalesce("chunks", F.lit(0).cast("long"))).withColumn("id", collection_number(F.col("name")))


def resolve_targets(registry: DataFrame, stored: DataFrame) -> DataFrame:
    """Enabled registered names that are stored; all stored ones if there is none."""
    own = registry.where("enabled").select("name").join(stored.select("name"), "name", "left_semi")
    return own if not own.isEmpty() else stored.select("name").distinct()


def verify_structure(catalog: DataFrame, points: DataFrame, dimension: int = 0) -> DataFrame:
    """(collection, kind, source, detail) for a catalog (collection, source_file, chunks, indexed) and points (collection, source_file, vector).

    Kinds: missing_index, bad_index, count_mismatch, dim_mismatch, orphan_dir, empty_source.
    """
    stored = points.groupBy("collection", "source_file").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.size("vector") != dimension, 1)).alias("odd"), F.count(F.when(F.col("vector").isNull(), 1)).alias("broken")
    )
    both = catalog.withColumn("_listed", F.lit(True)).join(stored, ["collection", "source_file"], "full_outer")
    checks = [
        ("orphan_dir", F.col("_listed").isNull(), F.lit("not in the catalog")),
        ("empty_source", F.col("_listed") & (F.col("chunks") == 0), F.lit("no chunks")),
        ("missing_index", F.col("_listed") & (F.col("chunks") > 0) & F.col("n").isNull(), F.lit("no index")),
        ("bad_index", F.col("broken") > 0, F.lit("rows without a vector")),
        ("count_mismatch", F.col("_listed") & (F.col("n") != F.col("chunks")), F.format_string("catalog %d, index %d", F.col("chunks"), F.col("n"))),
        ("dim_mismatch", F.lit(dimension > 0) & (F.col("odd") > 0), F.format_string("%d rows", F.col("odd"))),
    ]
    kinds = F.array_compact(F.array(*(F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(kind).alias("kind"), detail.alias("detail"))) for kind, test, detail in checks)))
    return both.select("collection", F.explode(kinds).alias("x"), "source_file").select("collection", "x.kind", F.col("source_file").alias("source"), "x.detail")


def roll_up(issues: DataFrame, collections: DataFrame) -> DataFrame:
    """(collection, ok, issues) of every collection."""
    counts = issues.groupBy("collection").agg(F.count(F.lit(1)).alias("issues"))
    return collections.select("collection").distinct().join(counts, "collection", "left").select("collection", F.col("issues").isNull().alias("ok"), F.coalesce("issues", F.lit(0).cast("long")).alias("issues"))


def coverage(chunks: DataFrame, stored: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, matched, total, ratio): chunks of the current text whose content is among stored (content_sha); repeats count."""
    known = stored.select("content_sha").distinct().withColumn("_known", F.lit(1))
    rows = chunks.select(key, content_sha(F.col("text")).alias("content_sha")).join(known, "content_sha", "left")
    out = rows.groupBy(key).agg(F.count("_known").alias("matched"), F.count(F.lit(1)).alias("total"))
    return out.withColumn("ratio", F.col("matched") / F.col("total"))


def orphans(stored: DataFrame, wanted: DataFrame, key: str = "content_sha") -> DataFrame:
    return stored.select(key).distinct().join(wanted.select(key), key, "left_anti")


def vector_median(pairs: DataFrame, a: str = "a", b: str = "b", group: str | None = None) -> DataFrame:
    """The upper median of cosines of stored and fresh vectors (a sample), and what it means.

    Scores are dealt to tasks by ranges of (group, score), so no group is gathered: the counts of a group's ranges say which
    range holds the middle, and only the rank within that range is computed.
    """
    name = F.col(group) if group else F.lit(0)
    scores = pairs.select(name.alias("g"), cosine(F.col(a), F.col(b)).alias("s")).withColumn("tie", F.monotonically_increasing_id())
    ranged = materialize(scores.repartitionByRange("g", F.asc_nulls_first("s"), "tie").select("g", "s", F.spark_partition_id().alias("part")), "scores")
    counts = ranged.groupBy("g", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("low", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("samples", F.sum("n").over(Window.partitionBy("g")))
    at = F.floor(F.col("samples") / 2)
    middle = placed.where((F.col("low") <= at) & (at < F.col("low") + F.col("n"))).select(F.col("g").alias("_g"), F.col("part").alias("_part"), (at - F.col("low") + 1).alias("_at"), "samples")
    own = ranged.join(middle, ranged["g"].eqNullSafe(middle["_g"]) & (ranged["part"] == middle["_part"]))
    rank = F.row_number().over(Window.partitionBy("g", "part").orderBy(F.asc_nulls_first("s")))
    out = own.withColumn("_n", rank).where("_n = _at")
    return out.select(*([F.col("g").alias(group)] if group else []), "samples", F.col("s").alias("median"), band(F.col("s")).alias("band"))


def sampled_counts(rows: DataFrame, status: str, key: str, limit: int, detail: str | None = None) -> DataFrame:
    """(status, n, samples): how many rows have each status and the first ``limit`` of them by key. No group is held beyond that many."""
    first = Window.partitionBy(status).orderBy(key)
    kept = rows.select(status, key, *([detail] if detail else [])).withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= limit)
    one = F.struct("_n", F.struct(key, detail).alias("x") if detail else F.col(key).alias("x"))
    samples = kept.groupBy(F.col(status).alias("_s")).agg(F.transform(F.sort_array(F.collect_list(one)), lambda r: r["x"]).alias("samples"))
    counts = rows.groupBy(status).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(samples, counts[status].eqNullSafe(samples["_s"])).select(status, "n", "samples")


def band(median: Column) -> Column:
    return F.when(median < MEDIAN, "drift").when(median < MILD, "mild").otherwise("same")


def check_provenance(declared: dict, observed: dict) -> None:
    """Raise if model, provider, dimension or distance differ; what is unknown on either side passes, case does not count."""
    odd = [f"{k}: {declared[k]} / {observed[k]}" for k in ("embed_model", "embed_provider", "vector_dim", "vector_distance") if declared.get(k) and observed.get(k) and str(declared[k]).lower() != str(observed[k]).lower()]
    if odd:
        raise ValueError("the collection was made otherwise: " + "; ".join(odd))


def claimed_and_loaded(catalog: DataFrame, points: DataFrame) -> DataFrame:
    """One row: chunks by the catalog, and rows there are; an index that claims rows and holds none is broken."""
    claimed = catalog.agg(F.coalesce(F.sum("chunks"), F.lit(0).cast("long")).alias("claimed"))
    loaded = points.agg(F.count(F.lit(1)).alias("loaded"))
    return claimed.withColumn("_k", F.lit(1)).join(loaded.withColumn("_k", F.lit(1)), "_k").select("claimed", "loaded", ((F.col("claimed") > 0) & (F.col("loaded") == 0)).alias("broken"))


def prune_sources(catalog: DataFrame) -> DataFrame:
    """The catalog without sources that hold no chunks."""
    return catalog.where(F.coalesce("chunks", F.lit(0)) > 0)


def missing_collections(manifests: DataFrame, registry: DataFrame) -> DataFrame:
    """Manifests (name, ...) of collections that the registry does not know, to be registered."""
    return manifests.join(registry.select("name"), "name", "left_anti")


def backfill(points: DataFrame, source: str, indexed_at: str) -> DataFrame:
    """Give every row the source and the time of its collection."""
    return points.withColumn("source_file", F.lit(source)).withColumn("indexed_at", F.lit(indexed_at).cast("timestamp"))
