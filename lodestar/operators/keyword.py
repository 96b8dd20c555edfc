"""BM25 keyword search over a scan, or over stored postings."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.scores import bm25_gain
from lodestar.functions.text import tags_text, tokenize
from lodestar.operators.filters import apply_filter
from lodestar.plans.scratch import materialize, scratch_path


def searchable(docs: DataFrame, text: str = "text", tags: str | None = None):
    """The text that is searched: the body and, if there are any, the tags."""
    return F.concat_ws(" ", F.col(text), tags_text(F.col(tags))) if tags else F.coalesce(F.col(text), F.lit(""))


def query_terms(docs: DataFrame, query: str) -> dict[str, int]:
    """The query's terms with how often each occurs; a term that occurs twice counts twice."""
    row = docs.sparkSession.range(1).select(tokenize(F.lit(query)).alias("t")).first()
    out: dict[str, int] = {}
    for term in row["t"]:
        out[term] = out.get(term, 0) + 1
    return out


def statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(term, df) and one row (n, mean): documents without terms count in both."""
    lengths = docs.select(key, tokenize(searchable(docs, text)).alias("terms"))
    terms = lengths.select(key, F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return terms, lengths.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("terms")).alias("mean"))


def _listed(terms: dict[str, int]) -> Column:
    return F.array(*(F.lit(t) for t in terms)).cast("array<string>")


def search(docs: DataFrame, query: str, k: int = 10, condition: dict | None = None, key: str = "doc_id", text: str = "text", tags: str | None = None) -> DataFrame:
    """The k best rows (all if k <= 0) with a positive score; statistics are those of the filtered rows.

    Texts are tokenised once: what leaves the scan, and is stored, is every row's
    length and the query's terms in it, without the text. Statistics and scores come
    from there, and the texts of the hits alone are fetched by key (rows of one key
    have one text).
    """
    terms = query_terms(docs, query)
    rows = apply_filter(docs, condition)
    if not terms:
        return rows.limit(0).withColumn("score", F.lit(0.0))
    found = tokenize(searchable(rows, text, tags))
    rest = [c for c in rows.columns if c != text]
    once = rows.select(*rest, F.explode(F.array(F.struct(found.alias("t")))).alias("_x"))
    slim = materialize(once.select(*rest, F.size("_x.t").alias("_dl"), F.filter("_x.t", lambda t: F.array_contains(_listed(terms), t)).alias("_hits")), "keyword")
    n, mean, frequencies = _statistics(slim)
    weights = {t: times * math.log(1 + (n - df + 0.5) / (df + 0.5)) for t, times in terms.items() if (df := frequencies.get(t))}
    if not weights:
        return rows.limit(0).withColumn("score", F.lit(0.0))
    weight = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))

    def gained(term: Column) -> Column:
        tf = F.size(F.filter("_hits", lambda t: t == term))
        return weight[term] * bm25_gain(tf, F.col("_dl"), F.lit(mean))

    # In an order that does not depend on the text.
    score = F.aggregate(F.transform(F.array_sort(F.array_distinct("_hits")), gained), F.lit(0.0), lambda a, x: a + x)
    best = slim.where(F.size("_hits") > 0).select(*rest, score.alias("score")).where("score > 0").orderBy(F.desc("score"), key)
    if k > 0:
        best = best.limit(k)
    if text not in rows.columns:
        return best
    # At most k keys.
    wanted = best.select(key).distinct()
    texts = rows.select(key, text).join(F.broadcast(wanted) if k > 0 else wanted, key, "left_semi").dropDuplicates([key])
    return best.join(texts, key).select(*rows.columns, "score").orderBy(F.desc("score"), key)


def _statistics(slim: DataFrame) -> tuple[int, float, dict[str, int]]:
    """Rows, their mean length and the document frequencies of the query's terms."""
    counted = slim.select(F.explode(F.array_distinct("_hits")).alias("term"))
    sizes = slim.agg(F.count(F.lit(1)).alias("n"), F.avg("_dl").alias("mean")).first()
    frequencies = counted.groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()
    return sizes["n"], float(sizes["mean"] or 1.0), {r["term"]: r["df"] for r in frequencies}


def term_counts(terms: Column) -> Column:
    """An array of (term, tf) of a list of terms: no row of a single occurrence is made or shuffled."""
    begins = lambda t: F.filter(F.sequence(F.lit(1), F.size(t)), lambda i: (i == 1) | (F.get(t, i - 1) != F.get(t, i - 2)))
    runs = lambda x: F.transform(x["at"], lambda i, n: F.struct(F.get(x["t"], i - 1).alias("term"), (F.coalesce(F.get(x["at"], n + 1), F.size(x["t"]) + 1) - i).cast("int").alias("tf")))
    # Arrays of one, so that the sorted terms and their places are computed once.
    one = F.transform(F.array(F.sort_array(terms)), lambda t: F.struct(t.alias("t"), begins(t).alias("at")))
    return F.when(F.size(terms) > 0, F.flatten(F.transform(one, runs)))


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text", tags: str | None = None) -> DataFrame:
    """(key, term, tf, dl), to be stored once and searched often; bucket or sort it by term. Keys are unique; a row's terms are counted where it is read."""
    found = tokenize(searchable(docs, text, tags))
    terms = docs.select(key, F.explode(F.array(F.struct(found.alias("t")))).alias("_x")).select(key, F.size("_x.t").alias("dl"), F.explode(term_counts(F.col("_x.t"))).alias("p"))
    return terms.select(key, "p.term", "dl", "p.tf")


def write_postings(terms: DataFrame, path: str) -> None:
    """Store postings in folders by ``part``, by term within a file. Every task files what it read: nothing is shuffled, and none holds a folder's share of the corpus."""
    terms.sortWithinPartitions("part", "term").write.mode("overwrite").partitionBy("part").parquet(path)


#: Folders that postings are dealt over by their terms, so that a search reads those of its terms.
PARTS = 64


def part_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(PARTS)).cast("int")


@dataclass(frozen=True)
class Index:
    """Stored postings of a table: terms (key, term, tf, dl) in folders by ``part``, sizes (key, dl), and how many rows of which mean length."""

    terms: DataFrame
    sizes: DataFrame
    n: int
    mean: float


_KEPT: dict[tuple, Index] = {}


def _fingerprint(docs: DataFrame) -> tuple:
    """What tells a table from one that was changed meanwhile: its plan, and its files with their lengths and times."""
    spark, files = docs.sparkSession, []
    for name in docs.inputFiles():
        where = spark._jvm.org.apache.hadoop.fs.Path(name)
        status = where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where)
        files.append((name, status.getLen(), status.getModificationTime()))
    return docs.semanticHash(), tuple(sorted(files))


def index(docs: DataFrame, key: str = "doc_id", text: str = "text", tags: str | None = None) -> Index:
    """The index of a table of files, made at the first call in a session and again when a file of the table has changed."""
    spark = docs.sparkSession
    name = (spark.sparkContext.applicationId, key, text, tags, *_fingerprint(docs))
    if name not in _KEPT:
        terms = postings(docs, key, text, tags).withColumn("part", part_of(F.col("term")))
        path = scratch_path(spark, "postings")
        write_postings(terms, path)
        sizes = materialize(docs.select(key, F.size(tokenize(searchable(docs, text, tags))).alias("dl")), "sizes")
        row = sizes.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("mean")).first()
        _KEPT[name] = Index(spark.read.schema(terms.schema).parquet(path), sizes, row["n"], float(row["mean"] or 1.0))
    return _KEPT[name]


def search_keys(docs: DataFrame, query: str, k: int = 10, condition: dict | None = None, key: str = "doc_id", text: str = "text", tags: str | None = None) -> DataFrame:
    """(key, score) of what ``search`` returns, by the table's index: only the folders of the query's terms are read. Keys are unique."""
    own = index(docs, key, text, tags)
    among = own.sizes.join(apply_filter(docs, condition).select(key), key, "left_semi") if condition else None
    return search_postings(own.terms, docs.sparkSession.createDataFrame([(own.n, own.mean)], "n long, mean double"), query, k, key, among)


def search_indexed(docs: DataFrame, query: str, k: int = 10, condition: dict | None = None, key: str = "doc_id", **columns) -> DataFrame:
    """The rows of ``search_keys``."""
    return docs.join(search_keys(docs, query, k, condition, key, **columns), key).orderBy(F.desc("score"), key)


def point_postings(points: DataFrame, tags: str | None = "tags") -> tuple[DataFrame, DataFrame]:
    """(source_key, point_id, term, tf, dl, part) and (source_key, point_id, dl) of the points of a collection."""
    found = tokenize(searchable(points, "text", tags))
    own = points.select("source_key", "point_id", F.explode(F.array(F.struct(found.alias("t")))).alias("x")).select("source_key", "point_id", F.col("x.t").alias("t"))
    terms = own.select("source_key", "point_id", F.size("t").alias("dl"), F.explode(term_counts(F.col("t"))).alias("p"))
    return terms.select("source_key", "point_id", "p.term", "p.tf", "dl", part_of(F.col("p.term")).alias("part")), own.select("source_key", "point_id", F.size("t").alias("dl"))


def search_points(terms: DataFrame, sizes: DataFrame, query: str, k: int = 10, among: DataFrame | None = None) -> DataFrame:
    """(source_key, point_id, score) by a collection's postings and one row of sizes (n, mean); with ``among`` (points) only those count, in statistics too."""
    if among is not None:
        own = among.select("source_key", "point_id", F.size(tokenize(searchable(among, "text", "tags" if "tags" in among.columns else None))).alias("dl"))
        among = own.select(F.struct("source_key", "point_id").alias("_key"), "dl")
    return search_postings(terms.withColumn("_key", F.struct("source_key", "point_id")), sizes, query, k, "_key", among).select("_key.source_key", "_key.point_id", "score")


def search_postings(stored: DataFrame, sizes: DataFrame, query: str, k: int = 10, key: str = "doc_id", among: DataFrame | None = None) -> DataFrame:
    """(key, score) from stored postings and one row of sizes (n, mean); with ``among`` (the key and dl of some rows) only those rows count, in statistics too."""
    terms = query_terms(stored, query)
    if among is not None:
        sizes = among.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("mean"))
    n, mean = sizes.select("n", "mean").first()
    hits = stored.where(F.col("term").isin(list(terms)))
    if "part" in stored.columns and terms:
        parts = stored.sparkSession.range(1).select(F.transform(_listed(terms), part_of).alias("p")).first()["p"]
        hits = hits.where(F.col("part").isin(sorted(set(parts))))
    if among is not None:
        hits = hits.join(among.select(key), key, "left_semi")
    frequencies = {r["term"]: r["df"] for r in hits.groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}
    if not frequencies:
        return stored.limit(0).select(key, F.lit(0.0).alias("score"))
    weights = F.create_map(*(F.lit(x) for t, df in frequencies.items() for x in (t, terms[t] * math.log(1 + (n - df + 0.5) / (df + 0.5)))))
    gain = weights[F.col("term")] * bm25_gain(F.col("tf"), F.col("dl"), F.lit(float(mean or 1.0)))
    out = hits.groupBy(key).agg(F.sum(gain).alias("score")).orderBy(F.desc("score"), key)
    return out.limit(k) if k > 0 else out
