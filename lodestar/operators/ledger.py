"""The append-only ledger of filed documents, and what keeps it in step with the files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions.dates import ledger_month
from lodestar.functions.text import trim_space
from lodestar.operators.maintain import sampled_counts
from lodestar.plans.scratch import delete_path, materialize, release

# The fields of an entry.
ENTRY = (
    "path string, id string, channel string, category string, title string, url string, urls array<string>, sha256 string, raw_sha256 string, provider string, "
    "published_at string, fetched_at string, updated_at string, bytes bigint, collection string, tags array<string>"
)
WINDOW_DAYS, WINDOW_ROWS = 30, 200_000


def read(spark: SparkSession, path: str) -> DataFrame:
    """All entries of JSON lines; malformed lines and lines without path and hash are skipped."""
    rows = spark.read.schema(ENTRY).option("mode", "DROPMALFORMED").json(path)
    return rows.where(F.coalesce(F.nullif("path", F.lit("")), F.nullif("sha256", F.lit(""))).isNotNull())


def append(entries: DataFrame, path: str) -> None:
    """Append, one folder a month of the document; entries made in another month stand in a folder of both, month_made."""
    stamp = F.col("updated_at").try_cast("timestamp")
    month, made = ledger_month(F.col("path"), stamp), ledger_month(F.lit(""), stamp)
    folder = F.when(month == made, month).otherwise(F.concat_ws("_", month, made))
    entries.withColumn("month", folder).write.mode("append").partitionBy("month").json(path)


def read_window(spark: SparkSession, path: str, now, days: int = WINDOW_DAYS, rows: int = WINDOW_ROWS) -> DataFrame:
    """``window`` of the entries of a ledger; only folders of months that it touches are read. Entries without a time are in none."""
    first = spark.range(1).select(F.date_format(F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days)), "yyyy-MM").alias("m")).first()["m"]
    made = F.right("month", F.lit(7))
    recent = read(spark, path).where((made >= first) & (made != "unknown"))
    return window(recent.withColumn("_at", F.col("updated_at").try_cast("timestamp")), now, days, rows, "_at", ("path",)).drop("_at", "month")


def candidates(name: Column, roots: Sequence[str]) -> Column:
    """Where a file may be: at its name as it is, and below each of the roots (of which a name may already hold the path)."""
    name = F.regexp_replace(name, r"^\./", "")
    below = [F.when(~name.startswith("/"), F.concat(F.lit(root.rstrip("/") + "/"), name)) for root in roots]
    inside = [F.when(name.startswith(root.rstrip("/") + "/"), F.substring(name, len(root.rstrip("/")) + 2, 1 << 30)) for root in roots]
    return F.array_distinct(F.array_compact(F.array(name, *below, *inside)))


def with_file(entries: DataFrame, files: DataFrame, key: str = "path", roots: Sequence[str] = ()) -> DataFrame:
    """Entries one of whose candidate keys is among files (key)."""
    names = entries.select(key).distinct().withColumn("_at", F.explode(candidates(F.col(key), roots)))
    found = names.join(files.select(F.col(key).alias("_at")).distinct(), "_at", "left_semi").select(key).distinct()
    return entries.join(found, key, "left_semi")


def prune_files(spark: SparkSession, path: str, files: DataFrame, roots: Sequence[str] = (), dry_run: bool = False) -> int:
    """Take the entries whose file is gone out of a ledger; returns how many. Only the folders that hold such entries are written again."""
    entries = read(spark, path)
    there = with_file(entries, files, "path", roots).select("path").distinct()
    gone = materialize(entries.join(there, "path", "left_anti").select("month"), "ledger-gone")
    n = gone.count()
    if n and not dry_run:
        touched = materialize(gone.distinct(), "ledger-touched")
        stay = materialize(entries.join(touched, "month", "left_semi").join(there, "path", "left_semi"), "ledger-stay")
        stay.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").json(path)
        # As many as there are months.
        for r in touched.join(stay.select("month").distinct(), "month", "left_anti").collect():
            delete_path(spark, f"{path}/month={r['month']}")
        release(touched, stay)
    release(gone)
    return n


def verify_report(ledger: DataFrame, files: DataFrame, key: str = "path", limit: int = 50) -> DataFrame:
    """(kind, n, samples, note): how many entries and files are alone, the first of them, and how many more there are."""
    out = sampled_counts(verify(ledger, files, key), "kind", key, limit)
    return out.withColumn("note", F.when(F.col("n") > limit, F.format_string("%d more", F.col("n") - limit)).otherwise(""))


def current(entries: DataFrame, key: str = "sha256", order: tuple[str, ...] = ("updated_at",)) -> DataFrame:
    """The newest entry of every key."""
    newest = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return entries.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def window(entries: DataFrame, now, days: int = WINDOW_DAYS, rows: int = WINDOW_ROWS, stamp: str = "updated_at", ties: tuple[str, ...] = ()) -> DataFrame:
    """Entries of the last days, at most so many of the newest."""
    recent = entries.where(F.col(stamp) >= F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days)))
    return recent.orderBy(F.desc(stamp), *(F.desc(c) for c in ties)).limit(rows)


def verify(ledger: DataFrame, files: DataFrame, key: str = "path") -> DataFrame:
    """(kind, key): entries without a file and files without an entry."""
    missing = ledger.select(key).distinct().join(files.select(key), key, "left_anti").select(F.lit("missing_file").alias("kind"), key)
    unlisted = files.select(key).distinct().join(ledger.select(key), key, "left_anti").select(F.lit("unlisted_file").alias("kind"), key)
    return missing.unionByName(unlisted)


def pruned(ledger: DataFrame, files: DataFrame, key: str = "path") -> DataFrame:
    """Entries whose file is still there; the order and all older rows stay."""
    return ledger.join(files.select(key).distinct(), key, "left_semi")


def repaired(sources: DataFrame, ledger: DataFrame) -> DataFrame:
    """(source_file, found, how) for sources (source_file, sha256): by body hash, by raw hash, else by the id in the file name.

    Ids are short, so several documents may have one; then the entry whose file has the source's name is meant, and the
    first by path if there is none.
    """
    newest = current(ledger)
    by_sha = newest.where("sha256 <> ''").select(F.col("sha256").alias("_sha"), F.col("path").alias("_by_sha"))
    by_raw = newest.where("raw_sha256 <> ''").groupBy(F.col("raw_sha256").alias("_raw")).agg(F.min("path").alias("_by_raw"))
    named = newest.where("id <> ''")
    by_id = named.groupBy(F.col("id").alias("_id")).agg(F.min("path").alias("_by_id"), F.count(F.lit(1)).alias("_ids"))
    by_file = named.groupBy(F.col("id").alias("_of"), _file_name(F.col("path").cast("string")).alias("_same")).agg(F.min("path").alias("_by_file"))
    # Empty hashes and names without an id match nothing and are no join keys.
    rows = sources.withColumn("_file", _file_name(F.col("source_file"))).withColumn("_name", F.nullif(F.regexp_extract("_file", r"\d{6}-([0-9a-f]{8})-", 1), F.lit(""))).withColumn("sha256", F.nullif("sha256", F.lit("")))
    out = rows.join(by_sha, rows["sha256"] == by_sha["_sha"], "left").join(by_raw, rows["sha256"] == by_raw["_raw"], "left").join(by_id, F.col("_name") == by_id["_id"], "left")
    out = out.join(by_file, (F.when(F.col("_ids") > 1, F.col("_name")) == by_file["_of"]) & (F.col("_file") == by_file["_same"]), "left")
    how = F.when(F.col("_by_sha").isNotNull(), "sha256").when(F.col("_by_raw").isNotNull(), "raw_sha256").when(F.col("_by_id").isNotNull(), "id")
    return out.select("source_file", F.coalesce("_by_sha", "_by_raw", "_by_file", "_by_id").alias("found"), how.alias("how"))


def _file_name(path: Column) -> Column:
    """What follows the last slash."""
    return F.substring_index(path, "/", -1)


_HEAD = r"^# ([^\n]*)\n"


def parse_legacy(docs: DataFrame, text: str = "text") -> DataFrame:
    """Title, source, provider, fetched_at and body of the old layout: a heading, "- name: value" lines, then the body."""
    block = r"\A(?:# [^\n]*\n)?\s*(?:- (?:source|provider|fetched_at):[^\n]*\n)*\s*"
    body = F.regexp_replace(text, block, "")
    head = F.substring(F.col(text), F.lit(1), F.char_length(text) - F.char_length(body))
    fields = {c: F.trim(F.regexp_extract(head, rf"(?m)^- {c}:([^\n]*)$", 1)).alias(c) for c in ("source", "provider", "fetched_at")}
    return docs.select(*(c for c in docs.columns if c != text), F.trim(F.regexp_extract(head, _HEAD, 1)).alias("title"), *fields.values(), body.alias("body"))


def history_for(history: DataFrame, file: str) -> DataFrame:
    """Oldest first."""
    return history.where(F.col("file") == file).orderBy("ts", "op")


def recent_uploads(history: DataFrame, limit: int = 50) -> DataFrame:
    """Newest first."""
    return history.where("op = 'upload'").orderBy(F.desc("ts"), "file").limit(limit)


def migrated(legacy: DataFrame, channel: str = "web") -> tuple[DataFrame, DataFrame]:
    """Documents of the old folders (path, text) as entries with bodies, and the moves (old, new) of their paths.

    The day is that of fetched_at; a document without one keeps the day of 1970-01-01.
    """
    from lodestar.functions.dates import parse_date
    from lodestar.operators.vault import NO_CATEGORY, vault_path

    rows = parse_legacy(legacy).withColumn("body", trim_space(F.col("body"))).where("body <> ''")
    stamp = F.coalesce(parse_date(F.col("fetched_at")), F.lit("1970-01-01").cast("timestamp"))
    full = rows.withColumn("sha256", F.sha2("body", 256)).withColumn("stamp", stamp)
    named = full.withColumn("new", vault_path(F.col("stamp"), F.lit(channel), F.lit(NO_CATEGORY), F.col("sha256"), F.col("title"), F.col("source"), F.lit(".md")))
    entries = named.select(F.col("new").alias("path"), F.substring("sha256", 1, 8).alias("id"), F.lit(channel).alias("channel"), "title", F.col("source").alias("url"), "provider", "sha256", "fetched_at", "body")
    # Of one body's documents the first by path is the entry.
    first = Window.partitionBy("sha256").orderBy(F.asc_nulls_last("path"), "url", "provider", "fetched_at")
    return entries.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n"), named.select(F.col("path").alias("old"), "new")
