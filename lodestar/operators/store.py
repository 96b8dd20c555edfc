"""Collections of points as segments of Parquet, merged when they are read.

A change writes one segment: the rows it adds or changes, and the keys it takes
away. What it leaves alone is neither read for it nor written again. A segment
hides the rows of its keys in all older segments, so a collection is read as the
rows of its segments less those whose key a later segment has: an anti-join with
keys alone. A version is a small file in the collection's log that lists its
segments; it is made only if no other has made that version meanwhile, so readers
never see half a change and of two writers one is told. Beside the rows of a
segment stand its share of the catalog (chunks by source: what it adds less what
it hides) and, once they are asked for, its postings, which no later change
touches. When a collection has MOST_SEGMENTS, a change merges them into one.
"""

from __future__ import annotations

import functools
import json
import re
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.functions.scores import norm
from lodestar.operators.filters import compile_filter
from lodestar.plans.scratch import materialize, release

# The fields of a stored point.
POINTS = (
    "collection string, source_key string, source_file string, source string, source_rel string, point_id string, content_sha string, hash bigint, "
    "chunk_index int, text string, indexed_at timestamp, metadata map<string,string>, tags array<string>, tags_expanded array<string>, vector array<float>, norm double"
)
#: Keys of a table, by the columns it has; segments of a collection before they are merged.
KEYS = (("source_key", "point_id"), ("sha256",))
MOST_SEGMENTS = 24
_SOURCE = ("collection", "source_file")
_NAME = re.compile(r"^[A-Za-z0-9][A-Za-z0-9_-]{0,63}$")


def check_name(name: str) -> str:
    if not _NAME.match(name):
        raise ValueError(f"not a collection name: {name!r}")
    return name


def upserted(existing: DataFrame, incoming: DataFrame, keys: tuple[str, ...] = ("source_key", "point_id")) -> DataFrame:
    """Rows of both; of equal keys the incoming one, and of those the last chunk."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.select(*existing.columns).withColumn("_new", F.lit(1)))
    order = [F.desc("_new")] + ([F.desc("chunk_index")] if "chunk_index" in existing.columns else [])
    return both.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n", "_new")


def with_norm(rows: DataFrame) -> DataFrame:
    return rows.withColumn("norm", F.coalesce("norm", norm(F.col("vector")))) if {"norm", "vector"} <= set(rows.columns) else rows


def deleted(existing: DataFrame, predicate: Column) -> DataFrame:
    return existing.where(~F.coalesce(predicate, F.lit(False)))


def payload_set(existing: DataFrame, predicate: Column, values: dict[str, str], column: str = "metadata") -> DataFrame:
    """Set metadata fields, or own columns, of the rows that match."""
    hit = F.coalesce(predicate, F.lit(False))
    own = {k: v for k, v in values.items() if k in existing.columns}
    rest = {k: str(v) for k, v in values.items() if k not in own}
    out = existing
    if rest:
        added = F.create_map(*(F.lit(x) for pair in rest.items() for x in pair))
        merged = F.map_concat(F.map_filter(F.coalesce(column, F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(list(rest))), added)
        out = out.withColumn(column, F.when(hit, merged).otherwise(F.col(column)))
    return out.withColumns({k: F.when(hit, F.lit(v).cast(existing.schema[k].dataType)).otherwise(F.col(k)) for k, v in own.items()}) if own else out


def renamed(existing: DataFrame, moves: DataFrame, column: str = "source_file") -> DataFrame:
    """Rows whose source is in moves (old, new) get the new one."""
    pairs = moves.groupBy("old").agg(F.min("new").alias("_to")).withColumnRenamed("old", "_from")
    return existing.join(pairs, existing[column] == pairs["_from"], "left").withColumn(column, F.coalesce("_to", column)).drop("_from", "_to").select(*existing.columns)


def source_counts(points: DataFrame) -> DataFrame:
    return points.groupBy("collection", "source_file").agg(F.count(F.lit(1)).alias("chunks"))


def distinct_shas(points: DataFrame) -> DataFrame:
    from lodestar.functions.text import content_sha

    return points.select(F.coalesce("content_sha", content_sha(F.col("text"))).alias("content_sha")).distinct()


def tag_tree(points: DataFrame, tags: str = "tags_expanded") -> DataFrame:
    """How many rows stand under each tag of the tree."""
    return points.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def sample_texts(points: DataFrame, n: int) -> DataFrame:
    return points.where(F.size("vector") > 0).orderBy("point_id").limit(n).select("point_id", "text", "vector")


@dataclass
class Store:
    """Collections under one root, on any file system that Spark reaches."""

    spark: SparkSession
    root: str

    # Files

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _read_text(self, path: str) -> str | None:
        fs, where = self._fs(path)
        if not fs.exists(where):
            return None
        stream = fs.open(where)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _write_aside(self, path: str, text: str):
        fs, aside = self._fs(f"{path}.{uuid.uuid4().hex[:8]}")
        stream = fs.create(aside, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        return aside

    def _write_text(self, path: str, text: str) -> None:
        """Write beside the target and move it there."""
        fs, where = self._fs(path)
        aside = self._write_aside(path, text)
        if not fs.rename(aside, where):
            fs.delete(where, False)
            if not fs.rename(aside, where):
                raise OSError(f"cannot replace {path}")

    def _write_new(self, path: str, text: str) -> bool:
        """Make a file that is not there yet, whole and in one step; False if it is there.

        A rename does not replace a file on HDFS; on a local disk, where it does, a hard link is made instead.
        """
        fs, where = self._fs(path)
        aside = self._write_aside(path, text)
        try:
            if fs.getScheme() != "file":
                return not fs.exists(where) and fs.rename(aside, where)
            java = self.spark._jvm.java
            local = lambda p: java.io.File(p.toUri().getPath()).toPath()
            if fs.exists(where):
                return False
            java.nio.file.Files.createLink(local(where), local(aside))
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise
        finally:
            fs.delete(aside, False)

    def _folder(self, name: str) -> str:
        return f"{self.root}/{check_name(name)}"

    def _list(self, path: str) -> list[str]:
        fs, where = self._fs(path)
        return [p.getPath().getName() for p in fs.listStatus(where)] if fs.exists(where) else []

    # Versions

    def current(self, name: str) -> str:
        """The number of the current version; empty if there is none."""
        return max((n.removesuffix(".json") for n in self._list(f"{self._folder(name)}/log") if re.fullmatch(r"\d{12}\.json", n)), default="")

    def entry(self, name: str) -> dict:
        """The current version: its schema, keys, number of rows and segments (name, seq, rows, gone, covers)."""
        version = self.current(name)
        if not version:
            close = [n for n in self.names() if n.lower() == name.lower()][:3]
            raise KeyError(f"no collection {name!r}" + (f"; did you mean {', '.join(close)}?" if close else ""))
        return json.loads(self._read_text(f"{self._folder(name)}/log/{version}.json")) | {"version": version}

    def _commit(self, name: str, base: str, entry: dict) -> None:
        entry = {k: v for k, v in entry.items() if k != "version"}
        if self.current(name) != base or not self._write_new(f"{self._folder(name)}/log/{int(base or 0) + 1:012d}.json", json.dumps(entry)):
            fs, where = self._fs(f"{self._folder(name)}/{entry['segments'][-1]['name']}")
            fs.delete(where, True)
            raise RuntimeError(f"collection {name!r} was changed meanwhile")

    def exists(self, name: str) -> bool:
        return bool(self.current(name))

    def names(self) -> list[str]:
        return sorted(n for n in self._list(self.root) if _NAME.match(n) and self.exists(n))

    def create(self, name: str, schema: T.StructType | str = POINTS) -> None:
        """An empty collection; nothing happens if there is one."""
        if not self.exists(name):
            self.replace(name, self.spark.createDataFrame([], schema))

    # Reading

    def _stored(self, name: str, segments: list[dict], what: str, schema: T.StructType) -> DataFrame:
        """A table of each of the segments, in one scan."""
        schema = T.StructType([*schema.fields, T.StructField("_seq", T.LongType())])
        paths = [f"{self._folder(name)}/{s['name']}/{what}" for s in segments]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _hidden(self, name: str, entry: dict) -> DataFrame | None:
        """(keys, _hidden): the last segment that has a key or takes it away; None if no segment hides anything."""
        keys = T.StructType([f for f in T.StructType.fromJson(entry["schema"]).fields if f.name in entry["keys"]])
        later = entry["segments"][1:]
        covers, gone = [s for s in later if s["covers"]], [s for s in later if s["gone"]]
        if not covers and not gone:
            return None
        both = self._stored(name, covers, "rows", keys).unionByName(self._stored(name, gone, "gone", keys))
        return both.groupBy(*entry["keys"]).agg(F.max("_seq").alias("_hidden"))

    def _live(self, name: str, entry: dict, rows: DataFrame) -> DataFrame:
        """Rows (with keys and _seq) that no later segment hides."""
        hidden = self._hidden(name, entry)
        if hidden is None:
            return rows.drop("_seq")
        hidden = hidden.select(*(F.col(k).alias(f"_k_{k}") for k in entry["keys"]), "_hidden")
        same = [rows[k].eqNullSafe(hidden[f"_k_{k}"]) for k in entry["keys"]]
        joined = rows.join(hidden, functools.reduce(Column.__and__, same), "left")
        return joined.where(F.col("_hidden").isNull() | (F.col("_seq") >= F.col("_hidden"))).select(*(c for c in rows.columns if c != "_seq"))

    def _read(self, name: str, entry: dict, columns: Sequence[str] = ()) -> DataFrame:
        schema = T.StructType.fromJson(entry["schema"])
        wanted = T.StructType([f for f in schema.fields if not columns or f.name in columns or f.name in entry["keys"]])
        return self._live(name, entry, self._stored(name, [s for s in entry["segments"] if s["rows"]], "rows", wanted))

    def read(self, name: str) -> DataFrame:
        return self._read(name, self.entry(name))

    def read_many(self, names: Sequence[str]) -> DataFrame:
        """The rows of several collections of one schema, told apart by their column ``collection``, in one scan."""
        entries = {n: self.entry(n) for n in names}
        first = next(iter(entries.values()))
        if any(e["schema"] != first["schema"] or e["keys"] != first["keys"] for e in entries.values()):
            raise ValueError("the collections have different columns")
        schema, keys = T.StructType.fromJson(first["schema"]), first["keys"]
        numbered = T.StructType([*schema.fields, T.StructField("_seq", T.LongType())])
        scan = lambda test: self.spark.read.schema(numbered).parquet(*(f"{self._folder(n)}/{s['name']}/rows" for n, e in entries.items() for i, s in enumerate(e["segments"]) if test(i, s)))
        if not any(s["rows"] for e in entries.values() for s in e["segments"]):
            return self.spark.createDataFrame([], schema)
        rows, hides = scan(lambda i, s: s["rows"]), []
        if any(s["covers"] for e in entries.values() for s in e["segments"][1:]):
            hides.append(scan(lambda i, s: i and s["covers"]).select("collection", *keys, "_seq"))
        short = T.StructType([f for f in schema.fields if f.name in keys])
        for n, e in entries.items():
            if gone := [s for s in e["segments"][1:] if s["gone"]]:
                hides.append(self._stored(n, gone, "gone", short).select(F.lit(n).alias("collection"), *keys, "_seq"))
        if not hides:
            return rows.drop("_seq")
        names_ = ["collection", *keys]
        hidden = functools.reduce(DataFrame.unionByName, hides).groupBy(*names_).agg(F.max("_seq").alias("_hidden")).select(*(F.col(k).alias(f"_k_{k}") for k in names_), "_hidden")
        joined = rows.join(hidden, functools.reduce(Column.__and__, (rows[k].eqNullSafe(hidden[f"_k_{k}"]) for k in names_)), "left")
        return joined.where(F.col("_hidden").isNull() | (F.col("_seq") >= F.col("_hidden"))).select(*schema.names)

    def catalog(self, name: str) -> DataFrame:
        """(collection, source_file, chunks) as counted when the segments were written."""
        shares = self._stored(name, self.entry(name)["segments"], "catalog", T.StructType().add("collection", "string").add("source_file", "string").add("chunks", "long"))
        return shares.groupBy(*_SOURCE).agg(F.sum("chunks").alias("chunks")).where("chunks > 0")

    # Writing

    def _segment(self, name: str, entry: dict, rows: DataFrame | None, gone: DataFrame | None) -> dict:
        """Write the tables of a segment that follows a version; returns how it is listed, with the rows it adds and hides."""
        made = {"name": f"s-{uuid.uuid4().hex}", "seq": int(entry["version"] or 0) + 1, "rows": 0, "gone": gone is not None, "covers": bool(entry["keys"]) and bool(entry["segments"])}
        path, schema = f"{self._folder(name)}/{made['name']}", T.StructType.fromJson(entry["schema"])
        numbered = lambda df: df.withColumn("_seq", F.lit(made["seq"]).cast("long"))
        source = [c for c in _SOURCE if c in schema.names]
        counted = lambda df, sign: df.groupBy(*source).agg((sign * F.count(F.lit(1))).alias("chunks")).select(*(F.col(c).cast("string") if c in source else F.lit(None).cast("string").alias(c) for c in _SOURCE), "chunks")
        shares, hidden = [], []
        if rows is not None:
            numbered(rows.select(*schema.names)).write.parquet(f"{path}/rows")
            stored = self._stored(name, [made], "rows", schema)
            shares.append(counted(stored, 1))
            hidden.append(stored.select(*entry["keys"]))
        if gone is not None:
            numbered(gone.select(*entry["keys"]).distinct()).write.parquet(f"{path}/gone")
            keys = T.StructType([f for f in schema.fields if f.name in entry["keys"]])
            hidden.append(self._stored(name, [made], "gone", keys).select(*entry["keys"]))
        if made["covers"]:
            touched = functools.reduce(DataFrame.unionByName, hidden).distinct()
            shares.append(counted(self._of(self._read(name, entry, _SOURCE), touched, entry["keys"]), -1))
        share = numbered(functools.reduce(DataFrame.unionByName, shares).withColumn("added", F.col("chunks") > 0))
        share.write.parquet(f"{path}/catalog")
        made["added"], made["hid"] = (int(x or 0) for x in self.spark.read.parquet(f"{path}/catalog").agg(F.sum(F.greatest("chunks", F.lit(0))), F.sum(F.greatest(-F.col("chunks"), F.lit(0)))).first())
        # A segment without rows hides by its table of keys alone.
        made |= {"rows": made["added"], "covers": made["covers"] and made["added"] > 0}
        return made

    @staticmethod
    def _of(rows: DataFrame, keys: DataFrame, names: Sequence[str]) -> DataFrame:
        """The rows of these keys."""
        keys = keys.select(*(F.col(k).alias(f"_k_{k}") for k in names))
        return rows.join(keys, functools.reduce(Column.__and__, (rows[k].eqNullSafe(keys[f"_k_{k}"]) for k in names)), "left_semi")

    def replace(self, name: str, rows: DataFrame, made_from: str | None = None) -> None:
        """Make rows the collection; an error if it is no longer the version that they were made from."""
        base = self.current(name) if made_from is None else made_from
        keys = next((list(k) for k in KEYS if {*k} <= {*rows.columns}), [])
        entry = {"schema": json.loads(rows.schema.json()), "keys": keys, "segments": [], "version": base}
        made = self._segment(name, entry, rows, None)
        self._commit(name, base, entry | {"segments": [made], "count": made["added"]})

    def change(self, name: str, rows: DataFrame | None, gone: DataFrame | None = None, entry: dict | None = None, commit: bool = True) -> dict:
        """Add rows in place of those of their keys, and take away the rows of the keys in gone; returns what was added and hidden.

        An error if the collection is no longer the version ``entry`` that the change was made from. With ``commit`` False the
        segment is written but is in no version yet: what is returned is to be given to ``finish``.
        """
        entry = entry or self.entry(name)
        if not entry["keys"]:
            raise ValueError(f"collection {name!r} has no keys to change rows by")
        made = self._segment(name, entry, rows, gone)
        count = entry["count"] + made["added"] - made["hid"]
        if not commit:
            following = {k: v for k, v in entry.items() if k != "version"} | {"segments": [*entry["segments"], made], "count": count}
            return made | {"collection": name, "base": entry["version"], "entry": following}
        self._commit(name, entry["version"], entry | {"segments": [*entry["segments"], made], "count": count})
        if len(entry["segments"]) + 1 >= MOST_SEGMENTS:
            self.compact(name)
        return made

    def finish(self, prepared: dict) -> None:
        """Make the version of a prepared change; nothing happens if it is there already, an error if another one is."""
        path, text = f"{self._folder(prepared['collection'])}/log/{int(prepared['base'] or 0) + 1:012d}.json", json.dumps(prepared["entry"])
        if not self._write_new(path, text) and self._read_text(path) != text:
            raise RuntimeError(f"collection {prepared['collection']!r} was changed meanwhile")

    def compact(self, name: str) -> None:
        """Merge all segments into one."""
        entry = self.entry(name)
        if len(entry["segments"]) > 1:
            self.replace(name, self._read(name, entry), entry["version"])

    def upsert(self, name: str, rows: DataFrame, gone: DataFrame | None = None, entry: dict | None = None) -> dict:
        """Rows take the place of stored ones of their keys and of the keys in gone; of equal keys among them the last chunk stays."""
        self.create(name, rows.schema)
        entry = entry or self.entry(name)
        order = [F.desc("chunk_index")] if "chunk_index" in rows.columns else [F.lit(1)]
        newest = Window.partitionBy(*entry["keys"]).orderBy(*order)
        once = with_norm(rows).withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")
        return self.change(name, once, gone, entry)

    def _rewrite(self, name: str, entry: dict, matching: DataFrame, change: Callable[[DataFrame], DataFrame], commit: bool = True) -> dict:
        """Put what ``change`` makes of all rows of the matching rows' keys in their place."""
        keys = materialize(matching.select(*entry["keys"]).distinct(), "touched")
        made = self.change(name, change(self._of(self._read(name, entry), keys, entry["keys"])), keys, entry, commit)
        release(keys)
        return made

    def delete(self, name: str, condition: dict | None, allow_all: bool = False) -> int:
        """Delete matching rows and return how many; an empty filter needs allow_all."""
        if not condition and not allow_all:
            raise ValueError("an empty filter would delete all rows; pass allow_all=True")
        entry = self.entry(name)
        rows = self._read(name, entry)
        hit = compile_filter(rows.schema, condition)
        made = self._rewrite(name, entry, rows.where(hit), lambda df: deleted(df, hit))
        return made["hid"] - made["added"]

    def set_payload(self, name: str, values: dict[str, str], condition: dict | None) -> None:
        self.set_where(name, compile_filter(T.StructType.fromJson(self.entry(name)["schema"]), condition), values)

    def touch_source(self, name: str, source: str, values: dict[str, str]) -> None:
        self.set_where(name, F.col("source_file") == source, values)

    def set_where(self, name: str, hit: Column, values: dict[str, str]) -> int:
        """Set fields of the rows that match; returns the rows of their keys."""
        entry = self.entry(name)
        return self._rewrite(name, entry, self._read(name, entry).where(hit), lambda df: payload_set(df, hit, values))["added"]

    def rename_sources(self, name: str, moves: dict[str, str] | DataFrame, column: str = "source_file", commit: bool = True) -> dict:
        entry = self.entry(name)
        table = moves if isinstance(moves, DataFrame) else self.spark.createDataFrame(list(moves.items()), "old string, new string")
        moved = self._read(name, entry).join(table.select(F.col("old").alias(column)).distinct(), column, "left_semi")
        return self._rewrite(name, entry, moved, lambda df: renamed(df, table, column), commit)

    # Searching and looking up

    def postings(self, name: str, tags: str | None = "tags") -> tuple[DataFrame, DataFrame]:
        """(source_key, point_id, term, tf, dl, part) and one row (n, mean) of the current version.

        Every segment's postings are made at the first call and stay as they are, in folders by a hash of the term; so is its
        share of the statistics, of which the rows it hides are taken away.
        """
        from lodestar.operators.keyword import point_postings, write_postings

        entry, kind = self.entry(name), f"{tags or 'text'}"
        keys = T.StructType([f for f in T.StructType.fromJson(entry["schema"]).fields if f.name in entry["keys"]])
        n = total = 0
        with_rows = [s for s in entry["segments"] if s["rows"]]
        for i, made in enumerate(entry["segments"]):
            path = f"{self._folder(name)}/{made['name']}"
            stats = self._read_text(f"{path}/stats-{kind}.json")
            if stats is None:
                own = {"n": 0, "total": 0}
                if made["rows"]:
                    rows = self._stored(name, [made], "rows", T.StructType.fromJson(entry["schema"]))
                    terms, sizes = point_postings(rows, tags)
                    write_postings(terms.withColumn("_seq", F.lit(made["seq"]).cast("long")), f"{path}/terms-{kind}")
                    sizes.withColumn("_seq", F.lit(made["seq"]).cast("long")).write.mode("overwrite").parquet(f"{path}/sizes-{kind}")
                    own = self.spark.read.parquet(f"{path}/sizes-{kind}").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total")).first().asDict()
                before = entry | {"segments": entry["segments"][:i]}
                if made["hid"]:
                    # With only this segment behind the first, its own keys are what is hidden.
                    touched = self._hidden(name, entry | {"segments": [entry["segments"][0], made]})
                    sizes = self._live(name, before, self._stored(name, [s for s in before["segments"] if s["rows"]], f"sizes-{kind}", T.StructType([*keys.fields, T.StructField("dl", T.IntegerType())])))
                    hid = self._of(sizes, touched, entry["keys"]).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total")).first()
                    own = {"n": own["n"] - hid["n"], "total": own["total"] - hid["total"]}
                stats = json.dumps(own)
                self._write_text(f"{path}/stats-{kind}.json", stats)
            n, total = n + json.loads(stats)["n"], total + json.loads(stats)["total"]
        schema = T.StructType([*keys.fields, *T.StructType.fromDDL("term string, tf int, dl int, _seq long, part int").fields])
        each = [self.spark.read.schema(schema).parquet(f"{self._folder(name)}/{s['name']}/terms-{kind}") for s in with_rows]
        terms = functools.reduce(DataFrame.unionByName, each) if each else self.spark.createDataFrame([], schema)
        return self._live(name, entry, terms), self.spark.createDataFrame([(n, total / n if n else 0.0)], "n long, mean double")

    def count(self, name: str, condition: dict | None = None) -> int:
        if not condition:
            return self.entry(name)["count"]
        rows = self.read(name)
        return rows.where(compile_filter(rows.schema, condition)).count()

    def get(self, name: str, identity: str) -> DataFrame:
        rows = self.read(name)
        return rows.where(compile_filter(rows.schema, {"ids": [identity]})).limit(1)

    def info(self) -> DataFrame:
        """(collection, chunks) by name, as the versions have them."""
        rows = [(n, self.entry(n)["count"]) for n in self.names()]
        return self.spark.createDataFrame(rows, "collection string, chunks long").orderBy("collection")

    # Keeping house

    def vacuum(self, name: str) -> int:
        """Delete older versions and the segments that only they have; returns how many of both. Nothing may write meanwhile."""
        entry = self.entry(name)
        keep = {s["name"] for s in entry["segments"]} | {f"{entry['version']}.json"}
        folder = self._folder(name)
        old = [f"{folder}/{n}" for n in self._list(folder) if n.startswith("s-") and n not in keep]
        old += [f"{folder}/log/{n}" for n in self._list(f"{folder}/log") if n not in keep]
        return sum(bool(fs.delete(where, True)) for fs, where in map(self._fs, old))

    def drop(self, name: str, confirm: bool = False) -> None:
        if not confirm:
            raise ValueError("dropping a collection must be confirmed")
        fs, where = self._fs(self._folder(name))
        fs.delete(where, True)

    def manifest(self, name: str, **more) -> dict:
        entry = self.entry(name)
        out = {"name": name, "chunks": entry["count"], "schema": entry["schema"]} | more
        self._write_text(f"{self._folder(name)}/manifest.json", json.dumps(out))
        return out

    def read_manifest(self, name: str) -> dict | None:
        text = self._read_text(f"{self._folder(name)}/manifest.json")
        return json.loads(text) if text else None
