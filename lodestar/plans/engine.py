"""The engine: memories and documents, searched by meaning, by words and by text."""

from __future__ import annotations

import functools
import json
import time
import uuid
from collections.abc import Callable, Sequence
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.functions.dates import parse_date
from lodestar.functions.text import content_id, content_sha, expand_tags, safe_key, sanitize_segment, strip_front_matter
from lodestar.operators import chunking, fusion, grep, ledger, maintain, multi, vault, vector
from lodestar.operators.filters import apply_filter, from_metadata
from lodestar.operators.store import POINTS, Store, tag_tree, with_norm
from lodestar.plans.scratch import delete_path, materialize, release
from lodestar.sources import records, websearch
from lodestar.sources.records import Registry
from lodestar.sources.settings import Settings

Embedder = Callable[[list[str]], list[list[float]]]
Scorer = Callable[[str, list[str]], list[float]]


def hashed_embedder(dimension: int = 64) -> Embedder:
    """An offline embedder: words are hashed to signed coordinates and the sum is scaled to length 1."""
    import hashlib

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * dimension
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                v[h % dimension] += 1.0 if h >> 63 else -1.0
            size = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / size for x in v])
        return out

    return embed


class Engine:
    """All operations over one root folder. Models are functions; the defaults need no network."""

    def __init__(self, spark: SparkSession, root: str, settings: Settings | None = None, embedder: Embedder | None = None, scorer: Scorer | None = None):
        self.spark, self.root, self.settings = spark, root.rstrip("/"), settings or Settings()
        self.store, self.documents = Store(spark, f"{self.root}/collections"), Store(spark, f"{self.root}/documents")
        self.embedder, self.scorer = embedder or hashed_embedder(), scorer or fusion.overlap_scorer
        self.recover()
        self.registry = Registry(self.store, f"{self.root}/collections.json")

    # Changes of several tables

    def _together(self, prepared: list[tuple[str, dict]], records_: dict | None = None) -> None:
        """Make the versions of prepared changes, of stores by name, all or none: what is in the transaction's file will be done."""
        path = f"{self.root}/transactions/{uuid.uuid4().hex}.json"
        for where, p in prepared:
            if getattr(self, where).current(p["collection"]) != p["base"]:
                raise RuntimeError(f"collection {p['collection']!r} was changed meanwhile")
        self.store._write_new(path, json.dumps({"changes": prepared, "registry": records_ or {}}))
        self._apply(path)

    def _apply(self, path: str) -> None:
        told = json.loads(self.store._read_text(path))
        for where, p in told["changes"]:
            getattr(self, where).finish(p)
        if told["registry"]:
            Registry(self.store, f"{self.root}/collections.json").update_all(told["registry"])
        delete_path(self.spark, path)

    def recover(self) -> int:
        """Finish changes of several tables that broke off; returns how many."""
        found = [f"{self.root}/transactions/{n}" for n in self.store._list(f"{self.root}/transactions") if n.endswith(".json")]
        for path in found:
            self._apply(path)
        return len(found)

    # Writing

    def embed(self, docs: DataFrame, column: str = "text") -> DataFrame:
        """Add the vector of a text column, computed in Arrow batches."""
        embedder = self.embedder

        @F.pandas_udf("array<float>")
        def run(texts: pd.Series) -> pd.Series:
            return pd.Series(embedder(texts.fillna("").tolist()))

        return docs.withColumn("vector", run(column))

    def points(self, docs: DataFrame, collection: str, strategy: str | None = None, size: int = 0, overlap: int = -1, strip: bool = True) -> DataFrame:
        """Points of documents (text, source_file, metadata, tags): chunked, identified and embedded in one plan; front matter is left out."""
        s = self.settings
        size = size or s.chunk_size
        overlap = chunking.overlap_of(size, s.chunk_overlap_percent) if overlap < 0 else overlap
        rows = docs.withColumn("text", strip_front_matter(F.col("text"))) if strip else docs
        chunks = chunking.chunk(rows.select("source_file", "metadata", "tags", "text"), strategy or s.chunk_strategy, size, overlap)
        full = self.embed(chunks.where(F.trim("text") != "").withColumn("collection", F.lit(collection)))
        return full.select(
            "collection", safe_key(F.col("source_file")).alias("source_key"), "source_file", F.element_at(F.split("source_file", "/", -1), -1).alias("source"), F.col("source_file").alias("source_rel"),
            content_id(F.col("collection"), F.col("text")).alias("point_id"), content_sha(F.col("text")).alias("content_sha"), F.conv(F.substring(content_sha(F.col("text")), 1, 8), 16, 10).cast("long").alias("hash"),
            F.col("chunk_index").cast("int").alias("chunk_index"), "text", F.lit(datetime.now(UTC)).alias("indexed_at"), "metadata", "tags", expand_tags(F.coalesce("tags", F.array().cast("array<string>"))).alias("tags_expanded"), "vector", F.lit(None).cast("double").alias("norm"),
        )

    def provenance(self) -> dict:
        """What vectors are made with now."""
        s = self.settings
        return {"embed_model": s.embed_model, "embed_provider": s.embed_provider, "vector_dim": len(self.embedder(["ok"])[0]), "vector_distance": s.vector_distance}

    def index_documents(self, docs: DataFrame, collection: str, replace_source: bool = False, **options) -> int:
        """Chunk, embed and upsert, in one change; returns the rows of the collection afterwards.

        Refused if the collection was made by another model. ``self.warnings`` then holds what is odd about the new chunks.
        """
        self.store.create(collection, POINTS)
        made = self.provenance()
        maintain.check_provenance(self.registry.get(collection, {}), made)
        new = self.points(docs, collection, **options)
        entry, sources = self.store.entry(collection), docs.select("source_file").distinct()
        gone = self.store.read(collection).join(sources, "source_file", "left_semi").select(*entry["keys"]) if replace_source else None
        self.store.upsert(collection, new, gone, entry)
        self.warnings = chunking.problems(self.store.read(collection).join(sources, "source_file", "left_semi"), "source_key")
        self.registry.update_entry(collection, **made)
        self.note("index", collection, docs)
        return self.store.count(collection)

    def rebuild_collection(self, docs: DataFrame, collection: str, **options) -> int:
        """Index these documents and nothing else, by the model of today."""
        self.store.create(collection, POINTS)
        self.store.replace(collection, with_norm(self.points(docs, collection, **options)))
        self.registry.update_entry(collection, **self.provenance())
        return self.store.count(collection)

    def store_memory(self, text: str, collection: str = "", metadata: dict[str, str] | None = None, tags: Sequence[str] = ()) -> str:
        """Index one text and return its content id."""
        if not text.strip():
            raise ValueError("an empty text")
        name = collection or self.settings.default_collection
        if not name:
            raise ValueError("no collection is given and there is no default")
        row = self.spark.createDataFrame([(text, "direct_text", {"kind": "memory", "visibility": "private"} | (metadata or {}), list(tags))], "text string, source_file string, metadata map<string,string>, tags array<string>")
        self.index_documents(row, name)
        self._file_memory(row)
        return row.select(content_sha(F.col("text"))).first()[0]

    def _file_memory(self, row: DataFrame) -> None:
        self.file_documents(row.select(F.lit(0).cast("long").alias("doc_id"), "text", F.lit("").alias("title"), F.lit("").alias("url"), F.current_timestamp().alias("fetched_at")), "agent")

    def note(self, op: str, collection: str, docs: DataFrame | None = None, **more) -> None:
        """Add a row to the history: one a source, or one for the collection."""
        from lodestar.functions.dates import rfc3339

        s = self.settings
        files = docs.groupBy("source_file").count().select(F.col("source_file").alias("file"), F.col("count").alias("chunks")) if docs is not None else self.spark.createDataFrame([(more.pop("file", ""), more.pop("chunks", None))], "file string, chunks long")
        fixed = {"op": op, "collection": collection, "sha256": None, "backend": "parquet", "mode": None, "embed_provider": s.embed_provider, "embed_model": s.embed_model, "vector_dim": None, "ok": True, "error": None} | more
        kinds = {f.name: f.dataType for f in T.StructType.fromDDL(records.HISTORY).fields}
        rows = files.withColumns({"ts": rfc3339(F.current_timestamp())} | {k: F.lit(v).cast(kinds[k]) for k, v in fixed.items()})
        records.append_history(rows.select(*kinds), f"{self.root}/history")

    def history(self) -> DataFrame:
        return records.read_history(self.spark, f"{self.root}/history")

    def journal(self) -> DataFrame:
        """One text a day of all memories."""
        return vault.agent_journal(self.documents.read("vault").where("channel = 'agent'").select(F.col("updated_at").alias("stored_at"), "text"))

    def update_memory(self, collection: str, text: str, condition: dict, dry_run: bool = False) -> dict:
        """Replace matching rows by a new text in one change.

        The new row keeps the kind and visibility of the first of them by content, names it and says how many there are; the table
        of superseded rows lists them all.
        """
        entry, rows = self.store.entry(collection), self.store.read(collection)
        old = materialize(apply_filter(rows, condition).select(*entry["keys"], "content_sha", "metadata"), "superseded")
        matched, first = old.count(), old.orderBy("content_sha", *entry["keys"]).first()
        if dry_run or not matched:
            return {"matched": matched, "new_ids": []}
        kept = {k: v for k, v in (first["metadata"] or {}).items() if k in ("kind", "visibility")}
        row = self.spark.createDataFrame([(text, "direct_text", kept | {"supersedes": first["content_sha"], "supersedes_n": str(matched)}, [])], "text string, source_file string, metadata map<string,string>, tags array<string>")
        new = materialize(self.points(row, collection), "memory")
        self.store.upsert(collection, new, old.select(*entry["keys"]), entry)
        links = old.select(F.lit(collection).alias("collection"), F.col("content_sha").alias("old_sha")).distinct().withColumn("new_sha", F.lit(new.first()["content_sha"])).withColumn("at", F.current_timestamp())
        links.write.mode("append").parquet(f"{self.root}/superseded")
        self._file_memory(row)
        self.note("update", collection, row)
        ids = [r["content_sha"] for r in new.select("content_sha").collect()]
        release(old, new)
        return {"matched": matched, "new_ids": ids}

    def superseded(self) -> DataFrame:
        """(collection, old_sha, new_sha, at) of all replaced memories."""
        return self.spark.read.schema("collection string, old_sha string, new_sha string, at timestamp").parquet(f"{self.root}/superseded")

    def delete_memory(self, collection: str, condition: dict | None = None, metadata: dict | None = None, allow_all: bool = False) -> int:
        n = self.store.delete(collection, from_metadata(metadata, condition), allow_all)
        self.note("delete", collection, chunks=n)
        return n

    # Searching

    def _targets(self, collections: Sequence[str] = ()) -> list[str]:
        stored = self.store.names()
        if collections:
            return list(collections)
        if self.settings.default_collection:
            return [self.settings.default_collection]
        enabled = [n for n in self.registry.enabled() if n in stored]
        return enabled or stored

    def search_memory(self, query: str, collections: Sequence[str] = (), top_k: int = 0, threshold: float | None = None, condition: dict | None = None, metadata: dict | None = None, rerank: bool | None = None) -> DataFrame:
        """The best rows of all target collections: cosine and words fused, then reranked; score_kind says what the score is."""
        return self.search_collections(query, collections, top_k, threshold, condition, metadata, rerank)["hits"]

    def search_collections(self, query: str, collections: Sequence[str] = (), top_k: int = 0, threshold: float | None = None, condition: dict | None = None, metadata: dict | None = None, rerank: bool | None = None) -> dict:
        """hits; report: a row a collection with its status and counts, observed during the one scan; timings in milliseconds.

        A collection that is missing or holds only vectors of another dimension is reported, not searched; an error if none can be.
        """
        s, clock, timings = self.settings, time.monotonic, {}
        k = top_k or s.top_k
        rerank = s.rerank if rerank is None else rerank
        recall = max(s.rerank_recall, k) if rerank else k
        asked = query[: s.query_max_chars] + "…" if s.query_max_chars and len(query) > s.query_max_chars else query
        start = clock()
        [vec] = self.embedder([asked])
        timings["embed"], start = clock() - start, clock()
        names, failed = [], {}
        for name in self._targets(collections):
            try:
                self.store.entry(name)
                names.append(name)
            except (KeyError, ValueError) as e:
                failed[name] = str(e)
        if not names:
            raise ValueError("no collection could be searched: " + "; ".join(f"{n}: {why}" for n, why in failed.items()))
        where = from_metadata(metadata, condition)
        rows = apply_filter(self.store.read_many(names), where)
        seen = Observation()
        near = multi.near_hits(multi.observed(rows, names, len(vec), seen), vec, recall, s.threshold if threshold is None else threshold)
        words = None
        if s.bm25_enabled:
            stored = {n: self.store.postings(n) for n in names}
            terms = functools.reduce(DataFrame.unionByName, (t.withColumn("collection", F.lit(n)) for n, (t, _) in stored.items()))
            stats = functools.reduce(DataFrame.unionByName, (x.withColumn("collection", F.lit(n)) for n, (_, x) in stored.items()))
            words = multi.keyword_hits(terms, stats, query, recall, rows if where else None)
        timings["plan"], start = clock() - start, clock()
        fused = materialize(multi.fused_hits(near, words, recall), "hits")
        keys = list(multi.KEYS)
        counts = {r["collection"]: r["count"] for r in fused.groupBy("collection").count().collect()}
        report = multi.report(self.spark, names, failed, seen.get, counts)
        timings["search"], start = clock() - start, clock()
        if not report.where("status = 'ok'").head(1):
            raise ValueError("no collection could be searched: " + "; ".join(f"{r['collection']}: {r['detail']}" for r in report.collect()))
        hits = rows.join(fused, keys).select(*keys, "text", "source", "chunk_index", "content_sha", "tags", "tags_expanded", "metadata", "score", "score_kind")
        hits = fusion.rerank(hits, query, self.scorer, keys, k).withColumn("score_kind", F.lit("rerank")) if rerank else hits.orderBy(F.desc("score"), *keys).limit(k)
        timings["rerank"] = clock() - start
        return {"hits": hits, "report": report, "timings": {n: round(1000 * t, 1) for n, t in timings.items()}}

    def search_debug(self, query: str, collection: str, top_k: int = 5, threshold: float = 0.0) -> dict:
        """The hits, the report and timings of the search, and what the threshold removes from the recall window."""
        [vec] = self.embedder([query])
        killed = vector.killed_by_threshold(self.store.read(collection), vec, max(self.settings.rerank_recall, top_k), threshold)
        return self.search_collections(query, [collection], top_k, threshold) | {"killed": killed}

    def get_chunk(self, collection: str, identity: str) -> DataFrame:
        return self.store.get(collection, identity)

    def tag_tree(self, collection: str) -> DataFrame:
        return tag_tree(self.store.read(collection))

    # Collections

    def list_collections(self) -> DataFrame:
        return self.store.info()

    def collection_info(self, name: str) -> dict:
        return {"name": name, "chunks": self.store.count(name)} | self.registry.get(name, {})

    def set_collection_meta(self, name: str, **changes) -> dict:
        """Change what is given; None leaves a value as it is."""
        self.store.read(name)
        return self.registry.update_entry(name, **changes)

    def delete_collection(self, name: str, confirm: bool = False) -> None:
        self.store.drop(name, confirm)
        self.registry.remove(name)

    def verify(self, name: str) -> DataFrame:
        """What is wrong with the rows by the catalog that was written with them."""
        return maintain.verify_structure(self.store.catalog(name), self.store.read(name), self.settings.vector_dim)

    def import_collections(self) -> DataFrame:
        """Verify the stored collections that the registry does not know and register those without a fault: (name, status, issues)."""
        rows = []
        for name in (n for n in self.store.names() if n not in self.registry):
            issues = self.verify(name).count()
            if not issues:
                self.registry.update_entry(name, **{k: v for k, v in (self.store.read_manifest(name) or {}).items() if k in ("embed_model", "embed_provider", "vector_dim", "vector_distance", "description")})
            rows.append((name, "broken" if issues else "registered", issues))
        return self.spark.createDataFrame(rows, "name string, status string, issues long")

    def verify_deep(self, name: str, source: str, text: str, samples: int = 20) -> dict:
        """Coverage of a source's current text by its stored chunks, as it is or without front matter, whichever is better, and the median cosine of stored and fresh vectors."""
        rows = self.store.read(name).where(F.col("source_file") == source)
        now = self.spark.createDataFrame([(source, text, {}, [])], "source_file string, text string, metadata map<string,string>, tags array<string>")
        chunks = [self.points(now, name, strip=strip).select(F.lit(strip).alias("doc_id"), "text") for strip in (False, True)]
        cover = maintain.coverage(chunks[0].unionByName(chunks[1]), rows).orderBy(F.desc("ratio")).first()
        sample = self.embed(rows.orderBy("point_id").limit(samples).select("text", F.col("vector").alias("a"))).withColumnRenamed("vector", "b")
        median = maintain.vector_median(sample).first()
        return {"coverage": cover["ratio"] if cover else 0.0, "median": median["median"] if median else None, "ok": bool(cover and median and cover["ratio"] >= maintain.COVERAGE and median["median"] >= maintain.MEDIAN)}

    # Documents

    def file_documents(self, docs: DataFrame, channel: str = "upload") -> DataFrame:
        """File documents (doc_id, text, title, url, fetched_at): new bodies are added, known ones gain addresses."""
        return self._filing(docs, channel)[0]

    def _filing(self, docs: DataFrame, channel: str, commit: bool = True) -> tuple[DataFrame, dict]:
        if channel not in vault.CHANNELS:
            raise ValueError(f"unknown channel {channel!r}")
        schema = "sha256 string, doc_id long, urls array<string>, updated_at timestamp, day date, channel string, category string, path string, title string, text string"
        self.documents.create("vault", schema)
        entry, known = self.documents.entry("vault"), self.documents.read("vault")
        status = materialize(vault.filed(docs, known), "filed")
        bodies = vault.identity(docs).dropDuplicates(["sha256"]).select("sha256", F.col("body").alias("text"), "title", F.col("url").alias("_url"), "fetched_at")
        cat = vault.category([tuple(r) for r in self.settings.category_rules], vault.host_of(F.coalesce("_url", F.lit(""))), F.coalesce("title", F.lit("")), F.array().cast("array<string>"))
        path = vault.vault_path(F.col("fetched_at"), F.lit(channel), F.col("category"), F.col("sha256"), F.col("title"), F.col("_url"), F.lit(".md"))
        new = status.join(bodies, "sha256").withColumn("channel", F.lit(channel)).withColumn("category", cat).withColumn("path", path).select(*known.columns)
        seen = status.select("sha256", F.col("urls").alias("_u"), F.col("updated_at").alias("_t"))
        refreshed = known.join(seen, "sha256").withColumn("urls", F.col("_u")).withColumn("updated_at", F.col("_t")).select(*known.columns)
        added = new.join(known.select("sha256"), "sha256", "left_anti").select(*known.columns)
        made = self.documents.change("vault", refreshed.unionByName(added), None, entry, commit)
        return status.select("sha256", "status"), made

    def search_document(self, query: str, limit: int = grep.LIMIT, since: str | None = None, until: str | None = None, channel: str | None = None, category: str | None = None, path: str | None = None, **options) -> tuple[DataFrame, dict]:
        docs = grep.scope(self.documents.read("vault"), since, until, channel, category, path)
        return grep.search_documents(docs, query, limit, keep=("title", "urls", "channel", "category"), **options)

    def read_document(self, path: str, first: int = 1, last: int = 0) -> DataFrame:
        if path.startswith("/") or ".." in path.split("/"):
            raise ValueError("the path leaves the vault")
        return grep.read_lines(self.documents.read("vault").where(F.col("path") == path), first, last)

    def list_documents(self, channel: str | None = None, limit: int = 50) -> DataFrame:
        return vault.list_documents(self.documents.read("vault"), channel, limit)

    def documents_import(self, folder: str, max_files: int = 0) -> DataFrame:
        """File the text files below a folder; refused ones are listed with the reason."""
        files = vault.read_folder(self.spark, folder, max_files)
        self.documents.create("vault", "sha256 string, doc_id long, urls array<string>, updated_at timestamp, day date, channel string, category string, path string, title string, text string")
        raw = self.documents.read("vault").select(F.sha2("text", 256).alias("raw_sha256"))
        found = materialize(vault.classify_import(files, raw), "import")
        text = files.join(found.where("status = 'imported'"), "rel").select(F.xxhash64("rel").alias("doc_id"), F.decode("content", "UTF-8").alias("text"), "title", F.col("rel").alias("url"), F.current_timestamp().alias("fetched_at"))
        self.file_documents(text, "import")
        return found

    def upload(self, name: str, content: bytes, title: str = "") -> DataFrame:
        """File one text given as bytes; of the name the last part counts. What import refuses is refused here."""
        base = name.replace("\\", "/").rsplit("/", 1)[-1]
        if len(content) > vault.MAX_BYTES:
            raise ValueError("too large")
        if not content or b"\0" in content[:8000]:
            raise ValueError("empty or binary")
        row = self.spark.createDataFrame([(0, content.decode("utf-8", "replace"), title or base.rsplit(".", 1)[0], base, datetime.now(UTC))], "doc_id long, text string, title string, url string, fetched_at timestamp")
        return self.file_documents(row, "upload")

    def update_document(self, path: str, **values: str) -> int:
        """Change fields (title, category) of one filed document in one change; returns how many rows there are of it.

        A document of another category has another path, in the folder of that category.
        """
        if odd := set(values) - {"title", "category"}:
            raise ValueError(f"these do not change: {sorted(odd)}")
        entry, rows = self.documents.entry("vault"), self.documents.read("vault").where(F.col("path") == path)
        changed = rows.withColumns({c: F.lit(v) for c, v in values.items()})
        if "category" in values:
            at = F.split("path", "/", -1)
            folder = F.coalesce(F.nullif(sanitize_segment(F.col("category")), F.lit("")), F.lit(vault.NO_CATEGORY))
            changed = changed.withColumn("path", F.concat_ws("/", F.slice(at, 1, 2), folder, F.element_at(at, -1)))
        return self.documents.change("vault", changed.select(*rows.columns), None, entry)["added"]

    def documents_migrate(self, folder: str, channel: str = "web", dry_run: bool = False) -> DataFrame:
        """File the texts of the old layout below a folder, point indexed sources and the registry to them; returns the moves (old, new).

        The originals' bytes are first kept in a table beside the vault. Vault, collections and registry change together: a break
        half-way is finished when the engine is opened again. The files stay.
        """
        files = materialize(vault.read_folder(self.spark, folder).where("content is not null").select("rel", "content"), "legacy")
        entries, found = ledger.migrated(files.select(F.col("rel").alias("path"), F.decode("content", "UTF-8").alias("text")), channel)
        moves = materialize(found, "moves")
        if dry_run:
            return moves
        files.withColumn("migrated_at", F.current_timestamp()).write.mode("append").parquet(f"{self.root}/migrated")
        stamp = F.coalesce(parse_date(F.col("fetched_at")), F.lit("1970-01-01").cast("timestamp"))
        docs = entries.select(F.xxhash64("path").alias("doc_id"), F.col("body").alias("text"), "title", "url", stamp.alias("fetched_at"))
        prepared = [("documents", self._filing(docs, channel, commit=False)[1])]
        # A source may be named by its path below the folder or by its full one.
        both = moves.unionByName(moves.select(F.concat(F.lit(folder.rstrip("/") + "/"), "old").alias("old"), "new"))
        for name in self.store.names():
            if not self.store.read(name).join(both, F.col("source_file") == F.col("old"), "left_semi").isEmpty():
                prepared.append(("store", self.store.rename_sources(name, both, commit=False)))
        told = self.registry.table(self.spark).join(both, F.col("source_file") == F.col("old")).select("name", "new").collect() if self.registry else []
        self._together(prepared, {r["name"]: {"source_file": r["new"]} for r in told})
        self.registry = Registry(self.store, f"{self.root}/collections.json")
        self.note("migrate", "", moves.select(F.col("new").alias("source_file")))
        release(files)
        return moves

    def documents_prune(self, folder: str) -> int:
        """Drop imported documents whose file is no longer below the folder; returns how many."""
        entry, rows = self.documents.entry("vault"), self.documents.read("vault").where("channel = 'import'")
        files = vault.read_folder(self.spark, folder).select(F.explode(F.array("rel")).alias("_url"))
        known = rows.withColumn("_url", F.explode("urls")).join(files, "_url", "left_semi").select("sha256")
        return self.documents.change("vault", None, rows.join(known, "sha256", "left_anti").select("sha256"), entry)["hid"]

    def repair_sources(self, collection: str, sources: DataFrame, book: DataFrame) -> int:
        """Point sources whose file has moved to where the ledger knows them; returns how many."""
        moves = materialize(ledger.repaired(sources, book).where("found is not null and found <> source_file").select(F.col("source_file").alias("old"), F.col("found").alias("new")), "moves")
        n = moves.count()
        if n:
            self.store.rename_sources(collection, moves)
            self.note("rename", collection, moves.select(F.col("new").alias("source_file")))
        release(moves)
        return n

    # Web

    def web_search(self, query: str, provider: str = "", ingest: str = "", **options) -> DataFrame:
        """Hits of the configured service, asked once; with ingest their texts are filed and indexed in that collection."""
        hits = websearch.search(self.spark, provider or self.settings.web_provider, query, count=self.settings.web_count, freshness_days=self.settings.freshness_days, **options)
        hits = materialize(hits, "web-hits")
        if ingest:
            self.ingest_web(hits, ingest)
        return hits

    def ingest_web(self, hits: DataFrame, collection: str) -> dict:
        """File web hits and index those whose text has changed; a page that has not is only marked as seen. If embedding fails, the stored version stays."""
        self.store.create(collection, POINTS)
        rows = hits.where("content is not null and content <> ''")
        pages = rows.select(F.lit(0).cast("long").alias("doc_id"), F.col("content").alias("text"), "title", "url", F.current_timestamp().alias("fetched_at"))
        self.file_documents(pages, "web")
        fresh = materialize(web_rows(rows).dropDuplicates(["source_file"]), "web-rows")
        known = self.store.read(collection).select("source_file", F.try_element_at("metadata", F.lit("page_sha")).alias("_sha")).distinct()
        same = materialize(fresh.join(known, "source_file").where(F.col("_sha") == F.col("metadata")["page_sha"]).select("source_file").distinct(), "web-same")
        changed = fresh.join(same, "source_file", "left_anti")
        report = {"unchanged": same.count(), "indexed": changed.count()}
        if report["unchanged"]:
            entry, own = self.store.entry(collection), self.store.read(collection)
            seen = own.join(same, "source_file", "left_semi")
            stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
            marked = F.map_concat(F.map_filter("metadata", lambda k, _: k != "fetched_at"), F.create_map(F.lit("fetched_at"), stamp))
            self.store.change(collection, seen.withColumn("metadata", marked).select(*own.columns), None, entry)
        if report["indexed"]:
            self.index_documents(changed.select("text", "source_file", "metadata", "tags"), collection, replace_source=True)
        return report

    def health_check(self) -> dict:
        """Whether the store, the embedder and the scorer answer."""
        out = {}
        for name, probe in {"store": self.store.names, "embedder": lambda: self.embedder(["ok"]), "scorer": lambda: self.scorer("ok", ["ok"])}.items():
            try:
                probe()
                out[name] = "ok"
            except Exception as e:  # noqa: BLE001
                out[name] = f"failed: {e}"
        return out


def web_rows(hits: DataFrame) -> DataFrame:
    """Web hits as rows to index; the source of a page is its canonical address."""
    from lodestar.functions.dates import rfc3339
    from lodestar.functions.urls import canonical_url

    fields = {
        "page_sha": content_sha(F.col("content")), "source_type": F.lit("web"), "kind": F.lit("web"), "visibility": F.lit("private"), "provider": F.col("provider"), "url": F.col("url"), "canonical_url": canonical_url(F.col("url")), "title": F.col("title"),
        "fetched_at": rfc3339(F.current_timestamp()), "published_at": rfc3339(F.col("published_at")), "authority": F.when(F.col("authority") >= 0, F.col("authority").cast("string")), "score": F.when(F.col("score") != 0, F.format_string("%.4f", F.col("score"))),
    }
    full = F.create_map(*(x for k, v in fields.items() for x in (F.lit(k), v)))
    return hits.select(F.col("content").alias("text"), canonical_url(F.col("url")).alias("source_file"), F.map_filter(full, lambda _, v: v.isNotNull() & (v != "")).alias("metadata"), F.array().cast("array<string>").alias("tags"))


__all__ = ["Engine", "hashed_embedder", "web_rows"]
