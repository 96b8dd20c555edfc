import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from lodestar.plans.engine import Engine, web_rows
from lodestar.streaming import ingest


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "root"))


def docs(spark, *rows):
    return spark.createDataFrame([(t, s, m, g) for t, s, m, g in rows], "text string, source_file string, metadata map<string,string>, tags array<string>")


def test_memories(spark, engine):
    n = engine.index_documents(docs(spark, ("deepseek release notes", "w.md", {"source_type": "web"}, ["a/b"]), ("deepseek release notes again", "g.md", {"source_type": "agent"}, [])), "mem")
    assert n == 2
    hits = engine.search_memory("deepseek release", ["mem"], metadata={"source_type": "web"}, rerank=False).collect()
    assert [r["source"] for r in hits] == ["w.md"] and hits[0]["score_kind"] == "rrf"
    assert engine.search_memory("deepseek release", ["mem", "absent"]).first()["score_kind"] == "rerank"
    with pytest.raises(ValueError, match="absent"):
        engine.search_memory("x", ["absent"])
    assert {r["tag"] for r in engine.tag_tree("mem").collect()} == {"a", "a/b"}
    sha = engine.store_memory("a new card", "mem")
    assert engine.get_chunk("mem", sha).count() == 1
    out = engine.update_memory("mem", "a newer card", {"ids": [sha]})
    assert out["matched"] == 1 and engine.get_chunk("mem", sha).count() == 0
    assert engine.get_chunk("mem", out["new_ids"][0]).first()["metadata"]["supersedes"] == sha
    assert engine.delete_memory("mem", {"ids": out["new_ids"]}) == 1
    assert engine.verify("mem").count() == 0
    assert engine.verify_deep("mem", "w.md", "deepseek release notes")["ok"]
    assert engine.collection_info("mem")["chunks"] == 2
    assert engine.set_collection_meta("mem", description="d", enabled=None)["enabled"] is True
    assert engine.rebuild_collection(docs(spark, ("only", "o.md", {}, [])), "mem") == 1
    assert set(engine.health_check().values()) == {"ok"}
    engine.delete_collection("mem", confirm=True)
    assert engine.list_collections().count() == 0


def filed(spark, *rows):
    return spark.createDataFrame([(i, t, f"t{i}", f"http://x/{i}", dt.datetime(2026, 10, 16)) for i, t in rows], "doc_id long, text string, title string, url string, fetched_at timestamp")


def test_documents(spark, engine):
    assert {r["status"] for r in engine.file_documents(filed(spark, (1, "brown fox\nsecond"), (2, "other")), "web").collect()} == {"new"}
    engine.file_documents(filed(spark, (3, "brown fox\nsecond")), "web").count()
    rows = engine.list_documents("web").collect()
    assert len(rows) == 2 and sorted(len(r["urls"]) for r in rows) == [1, 2]
    hits, totals = engine.search_document("brown", channel="web", since="2026-10-01", until="2026-10-30")
    assert hits.count() == 1 and totals["documents"] == 1
    assert engine.read_document(hits.first()["path"], 2).first()["text"] == "second"
    with pytest.raises(ValueError):
        engine.read_document("../x")


def test_folder(spark, engine, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.md").write_text("first")
    (tmp_path / "in" / "two.txt").write_text("second")
    count = lambda: sorted(r["status"] for r in engine.documents_import(str(tmp_path / "in")).collect())
    assert count() == ["imported", "imported"] and count() == ["unchanged", "unchanged"]


def test_web_rows(spark):
    hits = spark.createDataFrame([("body", "http://a/x?utm_source=1", "T", "p", None, -1, 0.5)], "content string, url string, title string, provider string, published_at timestamp, authority int, score double")
    row = web_rows(hits).first()
    assert row["source_file"] == "http://a/x" and row["metadata"]["score"] == "0.5000" and "authority" not in row["metadata"]


def test_stream(spark, engine, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    write = lambda n, *rows: filed(spark, *rows).coalesce(1).write.mode("append").json(str(inbox))
    write(1, (1, "a"), (2, "b"), (3, "a"))
    stream = lambda: ingest.first_within(ingest.with_identity(ingest.read_inbox(spark, str(inbox))))
    ingest.run(stream(), ingest.file_sink(engine), str(tmp_path / "cp")).awaitTermination()
    assert engine.list_documents().count() == 2
    write(2, (4, "a"), (5, "c"))
    ingest.run(stream(), ingest.file_sink(engine), str(tmp_path / "cp")).awaitTermination()
    assert engine.list_documents().count() == 3


def test_sliding_dedup(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    seen = []
    day = lambda d: dt.datetime(2026, 1, 1) + dt.timedelta(days=d)
    out = ingest.sliding_first(ingest.read_inbox(spark, str(inbox), "sha256 string, fetched_at timestamp"), 10)
    for batch in ([("x", day(0)), ("y", day(0)), ("x", day(8))], [("x", day(16)), ("y", day(16))]):
        spark.createDataFrame(batch, "sha256 string, fetched_at timestamp").coalesce(1).write.mode("append").json(str(inbox))
        ingest.run(out, lambda df, n: seen.extend(tuple(r) for r in df.collect()), str(tmp_path / "cp")).awaitTermination()
    status = {(k, t): s for k, t, s in seen}
    assert status[("x", day(0))] == "new" and status[("x", day(8))] == "refreshed" and status[("x", day(16))] == "refreshed" and status[("y", day(16))] == "new"


def test_functions_registered(spark):
    from lodestar.functions.register import register

    register(spark)
    assert spark.sql("SELECT count(*) FROM chunks('aaaa', 'window', 2, 0)").first()[0] == 2
    assert spark.sql("SELECT normalize_text('a  \\n\\n\\n\\nb ')").first()[0] == "a\n\nb"


def test_texts_that_begin_alike_have_hashes_of_their_own(spark, engine):
    head = "x" * 100
    engine.index_documents(docs(spark, (head + " one", "a.md", {}, []), (head + " two", "b.md", {}, [])), "mem")
    hashes = [r["hash"] for r in engine.store.read("mem").collect()]
    assert len(set(hashes)) == 2
    assert engine.delete_memory("mem", {"ids": [str(hashes[0])]}) == 1


def test_another_model_is_refused(spark, tmp_path):
    from lodestar.plans.engine import hashed_embedder
    from lodestar.sources.settings import Settings

    Engine(spark, str(tmp_path / "r"), Settings(embed_model="one")).index_documents(docs(spark, ("a text", "a.md", {}, [])), "mem")
    later = Engine(spark, str(tmp_path / "r"), Settings(embed_model="two"))
    with pytest.raises(ValueError, match="embed_model"):
        later.index_documents(docs(spark, ("b text", "b.md", {}, [])), "mem")
    with pytest.raises(ValueError, match="vector_dim"):
        Engine(spark, str(tmp_path / "r"), Settings(embed_model="one"), hashed_embedder(8)).index_documents(docs(spark, ("b", "b.md", {}, [])), "mem")
    assert later.rebuild_collection(docs(spark, ("b text", "b.md", {}, [])), "mem") == 1
    assert later.index_documents(docs(spark, ("c text", "c.md", {}, [])), "mem") == 2


def test_verify_compares_with_the_stored_catalog(spark, engine):
    engine.index_documents(docs(spark, ("first", "a.md", {}, []), ("second", "b.md", {}, [])), "mem")
    assert engine.verify("mem").count() == 0
    engine.store.compact("mem")
    [segment] = engine.store.entry("mem")["segments"]
    rows, folder = engine.store.read("mem"), f"{engine.store._folder('mem')}/{segment['name']}/rows"
    kept = [tuple(r) for r in rows.where("source_file = 'a.md'").collect()]
    spark.createDataFrame(kept * 2, rows.schema).withColumn("_seq", F.lit(segment["seq"]).cast("long")).write.mode("overwrite").parquet(folder)
    assert {(r["kind"], r["source"]) for r in engine.verify("mem").collect()} == {("count_mismatch", "a.md"), ("missing_index", "b.md")}


def test_a_change_from_an_old_snapshot_is_refused(spark, engine):
    engine.index_documents(docs(spark, ("first", "a.md", {}, [])), "mem")
    base, rows = engine.store.current("mem"), engine.store.read("mem")
    engine.index_documents(docs(spark, ("second", "b.md", {}, [])), "mem")
    with pytest.raises(RuntimeError, match="meanwhile"):
        engine.store.replace("mem", rows.limit(0), base)
    assert engine.store.count("mem") == 2 and engine.store.vacuum("mem") >= 1 and engine.store.catalog("mem").count() == 2


def test_web_ingest(spark, engine):
    schema = "content string, url string, title string, provider string, published_at timestamp, authority int, score double"
    hits = lambda body: spark.createDataFrame([(body, "http://a/x?utm_source=1", "T", "p", None, -1, 0.5), ("", "http://b", "", "p", None, -1, 0.0)], schema)
    assert engine.ingest_web(hits("first version of a page"), "web") == {"unchanged": 0, "indexed": 1}
    assert engine.ingest_web(hits("first version of a page"), "web") == {"unchanged": 1, "indexed": 0}
    stored = engine.store.read("web").first()
    assert stored["metadata"]["fetched_at"] and engine.list_documents("web").count() == 1

    def broken(texts):
        if any("second" in t for t in texts):
            raise RuntimeError("no model")
        return [[1.0] * 64 for _ in texts]

    working, engine.embedder = engine.embedder, broken
    with pytest.raises(Exception, match="no model"):
        engine.ingest_web(hits("second version of a page"), "web")
    assert [r["text"] for r in engine.store.read("web").collect()] == ["first version of a page"]
    engine.embedder = working
    assert engine.ingest_web(hits("second version of a page"), "web") == {"unchanged": 0, "indexed": 1}
    assert [r["text"] for r in engine.store.read("web").collect()] == ["second version of a page"] and engine.list_documents("web").count() == 2


def test_document_changes(spark, engine, tmp_path):
    engine.upload("../in/My File.txt", b"uploaded text")
    with pytest.raises(ValueError):
        engine.upload("x", b"a\0b")
    [row] = engine.list_documents("upload").collect()
    assert row["title"] == "My File" and engine.update_document(row["path"], title="New", category="c") == 1
    moved = engine.list_documents("upload").first()
    assert moved["title"] == "New" and moved["path"] != row["path"] and "/c/" in moved["path"]
    assert engine.read_document(row["path"]).count() == 0 and engine.read_document(moved["path"]).first()["text"] == "uploaded text"
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "one.md").write_text("first")
    (folder / "two.md").write_text("second")
    (folder / "log.jsonl").write_text("{}")
    assert engine.documents_import(str(folder)).count() == 2
    (folder / "two.md").unlink()
    assert engine.documents_prune(str(folder)) == 1 and engine.list_documents("import").count() == 1
    old = tmp_path / "old"
    old.mkdir()
    (old / "a.md").write_text("# Title\n\n- source: http://x/y\n- fetched_at: 2026-10-16T01:02:03Z\n\nlegacy body\n")
    [move] = engine.documents_migrate(str(old)).collect()
    assert move["old"] == "a.md" and engine.list_documents("web").first()["path"] == move["new"]
    engine.store_memory("a card to remember", "mem")
    assert "a card to remember" in engine.journal().first()["text"]


def test_search_reports_each_collection(spark, tmp_path):
    """One search over three collections: one is missing, one has vectors of another dimension, one is searched."""
    from lodestar.plans.engine import hashed_embedder

    root = str(tmp_path / "r")
    Engine(spark, root, embedder=hashed_embedder(8)).index_documents(docs(spark, ("a short text", "a.md", {}, [])), "small")
    engine = Engine(spark, root)
    engine.index_documents(docs(spark, ("tea in a pot", "t.md", {}, []), ("milk in a jug", "m.md", {}, []), ("a pot of tea", "p.md", {"old": "1"}, [])), "mem")
    engine.delete_memory("mem", metadata={"old": "1"})
    out = engine.search_collections("tea pot", ["mem", "small", "absent"], rerank=False)
    assert [r["source"] for r in out["hits"].collect()][:1] == ["t.md"]
    rows = {r["collection"]: r for r in out["report"].collect()}
    assert rows["mem"]["status"] == "ok" and rows["mem"]["matched"] == rows["mem"]["comparable"] == 2
    assert rows["small"]["status"] == rows["absent"]["status"] == "failed" and rows["small"]["matched"] == 1 and "dimension" in rows["small"]["detail"]
    assert set(out["timings"]) == {"embed", "plan", "search", "rerank"} and engine.search_debug("tea", "mem")["killed"].count() == 0
    with pytest.raises(ValueError, match="dimension"):
        engine.search_memory("tea", ["small"])


def test_an_updated_memory_is_found(spark, engine):
    """The new text is found by meaning; it keeps kind and visibility; all superseded rows are listed; the history tells."""
    for n in range(3):
        engine.store_memory(f"the kettle is number {n}", "mem", {"visibility": "team"})
    out = engine.update_memory("mem", "the kettle was sold", {"metadata.visibility": "team"})
    assert out["matched"] == 3 and engine.store.count("mem") == 1
    row = engine.store.read("mem").first()
    assert row["norm"] == pytest.approx(1.0) and row["metadata"]["visibility"] == "team" and row["metadata"]["supersedes_n"] == "3"
    [hit] = engine.search_memory("the kettle was sold", ["mem"], threshold=0.25, rerank=False).collect()
    assert hit["content_sha"] == out["new_ids"][0]
    assert engine.superseded().where(F.col("new_sha") == out["new_ids"][0]).count() == 3
    assert "the kettle was sold" in engine.journal().agg(F.concat_ws(" ", F.collect_list("text"))).first()[0]
    assert {(r["op"], r["file"]) for r in engine.history().collect()} == {("index", "direct_text"), ("update", "direct_text")}


def test_stream_is_indexed_once(spark, engine, tmp_path):
    """A batch that comes again changes nothing; one that broke off is done over; late rows are dropped."""
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    row = lambda i, t, day=16: (i, t, f"t{i}", f"http://x/{i}", dt.datetime(2026, 10, day))
    write = lambda *rows: spark.createDataFrame(rows, "doc_id long, text string, title string, url string, fetched_at timestamp").coalesce(1).write.mode("append").json(str(inbox))
    stream = lambda: ingest.first_within(ingest.with_identity(ingest.read_inbox(spark, str(inbox))), 1)
    sink, calls = ingest.index_sink(engine, "mem"), []

    def twice(batch, number):
        calls.append(number)
        sink(batch, number)
        before = engine.store.current("mem"), engine.documents.current("vault")
        sink(batch, number)
        assert (engine.store.current("mem"), engine.documents.current("vault")) == before

    write(row(1, "tea in a pot"), row(2, "milk in a jug"), row(3, "tea in a pot"))
    ingest.run(stream(), twice, str(tmp_path / "cp")).awaitTermination()
    assert engine.store.count("mem") == 2 and engine.list_documents().count() == 2 and calls
    assert engine.search_memory("tea pot", ["mem"], rerank=False).first()["source"] == engine.store.read("mem").where("text LIKE 'tea%'").first()["source"]
    write(row(4, "far too late", 1), row(5, "coffee", 20))
    ingest.run(stream(), twice, str(tmp_path / "cp")).awaitTermination()
    assert engine.store.read("mem").where("text = 'far too late'").isEmpty() and engine.store.count("mem") == 3
    broken, engine.embedder = engine.embedder, None
    batch = spark.createDataFrame([row(6, "sugar")], "doc_id long, text string, title string, url string, fetched_at timestamp")
    with pytest.raises(TypeError):
        sink(batch, 900)
    engine.embedder = broken
    sink(batch, 900)
    assert engine.store.count("mem") == 4 and engine.list_documents().where("path LIKE '%sugar%' OR title = 't6'").count() == 1


def test_state_forgets(spark, tmp_path):
    """A key is new again when it was not seen for its time to live."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    # State with a time to live asks for further batches without data, so a run over what there is would not end.
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        inbox, seen = tmp_path / "inbox", []
        inbox.mkdir()
        put = lambda n, *keys: (inbox / f"{n}.json").write_text("".join('{"sha256": "%s"}\n' % k for k in keys))  # noqa: E731, UP031
        go = lambda: ingest.run(ingest.remembered(ingest.read_inbox(spark, str(inbox), "sha256 string"), dt.timedelta(seconds=45)), lambda df, n: seen.append(sorted(tuple(r) for r in df.collect())), str(tmp_path / "cp")).awaitTermination()
        put(1, "x", "y", "x")
        go()
        put(2, "x", "z")
        go()
        time.sleep(50)
        put(3, "x")
        go()
        seen = [s for s in seen if s]
        assert seen == [[("x", 1, "new"), ("x", 2, "refreshed"), ("y", 1, "new")], [("x", 3, "refreshed"), ("z", 1, "new")], [("x", 1, "new")]]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def test_a_migration_that_breaks_off_is_finished(spark, tmp_path, monkeypatch):
    """Vault, sources of two collections and the registry change together; the originals are kept; a break is finished later."""
    from lodestar.operators.store import Store

    old, root = tmp_path / "old", str(tmp_path / "r")
    old.mkdir()
    (old / "a.md").write_text("# Tea\n\n- source: http://x/tea\n- fetched_at: 2026-10-16T01:02:03Z\n\nabout tea\n")
    (old / "b.md").write_text("# Milk\n\nabout milk\n")
    engine = Engine(spark, root)
    engine.index_documents(docs(spark, ("about tea", "a.md", {}, []), ("about cups", "c.md", {}, [])), "one")
    engine.index_documents(docs(spark, ("about milk", f"{old}/b.md", {}, [])), "two")
    engine.set_collection_meta("two", source_file="b.md")
    assert engine.documents_migrate(str(old), dry_run=True).count() == 2 and not engine.documents.exists("vault")
    finish, calls = Store.finish, []

    def broken(self, prepared):
        calls.append(prepared["collection"])
        if len(calls) == 2:
            raise OSError("lost")
        finish(self, prepared)

    monkeypatch.setattr(Store, "finish", broken)
    with pytest.raises(OSError, match="lost"):
        engine.documents_migrate(str(old))
    assert engine.list_documents("web").count() == 2 and not engine.store.read("one").where("source_file = 'a.md'").isEmpty()
    monkeypatch.setattr(Store, "finish", finish)
    later = Engine(spark, root)
    paths = {r["title"]: r["path"] for r in later.list_documents("web").collect()}
    assert {r["source_file"] for r in later.store.read("one").collect()} == {paths["Tea"], "c.md"}
    assert [r["source_file"] for r in later.store.read("two").collect()] == [paths["Milk"]] and later.registry["two"]["source_file"] == paths["Milk"]
    assert later.recover() == 0 and spark.read.parquet(f"{root}/migrated").count() == 2
    assert later.search_memory("about tea", ["one"], rerank=False).first()["source"] == "a.md"
