import pytest

from pyspark.sql import functions as F

from lodestar.operators import ledger, maintain
from lodestar.operators.store import Store
from lodestar.sources import records


def test_registry(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    path = str(tmp_path / "collections.json")
    first = records.Registry(store, path)
    first.update_entry("b", source_file="x", description=None)
    first.update_entry("a", enabled=False)
    again = records.Registry(store, path)
    assert again == {"a": {"enabled": False}, "b": {"enabled": True, "source_file": "x"}} and again.enabled() == ["b"]
    assert [r["name"] for r in again.table(spark).collect()] == ["a", "b"]
    again.remove("a")
    assert set(records.Registry(store, path)) == {"b"}
    (tmp_path / "broken.json").write_text("{")
    with pytest.raises(ValueError, match="broken"):
        records.Registry(store, str(tmp_path / "broken.json"))


def test_history_and_tail(spark, tmp_path):
    rows = spark.createDataFrame([("2026-10-02T00:00:00Z", "upload", "a"), ("2026-10-01T00:00:00Z", "index", "a"), ("2026-09-01T00:00:00Z", "upload", "b")], "ts string, op string, file string")
    records.append_history(rows, str(tmp_path / "h"))
    back = records.read_history(spark, str(tmp_path / "h"))
    assert [r["op"] for r in ledger.history_for(back, "a").collect()] == ["index", "upload"]
    assert [r["file"] for r in ledger.recent_uploads(back).collect()] == ["a", "b"]
    (tmp_path / "log").write_text("\n".join(f"l{i}" for i in range(10)))
    assert [r["value"] for r in records.tail(spark, str(tmp_path / "log"), 3).orderBy("line_no").collect()] == ["l7", "l8", "l9"]


def test_migration(spark):
    legacy = spark.createDataFrame([("old/a.md", "# T\n\n- source: http://a\n- fetched_at: 2026-10-16T01:02:03Z\n\nbody"), ("old/b.md", "body"), ("old/c.md", "  ")], "path string, text string")
    entries, moves = ledger.migrated(legacy)
    assert entries.count() == 1 and moves.count() == 2
    new = {r["old"]: r["new"] for r in moves.collect()}
    assert new["old/a.md"].startswith("2026-10-16/web/_/010203-") and new["old/a.md"].endswith("-t.md")


def test_small_maintenance(spark):
    catalog = spark.createDataFrame([("a", 1), ("b", 0), ("c", None)], "name string, chunks int")
    assert [r["name"] for r in maintain.prune_sources(catalog).collect()] == ["a"]
    assert sorted(r["name"] for r in maintain.missing_collections(catalog, catalog.where("name = 'a'")).collect()) == ["b", "c"]
    assert maintain.backfill(catalog, "s", "2026-10-16").first()["source_file"] == "s"


def test_migration_keeps_the_first_of_equal_bodies(spark):
    """Which of several documents of one body stays does not depend on how they are dealt out."""
    rows = [(f"old/{i}.md", f"# T {'dcba'[i % 4]}\n\n- source: http://x\n- fetched_at: 2026-10-16T01:02:03Z\n\nbody") for i in range(40)]
    entries, _ = ledger.migrated(spark.createDataFrame(rows, "path string, text string").repartition(7))
    assert [r["path"][-6:] for r in entries.collect()] == ["t-a.md"]


def test_repair_tells_equal_ids_apart(spark):
    """Two documents of one short id: the file's name decides; an id of one document is enough."""
    book = [("2026-10-01/web/_/010203-aaaaaaaa-one.md", "aaaaaaaa", "aaaaaaaa1", 1), ("2026-10-02/web/_/010203-aaaaaaaa-two.md", "aaaaaaaa", "aaaaaaaa2", 1), ("2026-10-03/web/_/010203-bbbbbbbb-b.md", "bbbbbbbb", "b", 1)]
    ledger_ = spark.createDataFrame(book, "path string, id string, sha256 string, updated_at int").withColumn("raw_sha256", F.lit(""))
    names = ["old/010203-aaaaaaaa-two.md", "old/010203-aaaaaaaa-one.md", "old/010203-aaaaaaaa-none.md", "old/999999-bbbbbbbb-other.md"]
    found = ledger.repaired(spark.createDataFrame([(n, "") for n in names], "source_file string, sha256 string"), ledger_)
    assert {r["source_file"]: (r["found"], r["how"]) for r in found.collect()} == {names[0]: (book[1][0], "id"), names[1]: (book[0][0], "id"), names[2]: (book[0][0], "id"), names[3]: (book[2][0], "id")}


def test_slugs_of_odd_texts_equal_their_sql(spark, tmp_path):
    import duckdb

    from lodestar import queries

    texts = ["Éé ü. ñ!", "...", " ", "", None, "東京 Tea & Cake", "--A.b--", "İx " * 40, "\n Zz "]
    spark.createDataFrame([(i, t, "s", "en") for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(queries.ORACLES["slugs"] + " ORDER BY doc_id").fetchall()
    assert [tuple(r) for r in queries.QUERIES["slugs"](spark, str(tmp_path)).orderBy("doc_id").collect()] == want
