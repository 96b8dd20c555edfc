"""Segments: what a change writes, what it hides, and who may commit it."""

import os
import random

import pytest
from pyspark.sql import functions as F

from lodestar.operators import keyword, store
from lodestar.operators.store import Store

SF = "/root/testdata/sf0.1"


def size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names)


def files(folder):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


@pytest.fixture
def own(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def points(spark, rows):
    """Rows (point_id, text) of one source each."""
    df = spark.createDataFrame(rows, "point_id string, text string")
    return df.select(F.lit("c").alias("collection"), F.lit("s").alias("source_key"), F.substring("point_id", 1, 1).alias("source_file"), "point_id", F.lit(0).alias("chunk_index"), "text", F.create_map(F.lit("n"), "point_id").alias("metadata"))


def test_an_upsert_writes_little(spark, own, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.select(F.lit("c").alias("collection"), F.col("source").alias("source_key"), F.col("lang").alias("source_file"), F.col("doc_id").cast("string").alias("point_id"), F.col("doc_id").cast("int").alias("chunk_index"), "text", F.create_map(F.lit("lang"), F.col("lang")).alias("metadata"))
    own.upsert("docs", rows.coalesce(4))
    before, there = size(tmp_path), files(tmp_path)
    own.upsert("docs", rows.where("chunk_index % 100 = 0").withColumn("text", F.concat(F.lit("new "), "text")))
    assert size(tmp_path) - before <= 0.05 * before
    assert {f: t for f, t in files(tmp_path).items() if f in there} == there
    got = own.read("docs")
    assert got.count() == own.count("docs") == rows.count()
    assert got.where("text LIKE 'new %'").count() == rows.where("chunk_index % 100 = 0").count()


def test_changes_against_a_dictionary(spark, own, monkeypatch):
    """Random upserts, deletes, payloads and renames; merging of segments on the way."""
    monkeypatch.setattr(store, "MOST_SEGMENTS", 6)
    rnd, want = random.Random(1), {}
    for step in range(9):
        some = {f"{rnd.choice('ab')}{rnd.randrange(25)}": f"t{step}" for _ in range(8)}
        if step % 4 == 2:
            word = f"t{rnd.randrange(step)}"
            n = own.delete("c", {"must": [{"key": "text", "match": {"value": word}}]})
            assert n == sum(t == word for t, _ in want.values())
            want = {k: v for k, v in want.items() if v[0] != word}
        elif step % 4 == 3:
            own.set_payload("c", {"seen": str(step)}, {"must": [{"key": "source_file", "match": {"value": "a"}}]})
            want = {k: (t, str(step) if k[0] == "a" else s) for k, (t, s) in want.items()}
        else:
            own.upsert("c", points(spark, list(some.items())))
            want |= {k: (t, None) for k, t in some.items()}
        rows = own.read("c").select("point_id", "text", F.try_element_at("metadata", F.lit("seen")).alias("seen")).collect()
        assert {r["point_id"]: (r["text"], r["seen"]) for r in rows} == want and len(rows) == len(want) == own.count("c")
        assert {r["source_file"]: r["chunks"] for r in own.catalog("c").collect()} == {a: n for a in "ab" if (n := sum(k[0] == a for k in want))}
    assert len(own.entry("c")["segments"]) < 6
    own.rename_sources("c", {"a": "z"})
    assert own.read("c").where("source_file = 'a'").isEmpty() and own.vacuum("c") > 0 and own.count("c") == own.read("c").count() == len(want)


def test_two_writers(spark, own):
    own.upsert("c", points(spark, [("a1", "x")]))
    entry = own.entry("c")
    own.upsert("c", points(spark, [("a2", "y")]))
    with pytest.raises(RuntimeError, match="meanwhile"):
        own.upsert("c", points(spark, [("a3", "z")]), entry=entry)
    assert not own._write_new(f"{own._folder('c')}/log/{own.current('c')}.json", "{}")
    assert own.count("c") == own.read("c").count() == 2 and len([n for n in os.listdir(f"{own.root}/c") if n.startswith("s-")]) == 3


def test_null_and_repeated_keys(spark, own):
    """A replaced table may repeat keys; a change of one row keeps the others of its key, an upsert takes the place of all."""
    rows = points(spark, [("a1", "x"), ("a1", "y"), (None, "n")])
    own.replace("c", rows)
    assert own.delete("c", {"must": [{"key": "text", "match": {"value": "x"}}]}) == 1
    assert sorted(r["text"] for r in own.read("c").collect()) == ["n", "y"]
    own.upsert("c", points(spark, [(None, "m"), ("a1", "z")]))
    assert sorted(r["text"] for r in own.read("c").collect()) == ["m", "z"] and own.count("c") == 2


def test_postings_of_segments(spark, own, tmp_path):
    rnd = random.Random(2)
    words = ["tea", "cup", "pot", "milk", "leaf"]
    text = lambda: " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 9)))
    own.upsert("c", points(spark, [(f"a{i}", text()) for i in range(40)]))
    own.postings("c", None)
    there = files(tmp_path)
    own.upsert("c", points(spark, [(f"a{i}", text()) for i in range(30, 50)]))
    own.delete("c", {"ids": [f"a{i}" for i in range(10)]})
    terms, stats = own.postings("c", None)
    fresh, sizes = keyword.point_postings(own.read("c"), None)
    rows = lambda df: sorted(map(tuple, df.select("point_id", "term", "tf", "dl").collect()))
    assert rows(terms) == rows(fresh)
    assert stats.first()["n"] == 40 and stats.first()["mean"] == pytest.approx(sizes.agg(F.avg("dl")).first()[0])
    assert {f: t for f, t in files(tmp_path).items() if f in there} == there
    best = keyword.search_points(terms, stats, "tea milk", 5).collect()
    plain = keyword.search_points(fresh, sizes.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("mean")), "tea milk", 5).collect()
    assert [round(r["score"], 9) for r in best] == [round(r["score"], 9) for r in plain]
    plan = keyword.search_points(terms, stats, "tea", 5)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(part" in plan or "PartitionFilters: [part" in plan


def test_an_index_is_made_once(spark, tmp_path):
    """The index of a table is kept while its files stay as they are; scan and index agree, with conditions too."""
    path = str(tmp_path / "docs")
    spark.createDataFrame([(1, "tea pot", "en"), (2, "tea tea milk", "fr"), (3, None, "en"), (4, "milk", "en")], "doc_id long, text string, lang string").write.parquet(path)
    read = lambda: spark.read.parquet(path)
    first = keyword.index(read())
    assert keyword.index(read()) is first and first.n == 4
    rows = lambda df: [(r["doc_id"], r["text"], round(r["score"], 9)) for r in df.collect()]
    for condition in (None, {"lang": "en"}):
        assert rows(keyword.search_indexed(read(), "tea milk", 3, condition)) == rows(keyword.search(read(), "tea milk", 3, condition))
    assert keyword.search_keys(read(), "").count() == keyword.search_keys(read(), "absent").count() == 0
    spark.createDataFrame([(5, "tea", "en")], "doc_id long, text string, lang string").write.mode("append").parquet(path)
    assert keyword.index(read()) is not first and keyword.search_indexed(read(), "tea", 5).count() == 3
