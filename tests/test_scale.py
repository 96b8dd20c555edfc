"""Operators that must not gather groups: nearest neighbours by tiles, exact medians, ledger folders, bounded samples."""

import math
import os
import random

import pytest

from lodestar.operators import ledger, maintain, vector


def test_many_queries_against_brute_force(spark, monkeypatch):
    """Small blocks, copies in one cluster, vectors without length, of another dimension, or null; ties by id; a threshold."""
    monkeypatch.setattr(vector, "PIVOTS", 5)
    monkeypatch.setattr(vector, "BLOCK", 16)
    rnd = random.Random(1)
    vec = lambda: [rnd.gauss(0, 1) for _ in range(6)]
    hot = vec()
    rows = [(i, hot if i % 3 == 0 else vec()) for i in range(150)] + [(150, [0.0] * 6), (151, None), (152, [1.0, 0.0]), (153, [0.5, 0.1])]
    points = spark.createDataFrame(rows, "point_id long, vector array<double>")
    asked = [(i, rows[i][1]) for i in (0, 1, 2, 5, 150, 151, 152)] + [(900, [2 * x for x in hot]), (901, [1.0])]
    queries = spark.createDataFrame(asked, "query_id long, vector array<double>")

    def cosine(a, b):
        size = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b, strict=True)) / size if size else 0.0

    for k, threshold in ((4, 0.0), (70, 0.0), (60, 0.3)):
        got = {(r["query_id"], r["rank"]): (r["point_id"], round(r["score"], 6)) for r in vector.search_many(points, queries, k, threshold).collect()}
        want = {}
        for q, v in asked:
            scored = [(-round(cosine(v, p), 9), i) for i, p in rows if v is not None and p is not None and len(p) == len(v)]
            best = [x for x in sorted(scored) if threshold <= 0 or -x[0] >= threshold][:k]
            want |= {(q, n + 1): (i, round(-s, 6)) for n, (s, i) in enumerate(best)}
        assert {x: (i, s + 0.0) for x, (i, s) in got.items()} == {x: (i, s + 0.0) for x, (i, s) in want.items()}
    assert vector.search_many(points.limit(0), queries, 3).count() == 0 and vector.search_many(points, queries.limit(0), 3).count() == 0


def test_medians_of_ranges(spark):
    rnd = random.Random(2)
    rows = [(g, [1.0, 0.0], [math.cos(a), math.sin(a)]) for g, n in (("a", 101), ("b", 40), ("c", 1), (None, 7)) for a in (rnd.choice([0.1, rnd.random()]) for _ in range(n))]
    got = {r["g"]: (r["samples"], r["median"]) for r in maintain.vector_median(spark.createDataFrame(rows, "g string, a array<double>, b array<double>").repartition(7), group="g").collect()}
    for g in ("a", "b", "c", None):
        own = sorted(b[0] for x, _, b in rows if x == g)
        assert got[g][0] == len(own) and got[g][1] == pytest.approx(own[len(own) // 2])
    assert maintain.vector_median(spark.createDataFrame([], "a array<double>, b array<double>")).count() == 0


def entries(spark, rows):
    return spark.createDataFrame([(p, f"h{p}", t) for p, t in rows], "path string, sha256 string, updated_at string")


def test_pruning_a_ledger_by_months(spark, tmp_path):
    path = str(tmp_path / "ledger")
    rows = [("2026-08-01/a", "2026-08-02"), ("2026-08-01/b", "2026-10-02"), ("2026-09-05/c", "2026-09-06"), ("2026-09-05/d", "2026-09-06"), ("2026-10-01/e", "2026-10-01"), ("x", None)]
    ledger.append(entries(spark, rows), path)
    there = {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".json")}
    files = spark.createDataFrame([("2026-08-01/a",), ("2026-08-01/b",), ("docs/2026-09-05/c",), ("x",)], "path string")
    assert ledger.prune_files(spark, path, files, ["docs"], dry_run=True) == 2 and ledger.read(spark, path).count() == 6
    assert ledger.prune_files(spark, path, files, ["docs"]) == 2
    assert sorted(r["path"] for r in ledger.read(spark, path).collect()) == ["2026-08-01/a", "2026-08-01/b", "2026-09-05/c", "x"]
    now = {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".json")}
    assert {f for f in there if "month=2026-08" in f or "month=unknown" in f} <= now and not any("month=2026-10" in f for f in now)
    # An entry made late for an old document is in the window, and its folder alone is read.
    recent = ledger.read_window(spark, path, "2026-10-20", 30)
    assert [r["path"] for r in recent.collect()] == ["2026-08-01/b"]
    assert "month#" in recent._jdf.queryExecution().toString().split("PartitionFilters:")[1][:200]
    assert ledger.prune_files(spark, path, files, ["docs"]) == 0


def test_candidates(one):
    where = lambda a: ledger.candidates(a, ["/work", "/work/docs"])
    assert one(where, a="a/b.md") == ["a/b.md", "/work/a/b.md", "/work/docs/a/b.md"]
    assert one(where, a="/work/docs/b.md") == ["/work/docs/b.md", "docs/b.md", "b.md"]


def test_bounded_samples(spark):
    rows = spark.createDataFrame([(f"f{i:03}", "bad" if i % 3 else "good", f"why {i}") for i in range(100)] + [("z", None, None)], "rel string, status string, why string")
    got = {r["status"]: r for r in maintain.sampled_counts(rows, "status", "rel", 4, "why").collect()}
    assert got["bad"]["n"] == 66 and [x["rel"] for x in got["bad"]["samples"]] == ["f001", "f002", "f004", "f005"] and got["bad"]["samples"][0]["why"] == "why 1"
    assert got["good"]["n"] == 34 and got[None]["n"] == 1


def test_postings_are_made_without_a_shuffle(spark):
    """A row's terms are counted where it is read, and filed there."""
    from lodestar.operators import keyword

    docs = spark.createDataFrame([(1, "a b a ü 東京都 b a"), (2, ""), (3, None), (4, "b")], "doc_id long, text string")
    made = keyword.postings(docs)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, made.select("doc_id", "term", "tf", "dl").collect())) == [(1, "a", 3, 8), (1, "b", 2, 8), (1, "ü", 1, 8), (1, "京都", 1, 8), (1, "東京", 1, 8), (4, "b", 1, 1)]
    points = docs.selectExpr("'s' AS source_key", "doc_id AS point_id", "text")
    terms, _ = keyword.point_postings(points, None)
    assert "Exchange" not in terms._jdf.queryExecution().executedPlan().toString() and terms.count() == 6


def test_chunk_batches_are_small(spark):
    """Whatever the session's batches, a Python worker holds few texts at a time."""
    from lodestar.operators import chunking

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "10000")
    try:
        docs = spark.range(3).selectExpr("id AS doc_id", "'a b. c' AS text")
        assert chunking.chunk(docs, "adaptive", 300).count() == 3
        assert int(spark.conf.get(name)) <= 256
    finally:
        spark.conf.set(name, before)


def test_best_of_a_tile():
    """The k best of each row are those of a full stable sort by rounded score, ties by column."""
    import numpy as np

    from lodestar.operators import vector

    rng = np.random.default_rng(1)
    scores = np.round(rng.random((40, 300)), 2) + rng.random((40, 300)) * 1e-10
    scores[7] = 0.5
    for k in (1, 5, 300, 400):
        want = np.argsort(-np.round(scores, vector.DIGITS), axis=1, kind="stable")[:, :k]
        own, at = vector._best(scores, k)
        assert at.reshape(40, -1).tolist() == want.tolist() and own.tolist() == np.repeat(np.arange(40), min(k, 300)).tolist()


def test_many_queries_go_in_waves(spark, monkeypatch):
    """A wave shuffles every point once and its own queries alone, so disk does not grow with points x queries; many queries of one group are dealt to copies of it."""
    monkeypatch.setattr(vector, "PIVOTS", 3)
    monkeypatch.setattr(vector, "BLOCK", 16)
    monkeypatch.setattr(vector, "WAVE", 32)
    rnd = random.Random(3)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(5)]) for i in range(100)]
    asked = [(i, rows[7][1]) for i in range(80)] + [(100 + i, v) for i, v in rows]
    seen, tiles = [], vector._tiles

    def counted(points, queries, *rest):
        seen.append((points.count(), queries.count()))
        return tiles(points, queries, *rest)

    monkeypatch.setattr(vector, "_tiles", counted)
    got = vector.search_many(spark.createDataFrame(rows, "point_id long, vector array<float>"), spark.createDataFrame(asked, "query_id long, vector array<float>"), 3)
    found = {(r["query_id"], r["rank"]): r["point_id"] for r in got.collect()}
    unit = lambda v: [x / math.sqrt(sum(y * y for y in v)) for x in v]
    units = [unit(v) for _, v in rows]
    for q, v in asked:
        scores = [sum(x * y for x, y in zip(unit(v), u, strict=True)) for u in units]
        assert [found[q, n] for n in (1, 2, 3)] == sorted(range(100), key=lambda i: (-round(scores[i], 6), i))[:3]
    assert len(found) == 3 * len(asked) and len(seen) == 1 + math.ceil(len(asked) / 32)
    assert seen[0][0] < 2 * 100 and all(p == 100 for p, _ in seen[1:])
    assert max(q for _, q in seen[1:]) < sum(q for _, q in seen[1:]) / 2
