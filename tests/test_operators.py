import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from lodestar.operators import chunking, filters, fusion, grep, keyword, ledger, maintain, vault, vector
from lodestar.operators.store import Store
from lodestar.sources import settings, websearch


def test_window():
    chunks = chunking.split("a" * 1200, "window", 500, 150)
    assert [len(c) for c in chunks] == [500, 500, 500] and chunks[1][:150] == chunks[0][350:500]
    assert chunking.split("abc") == ["abc"] and chunking.split("") == []
    assert chunking.split("x" * 250, "nope", 100, 20) == chunking.split("x" * 250, "window", 100, 20)


def test_window_column_is_the_same(spark):
    texts = ["", "a" * 499, "b" * 500, "c" * 501, "茶と本の店。" * 200, "d" * 850, "e" * 851]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(chunking.window_column(F.col("t"))).collect()
    assert [r[0] for r in rows] == [chunking.split(t) for t in texts]


def test_strategies():
    assert len(chunking.split("start\n\n# One\ntea\n\n## Two\ncups", "section", 1000)) == 3
    assert len(chunking.split("tea\n\ncup\n\npot\n\n" * 10, "paragraph", 100)) == 30
    assert '"More tea? Now!"' in chunking.split('She sat down. "More tea? Now!" he said. They left.', "dialogue", 200)[0]
    assert chunking.split("A b. C d. E f.", "sentence", 10) == ["A b. C d.", "E f."]
    assert chunking.split("x" * 25 + " y", "adaptive", 10) == ["x" * 10, "x" * 10, "x" * 5, "y"]
    assert chunking.split("one\n\ntwo\n\nthree", "adaptive", 8) == ["one\n\ntwo", "three"]
    for s in chunking.STRATEGIES:
        for c in chunking.split("Alpha beta. Gamma!\n\n" * 40, s, 60, 10):
            assert c and len(c) <= 60


def test_problems(spark):
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(["long enough", " ", "tiny", "long enough"])], "doc_id long, chunk_index int, text string")
    assert sorted((r[1], r[2][:9]) for r in chunking.problems(rows).collect()) == [(1, "blank"), (2, "too short"), (3, "same as c")]


@pytest.fixture(scope="module")
def cards(spark):
    return spark.createDataFrame(
        [("1", [1.0, 0.0, 0.0], "alpha", {"role": "user"}, ["art", "art/jazz"]), ("2", [0.0, 1.0, 0.0], "beta", {"role": "assistant"}, ["people/likes"]), ("3", [1.0, 0.0], "odd", None, None)],
        "point_id string, vector array<float>, text string, metadata map<string,string>, tags_expanded array<string>",
    )


def test_filters(cards):
    pick = lambda c: sorted(r["point_id"] for r in filters.apply_filter(cards, c).collect())
    assert pick(None) == pick({}) == ["1", "2", "3"]
    assert pick({"metadata.role": "user"}) == pick({"must": [{"key": "metadata.role", "match": {"value": "user"}}]}) == ["1"]
    assert pick({"must": [{"key": "tags_expanded", "match": {"prefix": "art"}}]}) == ["1"]
    assert pick({"must": [{"key": "tags_expanded", "match": {"prefix": "ar"}}]}) == []
    assert pick({"ids": "2"}) == ["2"] and pick({"ids": []}) == [] and pick({"ids": ["1"], "text": "beta"}) == []
    assert pick({"nothing": 1}) == []
    assert pick({"ids": [str(i) for i in range(2, 2000)]}) == ["2", "3"]
    assert pick({"must": [{"key": "text", "match": {"value": "beta"}}], "text": "alpha"}) == ["2"]
    with pytest.raises(ValueError):
        filters.compile_filter(cards.schema, {"must": [{"key": "a", "match": {"range": 1}}]})
    assert filters.from_metadata({"a": 1}, {"b": 2}) == {"b": 2}


def test_vectors(cards):
    got = vector.search(cards, [1.0, 0.0, 0.0], 10).collect()
    assert [r["point_id"] for r in got] == ["1", "2"] and got[0]["score"] == pytest.approx(1)
    assert [r["point_id"] for r in vector.search(cards, [1.0, 0.0, 0.0], 10, 0.5).collect()] == ["1"]
    assert [r["point_id"] for r in vector.killed_by_threshold(cards, [1.0, 0.0, 0.0], 10, 0.5).collect()] == ["2"]
    vector.check_dimension(cards, 2)
    with pytest.raises(ValueError):
        vector.check_dimension(cards, 7)


def test_keyword(spark):
    docs = spark.createDataFrame([("a", "駅前の喫茶店で本を読む"), ("b", "zug7 は喫茶店の隣"), ("c", "tea-bar と zug7 の地図"), ("d", None)], "doc_id string, text string")
    assert {r["doc_id"] for r in keyword.search(docs, "zug7").collect()} == {"b", "c"}
    one, two = (keyword.search(docs, q).where("doc_id = 'b'").first()["score"] for q in ("zug7", "zug7 zug7"))
    assert two == pytest.approx(2 * one)
    stored = keyword.search_postings(keyword.postings(docs), keyword.statistics(docs)[1], "zug7 茶店")
    scan = keyword.search(docs, "zug7 茶店")
    assert [(r["doc_id"], pytest.approx(r["score"])) for r in scan.collect()] == [(r["doc_id"], r["score"]) for r in stored.collect()]
    assert keyword.search(docs, "").count() == 0 and keyword.search(docs, "absent").count() == 0


def test_fusion(spark):
    rows = lambda *names: spark.createDataFrame([(n, -float(i)) for i, n in enumerate(names)], "key string, score double")
    out = fusion.fuse([fusion.ranked(rows("alpha", "beta"), ["key"]), fusion.ranked(rows("beta", "gamma"), ["key"])], ["key"]).collect()
    assert [r["key"] for r in out] == ["beta", "alpha", "gamma"]
    assert out[0]["score"] == pytest.approx(1 / 62 + 1 / 61)
    with pytest.raises(ValueError):
        fusion.fuse([], ["key"], method="weighted")
    assert fusion.score_mode("x", -1, 2) == "logit" and fusion.score_mode("x", 0, 1) == "probability" and fusion.score_mode("jina-v2", -1, 2) == "probability"


def test_rerank_failure_is_an_error(spark):
    hits = spark.createDataFrame([("a", "text")], "key string, text string")
    with pytest.raises(Exception, match="down"):
        fusion.rerank(hits, "q", lambda q, t: 1 / 0 if not t else (_ for _ in ()).throw(RuntimeError("down")), ["key"]).collect()


def test_grep(spark):
    docs = spark.createDataFrame([("a", "the brown fox\r\ncode 12\nx\ncode 7"), ("b", "catalog\nthe cat sat\nCAT"), ("c", None)], "path string, text string")
    hit = lambda *a, **k: sorted((r["path"], r["line"]) for r in grep.grep(docs, *a, key="path", **k).collect())
    assert hit("brown fox") == [("a", 1)] and hit(r"code \d+", mode="regex") == [("a", 2), ("a", 4)]
    assert hit("cat", word=True) == [("b", 2), ("b", 3)] and hit("CAT", case=True) == [("b", 3)] and hit("cat") == [("b", 1), ("b", 2), ("b", 3)]
    assert hit("code", per_file=1) == [("a", 2)]
    row = grep.grep(docs, "x", case=True, context=1, key="path").where("path = 'a' and line = 3").first()
    assert row["before"] == ["code 12"] and row["after"] == ["code 7"]
    _, totals = grep.search_documents(docs, "c", limit=1)
    assert totals == {"documents": 2, "total_matches": 5, "truncated": True, "scanned": 3}
    cut = grep.read_lines(docs.where("path = 'b'"), 2, 2).first()["text"]
    assert cut == "the cat sat" and grep.read_lines(docs.where("path = 'b'"), 9).first()["text"] == ""
    with pytest.raises(ValueError):
        grep.grep(docs, "")


def test_vault(spark):
    t = dt.datetime(2026, 10, 16, 1, 2, 3)
    docs = spark.createDataFrame([(1, " body \n", "https://a.com/x", t), (2, "body", "https://b.com", t), (3, "other", None, t), (4, "  ", "u", t)], "doc_id long, text string, url string, fetched_at timestamp")
    known = spark.createDataFrame([("x" * 64, ["u"], t.date())], "sha256 string, urls array<string>, day date")
    first = vault.filed(docs, known).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["status"], r["urls"]) for r in first] == [(1, "new", ["https://a.com/x", "https://b.com"]), (3, "new", [])]
    again = vault.filed(docs, vault.filed(docs, known).select("sha256", "urls", "day"))
    assert {r["status"] for r in again.collect()} == {"refreshed"}
    rules = [("^github\\.com", "code"), ("(", "bad"), ("^arxiv\\.org", "paper")]
    hosts = spark.createDataFrame([("github.com",), ("arxiv.org",), ("x.org",)], "h string")
    assert [r[0] for r in hosts.select(vault.category(rules, F.col("h"), F.lit(""), F.array().cast("array<string>"))).collect()] == ["code", "paper", "_"]


def test_import(spark, tmp_path):
    (tmp_path / "sub" / ".git").mkdir(parents=True)
    (tmp_path / "one.md").write_text("first")
    (tmp_path / "sub" / "two.TXT").write_text("second")
    (tmp_path / "sub" / "raw.bin").write_bytes(b"a\0b")
    (tmp_path / "sub" / ".git" / "x.md").write_text("hidden")
    files = vault.read_folder(spark, str(tmp_path))
    none = spark.createDataFrame([], "raw_sha256 string")
    first = vault.classify_import(files, none)
    assert sorted((r["rel"], r["title"], r["ext"], r["status"]) for r in first.collect()) == [("one.md", "one", ".md", "imported"), ("sub/raw.bin", "raw", ".bin", "binary"), ("sub/two.TXT", "two", ".txt", "imported")]
    assert {r["status"] for r in vault.classify_import(files, first).collect()} == {"unchanged", "binary"}


def test_ledger(spark, tmp_path):
    entries = spark.createDataFrame([("2026-10-01/a", "s1", "2026-10-01T00:00:00Z"), ("2026-10-02/a", "s1", "2026-10-03T00:00:00Z"), ("x", "s2", "2026-09-01T00:00:00Z")], "path string, sha256 string, updated_at string")
    ledger.append(entries, str(tmp_path / "l"))
    (tmp_path / "l" / "month=2026-10" / "bad.json").write_text("{broken\n{}\n")
    back = ledger.read(spark, str(tmp_path / "l"))
    assert back.count() == 3
    assert sorted(r["path"] for r in ledger.current(back).collect()) == ["2026-10-02/a", "x"]
    assert [r["path"] for r in ledger.window(back, "2026-10-20 00:00:00").collect()] == ["2026-10-02/a", "2026-10-01/a"]
    files = spark.createDataFrame([("x",), ("y",)], "path string")
    assert sorted(tuple(r) for r in ledger.verify(back, files).collect()) == [("missing_file", "2026-10-01/a"), ("missing_file", "2026-10-02/a"), ("unlisted_file", "y")]
    assert [r["path"] for r in ledger.pruned(back, files).collect()] == ["x"]


def test_legacy(spark):
    docs = spark.createDataFrame([("# Title\n\n- source: http://a\n- provider: tavily\n\n## Own heading\nbody",), ("no header",)], "text string")
    a, b = ledger.parse_legacy(docs).collect()
    assert (a["title"], a["source"], a["provider"], a["body"]) == ("Title", "http://a", "tavily", "## Own heading\nbody")
    assert b["title"] == "" and b["body"] == "no header"


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    rows = lambda *r: spark.createDataFrame([(i, "k", s, t, {"r": s}) for i, s, t in r], "point_id string, source_key string, source_file string, text string, metadata map<string,string>")
    store.upsert("c", rows(("7", "a", "v1")))
    store.upsert("c", rows(("7", "a", "v2"), ("8", "b", "w")))
    assert sorted((r["point_id"], r["text"]) for r in store.read("c").collect()) == [("7", "v2"), ("8", "w")]
    store.set_payload("c", {"x": "1"}, {"source_file": "a"})
    assert store.count("c", {"metadata.x": "1"}) == 1
    store.rename_sources("c", {"a": "moved/a"})
    assert store.count("c", {"source_file": "moved/a"}) == 1
    assert store.delete("c", {"source_file": "b"}) == 1 and store.names() == ["c"]
    with pytest.raises(ValueError):
        store.delete("c", None)
    assert store.delete("c", {}, allow_all=True) == 1 and store.read("c").count() == 0
    assert store.vacuum("c") >= 4
    with pytest.raises(KeyError, match="did you mean c"):
        store.read("C")
    with pytest.raises(ValueError):
        store.create("../x")
    with pytest.raises(ValueError):
        store.drop("c")
    store.drop("c", True)
    assert store.names() == []


def test_maintenance(spark):
    points = spark.createDataFrame([("c", "a", [1.0]), ("c", "a", [1.0, 2.0]), ("c", "z", None)], "collection string, source_file string, vector array<float>")
    catalog = spark.createDataFrame([("c", "a", 3), ("c", "e", 0), ("c", "m", 2)], "collection string, source_file string, chunks int")
    issues = maintain.verify_structure(catalog, points, 1)
    assert sorted((r["kind"], r["source"]) for r in issues.collect()) == [("bad_index", "z"), ("count_mismatch", "a"), ("dim_mismatch", "a"), ("empty_source", "e"), ("missing_index", "m"), ("orphan_dir", "z")]
    assert [tuple(r) for r in maintain.roll_up(issues, catalog).collect()] == [("c", False, 6)]
    assert tuple(maintain.claimed_and_loaded(catalog, points).first()) == (5, 3, False)
    maintain.check_provenance({"embed_model": "A", "vector_dim": None}, {"embed_model": "a", "vector_dim": 3})
    with pytest.raises(ValueError, match="vector_dim"):
        maintain.check_provenance({"vector_dim": 2}, {"vector_dim": 3})


REPLIES = {
    "deepseek": ({"results": [{"title": "", "site_name": "Site", "url": "http://a", "date": "2026-10-16", "authority": 2, "rerank_score": 0.5}, {"title": "x", "url": " "}]}, [("Site", "http://a", "2026-10-16 00:00:00", 2, 0.5)]),
    "tavily": ({"results": [{"title": "T", "url": "http://a", "raw_content": "16 Oct 2026", "score": 0.25}]}, [("T", "http://a", "2026-10-16 00:00:00", -1, 0.25)]),
    "firecrawl": ({"success": True, "data": {"web": [{"url": "http://a", "title": "T", "description": "on 2026-10-16"}], "news": [{"url": "http://b", "title": "N", "date": "2026-10-17"}]}}, [("T", "http://a", "2026-10-16 00:00:00", -1, 0.0), ("N", "http://b", "2026-10-17 00:00:00", -1, 0.0)]),
    "searxng": ({"results": [{"url": "http://a", "title": "A"}, {"url": ""}, {"url": "http://c", "title": "C", "score": 3}, {"url": "http://d"}]}, [("A", "http://a", None, -1, 1.0), ("C", "http://c", None, -1, 3.0)]),
}


@pytest.mark.parametrize("name", REPLIES)
def test_websearch(spark, name):
    reply, want = REPLIES[name]
    hits = websearch.search(spark, name.upper(), "q", count=2, response=json.dumps(reply))
    got = hits.orderBy("rank").select("title", "url", F.col("published_at").cast("string"), "authority", "score").collect()
    assert [tuple(r) for r in got] == want


def test_websearch_requests():
    q = websearch.Query("news", 99, 7, options={"api_key": "k", "base_url": "http://s/"})
    assert websearch.tavily_request(q).body["max_results"] == 20 and websearch.tavily_request(q).body["time_range"] == "week"
    assert websearch.firecrawl_request(q).body["tbs"] == "qdr:w" and websearch.firecrawl_request(q).body["limit"] == 50
    assert websearch.deepseek_request(q, dt.datetime(2026, 10, 20)).body["query"] == "news after:2026-10-13"
    assert "time_range=month" in websearch.searxng_request(q).url
    with pytest.raises(ValueError, match="api key"):
        websearch.tavily_request(websearch.Query("x"))
    with pytest.raises(ValueError, match="unknown provider"):
        websearch.service("bing")


def test_settings(tmp_path):
    s = settings.Settings().patched(safesearch=9, top_k=-1, country=" de ", rerank=None)
    assert (s.safesearch, s.top_k, s.country, s.rerank) == (2, 0, "DE", True)
    settings.save(s, str(tmp_path / "s.json"))
    assert settings.load(str(tmp_path / "s.json")) == s and settings.load(str(tmp_path / "none")) == settings.Settings()
    with pytest.raises(ValueError):
        s.patched(nope=1)
    with pytest.raises(ValueError):
        s.patched(fusion_method="weighted")
