"""WARC round trips, fingerprints, top-k search and license scans against plain versions."""

import collections
import hashlib
import io
import math
import random
import re
import tracemalloc

import numpy as np
import pytest

from lodestar.llm import fingerprints, licenses, topk, warc

PAGES = [(1, "http://a", "x" * 1200), (2, "http://b", "x" * 1200), (3, None, "x" * 1200), (4, "u", None), (5, "u", ""), (6, "http://é\r\nX: 1", "é" * 700), (7, "u", "small"), (8, "u", "small"), (None, "u", "y" * 2000), (9, "u", "y" * 2000), (9, "u", "y" * 2000)]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS payload")
    got = collections.Counter(tuple(r) for r in warc.round_trip(spark, pages).collect())
    want = collections.Counter()
    for i, _, html in PAGES:
        raw = (html or "").encode()
        same = [k for k, _, h in PAGES if (h or "").encode() == raw and k is not None]
        refers = max(same) if len(raw) >= 1000 and i != max(same) else None
        want[(i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if refers else "response", refers)] += 1
    assert got == want
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


def test_warc_reader_refuses_damage():
    good = warc.record_bytes(1, "u", b"<html>", hashlib.sha1(b"<html>").hexdigest(), None)
    [record] = warc.members(io.BytesIO(good))
    assert warc.parse_record(record)["payload"] == b"<html>"
    assert len(list(warc.members(io.BytesIO(good * 3), chunk=7))) == 3
    for bad in (record.replace(b"<html>", b"<htm1>"), record[:-4], record.replace(b"WARC/1.1", b"X")):
        with pytest.raises(ValueError):
            warc.parse_record(bad)
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(good[:-5])))


def test_fingerprints(spark):
    rnd = random.Random(2)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = [(i if i % 9 else None, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(1, 300)))) for i in range(1, 80)] + [(100, None), (101, ""), (102, "!! ??"), (103, "z " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS part", "1 AS role")
    got = fingerprints.with_neighbours(docs).toPandas()
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    terms = lambda t: collections.Counter(re.findall(r"\w+", t.lower()))
    off = []
    left = collections.defaultdict(list)
    for r in got.itertuples():
        left[(-1 if r.doc_id != r.doc_id else int(r.doc_id), r.n_chars, r.edited_sha256)].append(r)
    for (i, t), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        edited = t[: len(t) - len(t) // 3] + following[: len(t) // 3]
        r = left[(-1 if i is None else i, len(t), hashlib.sha256(edited.encode()).hexdigest())].pop()
        for near, other in ((r.near_edited, edited), (r.near_next, following)):
            a, b = terms(t), terms(other)
            off.append(near - (sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0))
    assert not any(left.values()) and abs(np.mean(off)) < 0.02 and np.std(off) < 0.08
    assert len(got) == len(rows) and fingerprints.with_neighbours(docs.limit(0)).count() == 0
    alone = fingerprints.with_neighbours(docs.limit(1)).first()
    assert alone["near_next"] == 1.0
    s = fingerprints.Sampler.of()
    assert fingerprints.shown(s.of_text("a b a")) == fingerprints.shown(s.of_text("B a A")) and fingerprints.shown(s.of_text("")) == ""
    long = collections.Counter({f"t{i}": 1 + i % 3 for i in range(20_000)})
    assert fingerprints.likeness(s.sample(long), s.sample(long)) == 1.0


def bm25(docs, query, k):
    tf = {j: collections.Counter(topk.tokens(t)) for j, (_, t) in enumerate(docs)}
    size = {j: sum(c.values()) for j, c in tf.items()}
    mean, n = sum(size.values()) / len(docs), len(docs)
    df = collections.Counter(w for c in tf.values() for w in c)
    score = {j: sum(q * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * size[j] / mean)) for w, q in collections.Counter(topk.tokens(query)).items() if w in c) for j, c in tf.items()}
    best = sorted((j for j in score if score[j] > 0), key=lambda j: (-round(score[j], 6), docs[j][0] is None, docs[j][0] or 0))[:k]
    return [(docs[j][0], round(score[j], 6)) for j in best]


@pytest.mark.parametrize("shard", [3, 50, 8192])
def test_topk(spark, monkeypatch, shard):
    monkeypatch.setattr(topk, "SHARD_DOCS", shard)
    rnd = random.Random(shard)
    vocabulary = [f"w{int(rnd.expovariate(0.05))}" for _ in range(400)]
    rows = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(0, 80)))) for i in range(180)]
    rows += [(200 + i, rows[5][1]) for i in range(15)] + [(300, None), (301, ""), (None, rows[5][1]), (302, "unique " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS lang", "2 AS score")
    asked = [(5, rows[5][1] + " w1 w1"), (7, rows[7][1]), (8, ""), (9, None), (10, "absent"), (11, "unique w3")]
    got = collections.defaultdict(list)
    for r in topk.search(docs, spark.createDataFrame(asked, "doc_id long, text string"), 10, order="lang").orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["doc_id"], r["score"]))
    for i, q in asked:
        assert [(d, pytest.approx(s, abs=2e-6)) for d, s in got[i]] == bm25(rows, q, 10)
    if shard == 50:
        assert topk.search(docs.limit(0), docs.limit(2), 3).count() == 0 and topk.search(docs, docs.limit(0), 3).count() == 0


def test_topk_skips_postings():
    """Blocks below the pivot are not read, and what is read gives the same best documents as all postings."""
    # A block's documents have a topic; a query has three words of one topic and two common ones.
    rng = np.random.default_rng(3)
    topic = lambda j: rng.choice(100, 30, replace=False) + 1000 + 100 * (j // topk.BLOCK)
    common = lambda n: rng.choice(200, n, replace=False) + 1
    docs = [np.sort(np.concatenate([topic(j), common(30)])).astype(np.uint64) for j in range(4096)]
    lengths = np.array([len(d) for d in docs])
    names, own = np.concatenate(docs), np.repeat(np.arange(len(docs), dtype=np.int32), lengths)
    by = np.argsort(names, kind="stable")
    terms, starts = np.unique(names[by], return_index=True)
    row = {"ids": np.arange(len(docs)), "lengths": lengths, "terms": terms, "starts": np.append(starts, len(by)), "docs": own[by], "tfs": np.ones(len(by), np.int32)}
    shard = topk.Shard({k: v.tobytes() for k, v in row.items()}, float(lengths.mean()))
    asked, all_postings = [np.sort(np.concatenate([topic(i)[:3], common(2)])).astype(np.uint64) for i in range(0, 4096, 97)], 0
    for q in asked:
        weights = 1 + (q % 7).astype(float)
        (at, scores), = shard.search(np.array([0, len(q)]), q, weights, 10, np.zeros(1))
        full = np.zeros(len(docs))
        for t, w in zip(q, weights, strict=True):
            span = slice(shard.term_runs[np.searchsorted(terms, t)], shard.term_runs[np.searchsorted(terms, t) + 1])
            posts = slice(shard.run_start[span.start], shard.run_start[span.stop])
            full[shard.docs[posts]] += shard.gain[posts] * w
            all_postings += posts.stop - posts.start
        full = np.round(full, topk.DIGITS)
        want = np.lexsort((np.arange(len(docs)), -full))[:10]
        assert at.tolist() == want.tolist() and scores.tolist() == full[want].tolist()
    assert shard.read < all_postings / 2


def test_licenses(spark):
    phrases = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

    def plain(t):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        places = [(i, label) for p, label in phrases for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        return len(words), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted({x for _, x in places}))

    rnd = random.Random(4)
    vocabulary = "under the mit license apache version 2 cc by nc UNDER The MIT, é licénse gnu general public 3 \x7f".split(" ")
    rows = [(i if i % 7 else None, t) for i, t in enumerate([None, "", "cc by nc cc by nc", "cc by nc " * 3000, "a" * 50_000, "This work is licensed under the GNU General Public License, version 3."] + [" ".join(rnd.choice(vocabulary) for _ in range(150)) for _ in range(60)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS words", "3 AS label")
    out = licenses.find(docs).collect()
    assert collections.Counter(tuple(r)[:6] for r in out) == collections.Counter((i, *plain(t or "")) for i, t in rows)
    assert next(r for r in out if r["doc_id"] == 5)["labels"] == "gpl-3" and all(0 <= r["score"] <= 1 for r in out)
    assert licenses.find(docs.limit(0)).count() == 0


def test_license_labels(spark):
    """The method's labels and scores against every template compared at every place."""
    rnd = random.Random(9)
    templates = licenses._templates()
    texts = ["GNU Lesser General Public License Version 2.1", "Mozilla Public License Version 2.0", "word " * 40 + "This is free and very unencumbered software", "", None]
    for label, base, words, at, size in templates:
        for edits in (0, 1, 3):
            copy = list(words)
            for _ in range(edits if len(copy) > 3 else 0):
                copy[(k := rnd.randrange(max(1, len(copy)))) : k + 1] = ["odd"] * rnd.randrange(3) if rnd.random() < 0.5 else []
            texts.append(" ".join(["begin"] * rnd.randrange(3) + copy + ["end"] * rnd.randrange(3)))
    texts.append(" ".join(texts[5:]) + " cc by nc" * 20_000)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scanned = licenses.scan(docs)
    idf = licenses.weights(scanned)
    got = {r["doc_id"]: r for r in licenses.find(docs).collect()}

    def plain(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
        there = lambda i, w: 0 <= i < len(words) and words[i] == w
        labels, best = set(), 0.0
        for label, base, want, at, size in templates:
            for i in (j - at for j, w in enumerate(words) if w == want[at]):
                if all(there(i + k, want[k]) for k in range(at, at + size)):
                    score = 1.0 if base else sum(idf[w] for k, w in enumerate(want) if any(there(i + k + d, w) for d in range(-2, 3))) / sum(idf[w] for w in want)
                    if base or score >= licenses.COVER:
                        labels.add(label)
                        best = max(best, score)
        return ",".join(sorted(labels)), best

    for i, text in enumerate(texts[:-1]):
        labels, best = plain(text)
        assert got[i]["labels"] == labels and got[i]["score"] == pytest.approx(best, abs=1e-8), (i, text)
    assert got[len(texts) - 1]["n_base"] >= 20_000


def test_archives_of_others(spark, tmp_path):
    """Records without digests, of other kinds and with other ids are read; damaged ones are rows with an error; long ones are bounded."""
    import gzip

    def record(kind, block, *more, length=None):
        head = ["WARC/1.0", f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:12>", f"Content-Length: {len(block) if length is None else length}", *more]
        return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")

    http = b"HTTP/1.1 200 OK\r\n\r\nbody"
    right = "WARC-Payload-Digest: sha256:" + hashlib.sha256(b"body").hexdigest()
    file = record("warcinfo", b"x: y") + record("response", http, right) + record("response", http, "WARC-Block-Digest: sha1:AAAA") + record("response", http, length=3) + gzip.compress(b"junk") + record("response", http, "WARC-Payload-Digest: other:1")
    (tmp_path / "a.warc.gz").write_bytes(file + b"no gzip")
    rows = warc.read_archives(spark, spark.createDataFrame([(f"file://{tmp_path}/a.warc.gz",)], "archive string")).collect()
    assert [(r["record_type"], r["payload"], r["error"] is None) for r in rows] == [("warcinfo", None, True), ("response", b"body", True), (None, None, False), (None, None, False), (None, None, False), ("response", b"body", True), (None, None, False)]
    assert rows[1]["payload_digest"] == rows[5]["payload_digest"] == hashlib.sha1(b"body").hexdigest() and rows[1]["page_id"] is None
    big = gzip.compress(b"0" * 5_000_000)
    assert [None if m is None else len(m) for m in warc.members(io.BytesIO(big + gzip.compress(b"1") + big), chunk=1000, largest=4_999_999)] == [None, 1, None]
    assert [len(m) for m in warc.members(io.BytesIO(big), chunk=1000, largest=5_100_000)] == [5_000_000]


def test_topk_of_many_queries_at_once():
    """Queries that a shard answers together, frequent terms as matrix products, get the exact scores that each gets alone."""
    rng = np.random.default_rng(5)
    docs = [np.unique(np.minimum(rng.zipf(1.3, 60), 5000)).astype(np.uint64) for _ in range(700)]
    names, own = np.concatenate(docs), np.repeat(np.arange(len(docs), dtype=np.int32), [len(d) for d in docs])
    by = np.argsort(names, kind="stable")
    terms, starts = np.unique(names[by], return_index=True)
    row = {"ids": np.arange(len(docs)), "lengths": np.array([len(d) for d in docs]), "terms": terms, "starts": np.append(starts, len(by)), "docs": own[by], "tfs": rng.integers(1, 4, len(by)).astype(np.int32)}
    shard = topk.Shard({k: v.tobytes() for k, v in row.items()}, 40.0)
    assert len(shard.best[0]) > 10 and topk.TOGETHER < 300
    asked = docs[:300]
    weights = [1 / np.sqrt(q.astype(float)) for q in asked]
    full = np.zeros((len(asked), len(docs)))
    for i, (q, w) in enumerate(zip(asked, weights, strict=True)):
        for t, x in zip(q, w, strict=True):
            span = slice(*starts[np.searchsorted(terms, t) :][:2]) if t != terms[-1] else slice(starts[-1], None)
            full[i, own[by][span]] += shard.gain[span] * x
    full = np.round(full, topk.DIGITS)
    best = [np.lexsort((np.arange(len(docs)), -f))[:10] for f in full]
    for least in (np.zeros(300), np.array([f[b[5]] for f, b in zip(full, best, strict=True)])):
        got = shard.search(np.concatenate([[0], np.cumsum([len(q) for q in asked])]), np.concatenate(asked), np.concatenate(weights), 10, least)
        for (at, scores), f, b, x in zip(got, full, best, least, strict=True):
            want = b[(f[b] > 0) & (f[b] >= x)]
            assert at.tolist() == want.tolist() and scores.tolist() == f[want].tolist()


def test_a_full_shard_fits_a_workers_memory():
    """A shard as large as the bounds allow, made ready: less than 200 MB, for 3000 MB hold two workers beside the JVM."""
    rng, per = np.random.default_rng(8), topk.SHARD_POSTINGS // topk.SHARD_DOCS
    names = np.concatenate([rng.choice(3000, per, replace=False) for _ in range(topk.SHARD_DOCS)]).astype(np.uint64)
    own, by = np.repeat(np.arange(topk.SHARD_DOCS, dtype=np.int32), per), np.argsort(names, kind="stable")
    terms, starts = np.unique(names[by], return_index=True)
    row = {"ids": np.arange(topk.SHARD_DOCS), "lengths": np.full(topk.SHARD_DOCS, per), "terms": terms, "starts": np.append(starts, len(by)), "docs": own[by], "tfs": np.ones(len(by), np.int32)}
    row = {k: v.tobytes() for k, v in row.items()}
    del names, own, by
    tracemalloc.start()
    shard = topk.Shard(row, float(per))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(shard.dense) == shard.blocks and peak < 200e6, peak
