"""Spelling variants, conversation tries and the MinHash inverted join against plain versions."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from lodestar.llm import minhash_join, spelling, trie


def plain_words(rows):
    out = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if h % 199 == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            out[word] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_groups(rows):
    words, out = plain_words(rows), {}
    for w, n in words.items():
        near = [x for x in words if one_edit(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        form = best if best is not None and words[best] >= 5 * n else None
        out[w] = [form, w, n, len(near), words[form] if form else None]
    for w, row in out.items():
        while out[row[1]][0] is not None:
            row[1] = out[row[1]][0]
    return {w: tuple(r) for w, r in out.items()}


def test_spelling_variants(spark):
    rnd = random.Random(3)
    bases = ["".join(rnd.choice("abcdéü÷Àz") for _ in range(rnd.randint(6, 9))) for _ in range(60)]
    bases += ["tracks", "tracts", "racks", "stacks", "crates", "crate", "caters", "reacts", "xxxxxx", "xxxxxxx", "a" * 3_000, "a" * 3_001, "a" * 1_500 + "b" + "a" * 1_499]

    def changed(w):
        i = rnd.randrange(len(w))
        return rnd.choice([w[:i] + w[i + 1 :], w[:i] + rnd.choice("abé") + w[i + 1 :], w[:i] + rnd.choice("abé") + w[i:]])

    words = [(b, 200 if len(b) < 20 else 30) for b in bases] + [(x, n) for b in bases for x, n in ((changed(b), 20), (changed(changed(b)), 5), (changed(b), 7)) if len(b) < 20]
    heap = [rnd.choice([w, w.upper() if w.isascii() else w]) for w, n in words for _ in range(n)]
    heap += ["gggggg"] * 900 + ["gggggh"] * 120 + ["ggggih"] * 15
    rnd.shuffle(heap)
    rows = [(i if i % 13 else None, " ".join(heap[k : k + 40])) for i, k in enumerate(range(0, len(heap), 40))]
    rows += [(1, None), (2, ""), (3, "1 2 3 --"), (4, "short"), rows[5], rows[5]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS key", "3 AS word", "4 AS form")
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.group(docs).collect()}
    want = plain_groups(rows)
    assert got == want
    assert sum(r[0] is not None for r in want.values()) > 50 and any(r[1] != r[0] for r in want.values() if r[0])
    assert spelling.group(docs.limit(0)).count() == 0 and spelling.group(docs.where("text is null")).count() == 0


def test_spelling_ties_and_anagrams(spark):
    """Of near words of one count the smallest is the form; an anagram that is not one edit away is not near."""
    text = " ".join(["zaaaaa"] * 50 + ["baaaaa"] * 50 + ["aaaaaa"] * 10 + ["listen"] * 50 + ["silent"] * 5 + ["listne"] * 5)
    rows = [(7, text)]
    got = {r["word"]: r for r in spelling.group(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    if set(got) == {"zaaaaa", "baaaaa", "aaaaaa", "listen", "silent", "listne"}:
        assert got["aaaaaa"]["form"] == "baaaaa" and got["silent"]["form"] is None and got["listne"]["n_near"] == 0
    assert {w: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for w, r in got.items()} == plain_groups(rows)


def plain_trie(rows):
    """(conv_id, depth, parent, n_convs, n_children, n_leaves, saved, ends) of rows (conv_id, turn, role, text)."""
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(ts, key=lambda t: t[0])] for c, ts in own.items()}
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        built = own.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])[:h] + own[c][h:]
        for d in range(len(built) + 1):
            members[tuple(built[:d])].append(c)
        ends[tuple(built)].append(c)
    leaves, saved, children = collections.Counter(), collections.Counter(), collections.Counter(p[:-1] for p in members if p)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1]) if p else 0)
    digest = lambda p: hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()
    return sorted((m[0], len(p), members[p[:-1]][0] if p else -1, len(m), children[p], leaves[p], saved[p], digest(p)) for p, m in members.items())


def trie_rows(df):
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-1 if c == "parent_conv_id" and r[c] is None else r[c] for c in cols) for r in df.collect())


@pytest.mark.parametrize("tasks", [1, 40])
def test_conversation_trie(spark, monkeypatch, tasks):
    """Many short runs, tasks that split copies of one conversation, long and odd conversations."""
    monkeypatch.setattr(trie, "RUN_ROWS", 7)
    monkeypatch.setattr(trie, "TASK_BYTES", 1 << 30 if tasks == 1 else 500)
    rnd = random.Random(tasks)
    rows = []
    for c in range(-150, 420):
        if c % 100 == 0 and c == 300:
            continue
        if c % 3 == 0:
            turns = [("user", "hello"), ("assistant", "hi é"), ("user", "bye")]
        else:
            turns = [(rnd.choice(["user", "assistant"]), rnd.choice(["a", "bb", "", "ccc é"])) for _ in range(rnd.randint(1, 9))]
        rows += [(c, i, *t) for i, t in enumerate(turns)]
    rows += [(401, i, "user", "x" * (i % 5)) for i in range(20, 700)] + [(402, None, "user", "first"), (403, 99, None, None), (403, 98, "user", None), (None, 1, "user", "lost")]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS path", "2 AS depth", "3 AS seq").repartition(5)
    assert trie_rows(trie.prefix_trie(docs)) == plain_trie(rows)
    assert trie.prefix_trie(docs.limit(0)).count() == 0


def test_trie_of_copies(spark, monkeypatch):
    """A group of copies that many tasks share, with one hash of all their ids."""
    monkeypatch.setattr(trie, "TASK_BYTES", 2000)
    rows = [(c, t, "user", "same") for c in range(1, 600) for t in range(8)]
    assert trie_rows(trie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))) == plain_trie(rows)


def test_merge_compares_turns_once():
    """The merge puts rows in order with right LCPs and looks at few shared turns again."""
    rnd = random.Random(1)
    seqs = [b"".join(bytes([rnd.choice(b"ab")]) * trie.CODE for _ in range(rnd.randint(0, 30))) for _ in range(2000)]
    rows, pieces = [(s, i) for i, s in enumerate(seqs)], []
    for k in range(7):
        own = sorted(rows[k::7])
        pieces.append(trie.Piece([(trie.common(own[i - 1][0], s) if i else 0, s, [], c) for i, (s, c) in enumerate(own)]))
    out = list(trie.merged(pieces))
    assert [(s, c) for _, s, _, c in out] == sorted(rows)
    assert [n for n, *_ in out] == [0] + [trie.common(a[1], b[1]) for a, b in zip(out, out[1:], strict=False)]


def plain_near(rows):
    """doc_id, n_shingles, component_id, kept of each row, all pairs compared."""
    sets = []
    for _, text in rows:
        w = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 85 * len(a | b):
            root[top(i)] = top(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least.setdefault(top(i), []).append(doc)
    named = {r: min((d for d in ds if d is not None), default=None) for r, ds in least.items()}
    return collections.Counter((doc, len(sets[i]), named[top(i)], doc == named[top(i)]) for i, (doc, _) in enumerate(rows))


def near_rows(df):
    return collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect())


def test_minhash_join(spark, monkeypatch):
    """Copies, near copies at and below the threshold, a crowd with a common passage, in tiles and blocks of few rows."""
    monkeypatch.setattr(minhash_join, "TILE", 16)
    monkeypatch.setattr(minhash_join, "BLOCK", 3000)
    monkeypatch.setattr(minhash_join, "CHUNK", 1500)
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdeéñ") for _ in range(rnd.randint(2, 7)))
    base, passage = [word() for _ in range(220)], [word() for _ in range(150)]

    def edited(ws, n):
        ws = list(ws)
        for _ in range(n):
            ws[rnd.randrange(len(ws))] = word()
        return ws

    texts = [" ".join(edited(base, k % 12)) for k in range(90)] + [" ".join(passage + [word() for _ in range(30)]) for _ in range(60)]
    chain = [[word() for _ in range(200)]]
    for _ in range(25):
        chain.append(edited(chain[-1], 2))
    texts += [" ".join(c) for c in chain] + [" ".join(base)] * 40 + ["\t ".join(base).upper()] * 3
    texts += ["one two three", "One  two\nthree", "three two one", "a b c d e", "a b c d e f", "", "  \n", "x" * 50_000, "x y " * 30_000, "x y z\x0bw v u t", "Été é", "été é"]
    rows = [(i if i % 17 else None, t) for i, t in enumerate(texts)] + [(3, None), (5, texts[5]), (5, texts[5]), (5, texts[120])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS rid", "2 AS size", "3 AS key", "4 AS component_id").repartition(6)
    want = plain_near(rows)
    assert near_rows(minhash_join.near_groups(docs)) == want
    assert minhash_join.near_groups(docs.limit(0)).count() == 0 and minhash_join.near_groups(docs.where("text is null")).count() == 1


def test_minhash_steps_are_bounded(spark):
    """A crowd of near copies is settled by hubs: no list is left to count, and rows stay below those of the postings."""
    rnd = random.Random(2)
    base = [str(rnd.random()) for _ in range(300)]
    rows = [(i, " ".join(base[:k] + ["new", str(i)] + base[k + 1 :])) for i in range(400) for k in [rnd.randrange(300)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sigs = minhash_join.signatures(docs)
    postings = minhash_join.prefixes(sigs)
    assert postings.count() <= 400 * (minhash_join.COORDS - minhash_join.MATCHES + 1)
    pairs = minhash_join.hub_pairs(postings.withColumn("comp", postings["rid"]), sigs)
    assert 390 <= pairs.count() <= 400
    assert {r["component_id"] for r in minhash_join.near_groups(docs).collect()} == {0}


def test_signature_estimates_likeness():
    rnd = random.Random(4)
    for share in (0.5, 0.85, 0.95):
        agree = []
        for _ in range(60):
            words = [str(rnd.random()) for _ in range(400)]
            n = int(400 * share)
            a = minhash_join._mixed(np.array([hash(w) & (1 << 63) - 1 for w in words[: (400 + n) // 2]], np.uint64))
            b = minhash_join._mixed(np.array([hash(w) & (1 << 63) - 1 for w in words[(400 - n) // 2 :]], np.uint64))
            agree.append((minhash_join.signature(a) == minhash_join.signature(b)).mean())
        assert abs(np.mean(agree) - share) < 0.04


def test_spelling_gathers_no_table_of_words(spark):
    """However small the files of the tables of words are, no join of them is broadcast."""
    docs = spark.createDataFrame([(i, "parlament parlamen parlaments regierung regierunk " * 6) for i in range(4)], "doc_id long, text string")
    out = spelling.group(docs)
    assert out.count() > 0
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in spelling.near_words(docs.selectExpr("text AS word", "doc_id AS n"))._jdf.queryExecution().executedPlan().toString()
