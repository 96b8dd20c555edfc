"""Packing and SentencePiece against the libraries themselves."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestar.llm import packing, pieces

VOCABULARY, MODEL = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "a", "Hello, World! don't I'LL", "<|endoftext|> x<|startoftext|>y 12 ½", "é́ ça İSTANBUL ΟΔΟΣ", "a\x1cb\x1d\x85c", "你好 世界", "▁ a ▁▁", "word " * 9000, "x" * 20000, "tab\tnl\n\n  end "]


@pytest.fixture(scope="module")
def words():
    return packing.WordIds.of(VOCABULARY)


def ids_of(words, text):
    return np.frombuffer(words.encode([text])[0], "<u4").tolist()


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_ids_are_the_librarys(text):
    words = packing.WordIds.of(VOCABULARY)
    assert ids_of(words, text) == words.library.encode(text, add_special_tokens=False).ids


def test_ids_of_known_texts(words):
    for t in TEXTS:
        assert ids_of(words, t or "") == words.library.encode(t or "", add_special_tokens=False).ids


def test_sum_of_squares_places_where_the_squares_become_smallest():
    lengths = sorted(np.random.default_rng(1).integers(1, 64, 400).tolist(), reverse=True)
    bins, offsets = packing.sum_of_squares(lengths, 64)
    gaps: dict[int, int] = {}
    for s, b, o in zip(lengths, bins, offsets, strict=True):
        assert o == 64 - gaps.get(b, 64)
        count = lambda extra: sum(v * v for v in np.bincount([g for g in extra if g]).tolist())
        best = min(count([*(g for i, g in gaps.items() if i != k), gaps.get(k, 64) - s]) for k in [*(i for i, g in gaps.items() if g >= s), max(gaps, default=-1) + 1])
        gaps[b] = gaps.get(b, 64) - s
        assert gaps[b] >= 0 and count(gaps.values()) == best
    assert max(bins) + 1 <= -(-sum(lengths) // 64) * 1.1 + 1


@pytest.mark.parametrize("shard", [16, 1000])
def test_packing_is_whole(spark, words, shard):
    rows = [(i if i % 5 else None, t) for i, t in enumerate(TEXTS * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS piece", "'x' AS length")
    stored = packing.materialize(packing.tokenize_pieces(docs, VOCABULARY, with_ids=False), "t")
    got = packing.pack(stored, shard_pieces=shard).toPandas()
    want = sorted((-1 if i is None else i, k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())) for i, t in rows for ids in [[*words.library.encode(t or "", add_special_tokens=False).ids, 1]] for k, (s, n) in enumerate(packing.cut(len(ids))))
    assert sorted(zip(got["doc_id"].fillna(-1).astype(int), got["piece"], got["start"], got["length"], got["ids_crc32"], strict=True)) == want
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own["offset"].tolist() == [0, *own["length"].cumsum().tolist()[:-1]] and own["length"].sum() <= packing.SEQUENCE
    assert packing.pack_documents(docs.limit(0), VOCABULARY).count() == 0


def test_sequences_hold_the_ids(spark, words):
    docs = spark.createDataFrame([(1, "one two"), (2, "three")], "doc_id long, text string")
    places = packing.pack_documents(docs, VOCABULARY)
    parts = {d: b for r in packing.sequences(docs, places, VOCABULARY).collect() for d, b in zip(r["doc_ids"], r["ids"], strict=True)}
    assert np.frombuffer(bytes(parts[1]), "<u4").tolist() == [*ids_of(words, "one two"), 1]
    # Null and repeated ids and rows: every place has the ids of its own text.
    rows = [(None, "one"), (None, "two"), (3, "three"), (3, "four"), (3, "four")]
    odd = spark.createDataFrame(rows, "doc_id long, text string")
    got = [bytes(b) for r in packing.sequences(odd, packing.pack_documents(odd, VOCABULARY), VOCABULARY).collect() for b in r["ids"]]
    assert sorted(got) == sorted(np.array([*ids_of(words, t), 1], "<u4").tobytes() for _, t in rows)


def test_pieces_cover_the_text(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").selectExpr("*", "1 AS ids")
    encoder = pieces.Encoder.of(MODEL)
    for r in pieces.encode_documents(docs, MODEL).collect():
        t = TEXTS[r["doc_id"]] or ""
        raw = t.encode()
        assert r["ids"] == encoder.library.encode(t) and r["decoded"] == encoder.library.decode(r["ids"])
        if raw:
            assert r["starts"][0] == 0 and r["ends"][-1] == len(raw) and r["starts"][1:] == r["ends"][:-1]
            shown = [encoder.library.id_to_piece(i) for i in r["ids"]]
            for p, a, b in zip(shown[1:], r["starts"][1:], r["ends"][1:], strict=True):
                if not p.startswith("<0x"):
                    assert raw[a:b].decode() == p.replace("▁", " ") or "▁" in raw[a:b].decode()
    for r in pieces.encode_digests(docs, MODEL).collect():
        ids = encoder.library.encode(TEXTS[r["doc_id"]] or "")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(encoder.library.decode(ids).encode()).hexdigest()


def _map(rules: dict[bytes, bytes]) -> bytes:
    """A double-array trie of the rules, built naively: nodes are placed one after the other at multiples of 256."""
    strings, places = b"", {}
    for k, v in rules.items():
        places[k] = len(strings)
        strings += v + b"\0"
    prefixes = sorted({k[:i] for k in rules for i in range(len(k) + 1)})
    base = {p: 256 * (i + 1) for i, p in enumerate(prefixes)}
    units = [0] * (256 * (len(prefixes) + 2))

    def unit(at, p):
        offset = at ^ base[p]
        leaf = p in rules
        units[at] |= (offset << 10) | (0x100 if leaf else 0)
        if leaf:
            units[base[p]] = 0x80000000 | places[p]

    unit(0, b"")
    for p in prefixes[1:]:
        at = base[p[:-1]] ^ p[-1]
        units[at] = p[-1]
        unit(at, p)
    blob = np.array(units, "<u4").tobytes()
    return len(blob).to_bytes(4, "little") + blob + strings


def test_longest_prefix_of_the_character_map():
    table = pieces.CharacterMap(_map({b"a": b"1", b"abc": b"2", "é".encode(): b"e", b"b": b""}))
    assert table.longest(b"abcd", 0) == (3, b"2") and table.longest(b"abd", 0) == (1, b"1") and table.longest(b"xb", 1) == (1, b"") and table.longest(b"x", 0) is None
    assert table.longest("é".encode(), 0) == (2, b"e")
    encoder = object.__new__(pieces.Encoder)
    encoder.map, encoder.suffix = table, False
    encoder.rules = type("R", (), {"escape_whitespaces": True, "remove_extra_whitespaces": True, "add_dummy_prefix": True})
    normal, align = encoder.normalize("  abc  éx ".encode())
    assert normal.decode() == "▁2▁ex" and align.tolist() == [2, 2, 2, 2, 5, 5, 5, 7, 9, 10]
