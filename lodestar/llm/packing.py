"""Sum-of-squares packing of tokenised documents into fixed-length sequences.

A document's ids are those of the tokenizers library for the whole text, plus an
end id. Only documents longer than a sequence are cut. The packer keeps N(g),
the number of open sequences with g free places, and places each piece where
the sum of N(g)^2 becomes smallest (ties: the tightest sequence, then a new one).
It takes long pieces first. Lengths alone decide, so only (doc_id, piece,
length) is shuffled. Shards are hashed and of a fixed mean size, so a task's
work and memory do not grow with the corpus.

Defined results: a null or empty text is a document of the end id alone; repeated
rows are packed as often as they occur; equal lengths are taken by doc_id
(nulls first) and piece; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.plans.scratch import materialize

SEQUENCE = 4096
END_ID = 1
#: Mean number of pieces that one task packs.
SHARD_PIECES = 16384
#: Parts of a generation of a worker's cache (about 0.2 KB each); it holds two, and what the older one still gives moves to the newer.
CACHE_WORDS = 400_000

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PLACES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class WordIds(dict):
    """Ids of texts through a cache by white-space separated part.

    The vocabulary's rules drop white space and nothing spans it, so a text's ids
    are its parts' ids in a row. A new part of letters below U+0250 is lower-cased
    and split by the vocabulary's own pattern, and its words go straight to the
    library's model; for these letters that is all that the library's normaliser
    does. Any other part goes through the whole library.
    """

    _loaded: dict[str, WordIds] = {}

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        steps = rules["pre_tokenizer"]["pretokenizers"]
        self.split = regex.compile(steps[0]["pattern"]["Regex"]).findall
        self.special = tuple(t["content"] for t in rules["added_tokens"])
        self.simple = re.compile("[!-~\u00a1-\u012f\u0131-\u024f]+").fullmatch
        # Byte-level rule: printable bytes stand for themselves, the others for code points from 256 on.
        printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = iter(range(256, 512))
        self.shown = {b: chr(b if b in printable else next(others)) for b in range(256)}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> WordIds:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        out = array("I", ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def _whole(self, text: str) -> bytes:
        return self._packed(self.library.encode(text, add_special_tokens=False).ids)

    def _word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            level = word if word.isascii() else "".join(map(self.shown.__getitem__, word.encode()))
            found = self.words[word] = self._packed([t.id for t in self.library.model.tokenize(level)])
        return found

    def __missing__(self, part: str) -> bytes:
        if (found := self.older.get(part)) is not None:
            pass
        elif self.simple(part) and not any(s in part for s in self.special):
            found = b"".join(map(self._word, self.split(part.lower())))
        else:
            found = self._whole(part)
        self[part] = found
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self) > CACHE_WORDS:
            self.older = dict(self)
            self.clear()
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        get = self.__getitem__
        # These four separate words for Python but not for the library.
        return [self._whole(t) if "\x1c" in t or "\x1d" in t or "\x1e" in t or "\x1f" in t else b"".join(map(get, t.split())) for t in texts]


def cut(n: int, limit: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids."""
    return [(s, min(limit, n - s)) for s in range(0, n, limit)]


def tokenize_pieces(docs: DataFrame, vocabulary: str, limit: int = SEQUENCE, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32 and, if asked for, its ids as binary (unsigned 32-bit, little-endian)."""
    end = WordIds._packed([end_id])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds.of(vocabulary)
        for batch in batches:
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), words.encode([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                ids += end
                for k, (start, length) in enumerate(cut(len(ids) // 4, limit)):
                    own = ids[4 * start : 4 * (start + length)]
                    rows.append((doc, k, start, length, zlib.crc32(own), own))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(kinds)])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(run, _PIECES + ", ids binary" * with_ids)


def sum_of_squares(lengths: list[int], limit: int = SEQUENCE) -> tuple[list[int], list[int]]:
    """The bin and offset of each length, placed in the given order."""
    count = np.zeros(limit + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(limit + 1)]
    bins, offsets, made = [], [], 0
    for s in lengths:
        if s == limit:
            bins.append(made)
            offsets.append(0)
            made += 1
            continue
        here = count[s:limit]
        change = 2 * (count[: limit - s] - here) + 2
        change[0] = 1 - 2 * here[0]
        change[here == 0] = 1 << 60
        k = int(change.argmin()) if len(change) else 0
        if len(change) and change[k] <= 2 * count[limit - s] + 1:
            gap = s + k
            b = open_bins[gap].pop()
            count[gap] -= 1
        else:
            gap, b, made = limit, made, made + 1
        bins.append(b)
        offsets.append(limit - gap)
        if rest := gap - s:
            count[rest] += 1
            open_bins[rest].append(b)
    return bins, offsets


def pack(pieces: DataFrame, limit: int = SEQUENCE, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Add sequence_id and offset to stored pieces (doc_id, piece, start, length, ids_crc32)."""
    shards = max(1, -(-pieces.count() // shard_pieces))

    def place(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], na_position="first", kind="stable")
        bins, offsets = sum_of_squares(rows["length"].tolist(), limit)
        return rows.drop(columns="shard").assign(sequence_id=np.array(bins, np.int64) + (int(key[0]) << 36), offset=np.array(offsets, np.int64)).astype({"doc_id": "Int64"})

    # By the stored row's number too, so that null and repeated ids are dealt over all shards.
    dealt = pieces.select("*", F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id(), F.lit(7)), F.lit(shards)).alias("shard"))
    return dealt.groupBy("shard").applyInPandas(place, _PLACES)


def pack_documents(docs: DataFrame, vocabulary: str, limit: int = SEQUENCE) -> DataFrame:
    """Tokenise and pack; the pieces' lengths are stored in the shared folder between the two."""
    return pack(materialize(tokenize_pieces(docs, vocabulary, limit, with_ids=False), "pieces"), limit)


def sequences(docs: DataFrame, places: DataFrame, vocabulary: str, limit: int = SEQUENCE) -> DataFrame:
    """The packed sequences themselves: sequence_id and its pieces' ids in order of offset (binary); null and repeated ids are told apart by their pieces' checksums."""
    key = ["piece", "length", "ids_crc32"]
    ids = tokenize_pieces(docs, vocabulary, limit).select(F.col("doc_id").alias("_doc"), *key, "ids").dropDuplicates(["_doc", *key])
    joined = places.join(ids, key).where(F.col("doc_id").eqNullSafe(F.col("_doc")))
    whole = joined.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "ids"))).alias("parts"))
    return whole.select("sequence_id", F.col("parts.ids").alias("ids"), F.col("parts.doc_id").alias("doc_ids"))
