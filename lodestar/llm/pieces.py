"""SentencePiece encoding that keeps offsets, and decoding.

Normalisation follows the model: the longest prefix that the compiled character
map holds is replaced, else one character is kept, and every byte of the
normalised text remembers the byte of the text that it came from. The pieces of
the library cover the normalised text from left to right, so their lengths
project each of them to a byte span of the original.

Defined results: a null or empty text has no ids and decodes to the empty text;
a text of any length is encoded whole; repeated rows are encoded alike; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁".encode()


class CharacterMap:
    """A precompiled map: a double-array trie over prefixes, then the replacements as NUL-ended strings."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist() if blob else []
        self.strings = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(length, replacement) of the longest known prefix of data[at:]."""
        if not self.units:
            return None
        units, found = self.units, None

        def base(unit: int) -> int:
            return (unit >> 10) << ((unit & 0x200) >> 6)

        node = base(units[0])
        for n in range(at, len(data)):
            node ^= data[n]
            if node >= len(units) or units[node] & 0x800000FF != data[n]:
                break
            unit = units[node]
            node ^= base(unit)
            if unit & 0x100:
                start = units[node] & 0x7FFFFFFF
                found = n + 1 - at, self.strings[start : self.strings.index(b"\0", start)]
        return found


def _character(data: bytes, at: int) -> int:
    """Length of the UTF-8 character that begins there."""
    lead = data[at]
    return min(len(data) - at, 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4)


class Encoder:
    """A model with its normaliser rules; kept by path in each worker."""

    _loaded: dict[str, Encoder] = {}

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as f:
            blob = f.read()
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(blob)
        self.rules, self.map = proto.normalizer_spec, CharacterMap(proto.normalizer_spec.precompiled_charsmap)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=blob)
        self.suffix = proto.trainer_spec.treat_whitespace_as_suffix
        # Type 6 is a byte; of unknown pieces (2) the length depends on the text.
        self.lengths = np.array([1 if p.type == 6 else -(1 << 40) if p.type == 2 else len(p.piece.encode()) for p in proto.pieces], np.int64)
        self.digits = [str(i).encode() for i in range(len(proto.pieces))]

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def normalize(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised bytes and, for each of them and their end, the byte of ``data`` it came from."""
        mark = SPACE if self.rules.escape_whitespaces else b" "
        if not self.map.units and not self.rules.remove_extra_whitespaces and not self.suffix:
            if not data:
                return b"", np.zeros(1, np.int64)
            raw = np.frombuffer(data, np.uint8)
            wide = np.ones(len(raw), np.int64)
            wide[raw == 32] = len(mark)
            head = mark if self.rules.add_dummy_prefix else b""
            align = np.concatenate([np.zeros(len(head), np.int64), np.repeat(np.arange(len(raw)), wide), [len(raw)]])
            return head + data.replace(b" ", mark), align
        units, at = [], 0
        while at < len(data):
            n, text = self.map.longest(data, at) or (k := _character(data, at), data[at : at + k])
            units.append((at, at + n, text))
            at += n
        first, last, squeeze = 0, len(units), self.rules.remove_extra_whitespaces
        if squeeze:
            while first < last and units[first][2].strip(b" ") == b"":
                first += 1
            while last > first and units[last - 1][2].strip(b" ") == b"":
                last -= 1
        if first == last:
            return b"", np.array([len(data)], np.int64)
        out, align = bytearray(), []

        def add(piece: bytes, source: int) -> None:
            out.extend(piece)
            align.extend([source] * len(piece))

        if self.rules.add_dummy_prefix and not self.suffix:
            add(mark, units[first][0])
        spaced = squeeze
        for begin, _, text in units[first:last]:
            if spaced:
                text = text.lstrip(b" ")
            for k in range(len(text)):
                add(mark if text[k : k + 1] == b" " else text[k : k + 1], begin)
            if text and squeeze:
                spaced = text.endswith(b" ")
        if squeeze:
            while out.endswith(mark):
                del out[-len(mark) :], align[-len(mark) :]
        if self.rules.add_dummy_prefix and self.suffix:
            add(mark, units[last - 1][1])
        return bytes(out), np.array([*align, units[last - 1][1]], np.int64)

    def encode(self, text: str) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Ids and the byte spans (starts, ends) of their pieces in the text."""
        ids = self.library.encode(text)
        normal, align = self.normalize(text.encode())
        sizes = self.lengths[ids] if ids else np.zeros(0, np.int64)
        if sizes.sum() < 0:
            sizes = np.array([len(p.piece.encode()) for p in self.library.encode(text, out_type="immutable_proto").pieces], np.int64)
        ends = np.cumsum(sizes)
        if (int(ends[-1]) if ids else 0) != len(normal):
            raise ValueError("the pieces do not cover the normalised text")
        return ids, align[ends - sizes], align[ends]


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids, starts, ends (byte spans of the pieces in the text's UTF-8) and the decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(model)
        for batch in batches:
            done = [encoder.encode(t or "") for t in batch.column(1).to_pylist()]
            lists = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[0] for x in done], lists), pa.array([x[1] for x in done], lists), pa.array([x[2] for x in done], lists), pa.array([encoder.library.decode(x[0]) for x in done], pa.string())],
                ["doc_id", "ids", "starts", "ends", "decoded"],
            )

    return _chosen(docs).mapInArrow(run, "doc_id long, ids array<int>, starts array<int>, ends array<int>, decoded string")


def _chosen(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode_digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, spans_crc32: digests of what ``encode_documents`` returns, made where the ids are.

    spans_crc32 is the CRC-32 of the spans' ends as unsigned 32-bit little-endian numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(model)
        digits = encoder.digits.__getitem__
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                ids, _, ends = encoder.encode(text or "")
                joined = hashlib.sha256(b",".join(map(digits, ids))).hexdigest()
                decoded = hashlib.sha256(encoder.library.decode(ids).encode()).hexdigest()
                rows.append((len(ids), joined, decoded, zlib.crc32(ends.astype("<u4").tobytes())))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_crc32"])

    return _chosen(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long")
