"""WARC archives: a writer with payload de-duplication and a sequential reader.

Every record is a gzip member of its own. The reader inflates a file in small
chunks, frames each record by its Content-Length and checks its digests, so one
record is all it holds.

Defined results: a null html is an empty payload; rows whose page_id is null are
never the target of a revisit unless nothing else has their payload, and are
then written as responses; rows that repeat the chosen page_id are all
responses; an empty table gives no archive and an empty result; other columns of
the input are ignored. Archives of others are read too: digests are optional and
those of unknown kinds are not checked, ids that are no page's are null, and a
record that is damaged, or larger than MAX_RECORD, is a row with an error and no
type; after a broken gzip member the rest of its archive is one such row.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.plans.scratch import materialize, scratch_path
from lodestar.sources.storage import open_input, open_output

#: Smallest payload for which a copy becomes a revisit record.
REVISIT_MIN_BYTES = 1000
#: A writer begins another archive beyond this many compressed bytes.
ROLL_BYTES = 64 << 20
CHUNK = 1 << 16

_MANIFEST = "archive string, records long, bytes long"
_RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, error string"
#: Bytes of the largest record that is read.
MAX_RECORD = 1 << 30
_KINDS = {"sha1": hashlib.sha1, "sha256": hashlib.sha256, "md5": hashlib.md5}


def classify(pages: DataFrame, min_bytes: int = REVISIT_MIN_BYTES) -> DataFrame:
    """Rows (page_id, url, payload, digest, refers_to): refers_to is null for responses.

    Of equal payloads only the digest and the largest id are aggregated before
    the shuffle, so a payload that a third of all pages share is one row a task.
    """
    base = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    first = (
        base.where(F.octet_length("payload") >= min_bytes)
        .groupBy("digest")
        .agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1")
        .select("digest", "keeper")
    )
    joined = base.join(first, "digest", "left")
    same = F.col("keeper").isNull() | F.coalesce(F.col("keeper") == F.col("page_id"), F.lit(False))
    return joined.select("page_id", "url", "payload", "digest", F.when(~same, F.col("keeper")).alias("refers_to"))


def _digest(hexed: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hexed)).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: {_digest(digest)}",
        f"WARC-Block-Digest: {_digest(hashlib.sha1(block).hexdigest())}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:x-page:{refers_to}>",
        ]
    head.append(f"Content-Length: {len(block)}")
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def write_archives(classified: DataFrame, path: str) -> DataFrame:
    """Write archives under ``path``; the manifest (archive, records, bytes) is stored beside them.

    A repeated or speculative task writes under a name of its own, and only the
    archives of the attempt that Spark committed are in the manifest.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        stem, part, out, done = f"{path}/part-{task.partitionId():06d}-{task.taskAttemptId()}", 0, None, []
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    out, size, count, name = open_output(name := f"{stem}-{part:04d}.warc.gz"), 0, 0, name
                member = record_bytes(row["page_id"], row["url"], row["payload"], row["digest"], row["refers_to"])
                out.write(member)
                size, count = size + len(member), count + 1
                if size >= ROLL_BYTES:
                    out.close()
                    done, out, part = [*done, (name, count, size)], None, part + 1
        if out is not None:
            out.close()
            done.append((name, count, size))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["archive", "records", "bytes"])

    return materialize(classified.mapInArrow(write, _MANIFEST), "warc-manifest")


def members(stream, chunk: int = CHUNK, largest: int = MAX_RECORD) -> Iterator[bytes | None]:
    """The gzip members of a stream, inflated one after another, a bounded piece at a time; None for one that is too large."""
    inflate, parts, size, rest, begun = zlib.decompressobj(31), [], 0, b"", False
    while True:
        data = rest or stream.read(chunk)
        piece = inflate.decompress(data, 16 * chunk)
        if not data and not piece:
            if begun:
                raise ValueError("the archive ends within a gzip member")
            return
        size, begun, rest = size + len(piece), True, inflate.unconsumed_tail
        if size <= largest:
            parts.append(piece)
        else:
            parts.clear()
        if inflate.eof:
            yield b"".join(parts) if size <= largest else None
            rest, begun = inflate.unused_data, False
            inflate, parts, size = zlib.decompressobj(31), [], 0


def _checked(told: str | None, content: bytes, what: str) -> None:
    """Raise if a digest of a known kind, in base 32 or hexadecimal, is not that of the content."""
    kind, _, value = (told or "").partition(":")
    if value and (make := _KINDS.get(kind.lower().replace("-", ""))):
        right = make(content).digest()
        if value.lower() != right.hex() and value.upper().rstrip("=") != base64.b32encode(right).decode().rstrip("="):
            raise ValueError(f"{what} digest differs")


def parse_record(record: bytes) -> dict:
    """Headers and payload of a record whose length and digests are right; else ValueError."""
    head, sep, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not sep or not lines[0].startswith("WARC/"):
        raise ValueError("no WARC header")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    if not fields.get("warc-type") or not fields.get("content-length", "").isdigit():
        raise ValueError("no type or no Content-Length")
    length = int(fields["content-length"])
    block = rest[:length]
    if len(block) != length or rest[length:] != b"\r\n\r\n":
        raise ValueError("Content-Length does not frame the record")
    _checked(fields.get("warc-block-digest"), block, "block")
    payload = None
    if fields["warc-type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        _checked(fields.get("warc-payload-digest"), payload, "payload")
    return {"fields": fields, "payload": payload}


def _page(urn: str | None) -> int | None:
    digits = (urn or "").removeprefix("<urn:x-page:").removesuffix(">")
    return int(digits) if re.fullmatch(r"-?[0-9]+", digits) else None


def _shown(told: str | None, payload: bytes | None) -> str | None:
    """The payload's SHA-1 in hexadecimal, computed, or as a record without a payload tells it."""
    if payload is not None:
        return hashlib.sha1(payload).hexdigest()
    kind, _, value = (told or "").partition(":")
    return base64.b32decode(value).hex() if kind == "sha1" and re.fullmatch("[A-Z2-7]{32}", value) else value.lower() or None


def _record_row(raw: bytes | None, payloads: bool) -> tuple:
    """A row of _RECORDS."""
    try:
        if raw is None:
            raise ValueError("the record is too large")
        record = parse_record(raw)
    except ValueError as e:
        return (None,) * 7 + (str(e),)
    f, payload = record["fields"], record["payload"]
    size = None if payload is None else len(payload)
    return _page(f.get("warc-record-id")), f.get("warc-target-uri"), f["warc-type"], _page(f.get("warc-refers-to")), size, _shown(f.get("warc-payload-digest"), payload), payload if payloads else None, None


def _rows_of(stream, payloads: bool) -> Iterator[tuple]:
    try:
        for raw in members(stream):
            yield _record_row(raw, payloads)
    except (ValueError, zlib.error) as e:
        yield (None,) * 7 + (str(e),)


def read_archives(spark: SparkSession, manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """One row a record, read sequentially from every archive that the manifest lists."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload", "error"]
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()]
        rows, held = [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

        for batch in batches:
            for archive in batch.column(0).to_pylist():
                with open_input(archive) as stream:
                    for row in _rows_of(stream, payloads):
                        rows.append(row)
                        held += 200 + len(row[6] or b"")
                        if held > 4 << 20:
                            yield flush()
                            rows, held = [], 0
        if rows:
            yield flush()

    names = manifest.select("archive")
    return names.repartition(max(1, manifest.count()), "archive").mapInArrow(read, _RECORDS)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Give each revisit the length of the response that it refers to. Damaged records are left to those who read the archives."""
    records = records.where("error is null")
    target = records.where("record_type = 'response' and page_id is not null").groupBy(F.col("page_id").alias("target")).agg(F.max("payload_bytes").alias("target_bytes"))
    joined = records.join(target, records["refers_to"] == target["target"], "left")
    return joined.select("page_id", F.coalesce("payload_bytes", "target_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read them back."""
    manifest = write_archives(classify(pages), scratch_path(spark, "warc"))
    return resolve_revisits(materialize(read_archives(spark, manifest, payloads=False).drop("payload"), "warc-records"))
