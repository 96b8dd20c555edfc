"""Literal and regular-expression search over the lines of documents.

Lines are an array inside the row: context is a slice of it and nothing is
shuffled. Scope filters are plain predicates on day, channel and category, so
that a table partitioned by them is pruned.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PER_FILE, LIMIT = 5, 200


def scope(docs: DataFrame, since: str | None = None, until: str | None = None, channel: str | None = None, category: str | None = None, path: str | None = None) -> DataFrame:
    """Inclusive bounds on the day, and equality on the other parts of the scope."""
    if since:
        docs = docs.where(F.col("day") >= F.lit(since).cast("date"))
    if until:
        docs = docs.where(F.col("day") <= F.lit(until).cast("date"))
    for column, value in (("channel", channel), ("category", category)):
        if value:
            docs = docs.where(F.col(column) == value)
    if path:
        if path.startswith("/") or ".." in path.split("/"):
            return docs.limit(0)
        docs = docs.where((F.col("path") == path) | F.col("path").startswith(path.rstrip("/") + "/"))
    return docs


def lines_of(text: Column) -> Column:
    return F.split(F.regexp_replace(text, "\r\n", "\n"), "\n", -1)


def line_predicate(query: str, mode: str = "literal", case: bool | None = None, word: bool = False):
    """A function of a line. case None ignores case; "smart" is the caller's: pass has_upper(query)."""
    if not query:
        raise ValueError("an empty query")
    if mode not in ("literal", "regex"):
        raise ValueError(f"unknown mode {mode!r}")
    pattern = query if mode == "regex" else re.escape(query)
    if mode == "literal" and not word:
        if case:
            return lambda line: F.contains(line, F.lit(query))
        return lambda line: F.contains(F.lower(line), F.lit(query.lower()))
    if word:
        pattern = rf"(?<![\p{{L}}\p{{Nd}}_])(?:{pattern})(?![\p{{L}}\p{{Nd}}_])"
    return lambda line: line.rlike(("(?d)" if case else "(?diu)") + pattern)


def has_upper(query: str) -> bool:
    return any(c.isupper() for c in query)


def grep(docs: DataFrame, query: str, mode: str = "literal", case: bool | None = None, word: bool = False, context: int = 0, per_file: int = PER_FILE, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, line, text, before, after, matches): matching lines, numbered from 1, the first ``per_file`` of a document; matches counts all of them."""
    test = line_predicate(query, mode, case, word)
    guard = F.contains(F.col(text), F.lit(query)) if mode == "literal" and case else F.contains(F.lower(F.col(text)), F.lit(query.lower())) if mode == "literal" else F.lit(True)
    rows = docs.where(guard).select(key, *keep, lines_of(F.col(text)).alias("_lines"))
    numbered = F.transform("_lines", lambda line, i: F.when(test(line), i))
    hits = rows.withColumn("_hits", F.array_compact(numbered)).where(F.size("_hits") > 0)
    found = hits.select(key, *keep, "_lines", F.size("_hits").alias("matches"), F.explode(F.slice("_hits", 1, per_file) if per_file > 0 else F.col("_hits")).alias("_at"))
    at = F.col("_at")
    before = F.slice("_lines", F.greatest(at - context, F.lit(0)) + 1, F.least(at, F.lit(context)))
    return found.select(key, *keep, (at + 1).alias("line"), F.get("_lines", at).alias("text"), before.alias("before"), F.slice("_lines", at + 2, F.lit(context)).alias("after"), "matches")


def search_documents(docs: DataFrame, query: str, limit: int = LIMIT, key: str = "path", **options) -> tuple[DataFrame, dict]:
    """Hits of the first ``limit`` documents in order of the key, and totals: documents, matches before any cut, and whether documents were cut."""
    hits = grep(docs, query, key=key, **options)
    by_doc = hits.select(key, "matches").distinct()
    totals = by_doc.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("matches"), F.lit(0)).alias("matches")).first()
    first = by_doc.orderBy(key).limit(limit).select(key)
    return hits.join(first, key, "left_semi").orderBy(key, "line"), {"documents": totals["documents"], "total_matches": totals["matches"], "truncated": totals["documents"] > limit, "scanned": docs.count()}


def read_lines(docs: DataFrame, first: int = 1, last: int = 0, text: str = "text") -> DataFrame:
    """The documents with only the lines from first to last (both included; 0 means the end); empty if they begin past the end."""
    lines = lines_of(F.col(text))
    start = max(first, 1)
    count = F.size(lines) - (start - 1) if last <= 0 else F.least(F.lit(last), F.size(lines)) - (start - 1)
    return docs.withColumn(text, F.array_join(F.slice(lines, F.lit(start), F.greatest(count, F.lit(0))), "\n"))


def with_identity(hits: DataFrame, meta: DataFrame, key: str = "path", offset: str | None = None) -> DataFrame:
    """Hits with their documents' columns; line numbers count from the body if meta has the length of the front matter."""
    out = hits.join(meta, key, "left")
    return out.withColumn("line", F.when(F.col("line") > F.col(offset), F.col("line") - F.col(offset)).otherwise(1)).drop(offset) if offset else out
