"""The filter language, compiled to one boolean column.

A filter is {key: value, ...}, all of which must hold, or {"must": [{"key": k,
"match": {"value": v} or {"prefix": p}}, ...]}, which wins over flat keys. "ids"
selects rows by identity. Values are compared as strings; a missing value never
matches; an empty filter matches all rows and an empty id list none.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.functions.text import parse_tags

#: Ids beyond this number are joined instead of listed.
LISTED_IDS = 1000


def _shown(value: Any) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value)


def lookup(schema: T.StructType, path: str) -> tuple[Column, T.DataType] | None:
    """The column that a dotted path leads to, through structs and maps; None if there is none."""
    if path in schema.fieldNames():
        return F.col(f"`{path}`"), schema[path].dataType
    head, _, rest = path.partition(".")
    if head not in schema.fieldNames() or not rest:
        return None
    column, kind = F.col(f"`{head}`"), schema[head].dataType
    while rest:
        if isinstance(kind, T.MapType):
            return F.try_element_at(column, F.lit(rest)), kind.valueType
        if not isinstance(kind, T.StructType):
            return None
        name, _, rest = rest.partition(".")
        if name not in kind.fieldNames():
            return None
        column, kind = column[name], kind[name].dataType
    return column, kind


def _clause(schema: T.StructType, key: str, match: dict) -> Column:
    if set(match) not in ({"value"}, {"prefix"}):
        raise ValueError(f"unsupported match for {key!r}: {sorted(match)}")
    found = lookup(schema, key)
    if found is None:
        return F.lit(False)
    column, kind = found
    if "value" in match:
        return F.coalesce(column.cast("string") == F.lit(_shown(match["value"])), F.lit(False))
    prefix = str(match["prefix"])
    tags = column if isinstance(kind, T.ArrayType) else parse_tags(column.cast("string"))
    return F.coalesce(F.exists(tags, lambda t: (t == prefix) | t.startswith(prefix + "/")), F.lit(False))


def _ids(value: Any) -> list[str]:
    return [s for v in ([value] if isinstance(value, str) else value) if (s := str(v).strip())]


def _identity(schema: T.StructType) -> list[Column]:
    paths = [lookup(schema, p) for p in ("point_id", "content_sha", "hash", "metadata.content_sha", "doc_id")]
    return [p[0].cast("string") for p in paths if p is not None]


def compile_filter(schema: T.StructType, condition: dict | None) -> Column:
    """One boolean column, never null."""
    clauses = dict(condition or {})
    parts: list[Column] = []
    if "ids" in clauses:
        wanted = _ids(clauses.pop("ids"))
        parts.append(reduce(lambda a, b: a | b, (F.coalesce(c.isin(wanted), F.lit(False)) for c in _identity(schema)), F.lit(False)) if wanted else F.lit(False))
    if "must" in clauses:
        for item in clauses["must"]:
            if set(item) != {"key", "match"}:
                raise ValueError(f"unsupported clause: {sorted(item)}")
            parts.append(_clause(schema, item["key"], item["match"]))
    else:
        parts += [_clause(schema, k, {"value": v}) for k, v in clauses.items()]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def apply_filter(df: DataFrame, condition: dict | None) -> DataFrame:
    """Rows that the filter matches; long id lists become a semi join."""
    ids = _ids((condition or {}).get("ids", []))
    if len(ids) <= LISTED_IDS:
        return df.where(compile_filter(df.schema, condition))
    rest = {k: v for k, v in condition.items() if k != "ids"}
    wanted = df.sparkSession.createDataFrame([(i,) for i in ids], "_id string")
    keyed = df.where(compile_filter(df.schema, rest)).withColumn("_ids", F.array_compact(F.array(*_identity(df.schema))))
    return keyed.join(wanted, F.array_contains("_ids", F.col("_id")), "left_semi").drop("_ids")


def from_metadata(metadata: dict[str, Any] | None, explicit: dict | None = None) -> dict:
    """A filter from metadata pairs; an explicit filter wins."""
    if explicit:
        return explicit
    return {"must": [{"key": f"metadata.{k}", "match": {"value": v}} for k, v in metadata.items()]} if metadata else {}
