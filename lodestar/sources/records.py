"""Small records beside the tables: the registry of collections, the history and log tails."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions.dates import ledger_month, parse_date
from lodestar.operators.store import Store

HISTORY = "ts string, op string, file string, sha256 string, collection string, backend string, mode string, chunks long, embed_provider string, embed_model string, vector_dim int, ok boolean, error string"


class Registry(dict):
    """Collections by name, kept as one JSON file. A missing file is empty; a broken one is an error and is never overwritten."""

    def __init__(self, store: Store, path: str):
        self.store, self.path = store, path
        text = store._read_text(path)
        try:
            super().__init__(json.loads(text) if text else {})
        except ValueError as e:
            raise ValueError(f"the registry {path} is broken: {e}") from e

    def update_entry(self, name: str, **changes: Any) -> dict:
        """Change what is given; None leaves a value as it is."""
        self.setdefault(name, {"enabled": True}).update({k: v for k, v in changes.items() if v is not None})
        self.save()
        return self[name]

    def update_all(self, changes: dict[str, dict]) -> None:
        """``update_entry`` of several collections, saved once."""
        for name, own in changes.items():
            self.setdefault(name, {"enabled": True}).update({k: v for k, v in own.items() if v is not None})
        self.save()

    def remove(self, name: str) -> None:
        if self.pop(name, None) is not None:
            self.save()

    def save(self) -> None:
        self.store._write_text(self.path, json.dumps(self, indent=2, sort_keys=True))

    def enabled(self) -> list[str]:
        return sorted(n for n, e in self.items() if e.get("enabled"))

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(n, bool(e.get("enabled")), e.get("source_file"), json.dumps(e, sort_keys=True)) for n, e in sorted(self.items())]
        return spark.createDataFrame(rows, "name string, enabled boolean, source_file string, entry string")


def append_history(rows: DataFrame, path: str) -> None:
    """Append rows of HISTORY, one folder a month."""
    rows.withColumn("month", ledger_month(F.lit(""), parse_date(F.col("ts")))).write.mode("append").partitionBy("month").json(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HISTORY).option("mode", "DROPMALFORMED").json(path)


def tail(spark: SparkSession, path: str, lines: int = 200, limit: int = 2000) -> DataFrame:
    """The last lines of text files in order of file and line: (file, line_no, value)."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"), "value")
    last = rows.orderBy(F.desc("file"), F.desc("at")).limit(min(lines, limit))
    return last.withColumn("line_no", F.row_number().over(Window.orderBy("file", "at"))).select("file", "line_no", "value")
