"""Continuous filing: an inbox of JSON documents, seen once within a time to live, latest wins."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lodestar.functions.text import trim_space
from lodestar.plans.scratch import materialize, release

INBOX = "doc_id long, text string, url string, title string, fetched_at timestamp"


def read_inbox(spark: SparkSession, path: str, schema: str = INBOX, per_batch: int = 1000) -> DataFrame:
    """New files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).json(path)


def with_identity(docs: DataFrame) -> DataFrame:
    return docs.withColumn("sha256", F.sha2(trim_space(F.col("text")), 256))


def first_within(docs: DataFrame, days: int = 30, key: str = "sha256", stamp: str = "fetched_at") -> DataFrame:
    """Rows whose key was not seen within so many days of event time. Rows later than that are dropped; the time does not slide."""
    return docs.withWatermark(stamp, f"{days} days").dropDuplicatesWithinWatermark([key])


def sliding_first(docs: DataFrame, days: int = 30, key: str = "sha256", stamp: str = "fetched_at") -> DataFrame:
    """(key, stamp, status): "new" if the key was not seen for so many days, else "refreshed". Every sight starts the time anew."""
    life = days * 86_400_000

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = []
        for at in sorted(t for batch in batches for t in batch[stamp]):
            ms = int(at.timestamp() * 1000)
            rows.append((name[0], at, "refreshed" if last is not None and ms - last <= life else "new"))
            last = ms if last is None else max(last, ms)
        state.update((last,))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + life + 1)
        yield pd.DataFrame(rows, columns=[key, stamp, "status"])

    timed = docs.select(key, stamp).withWatermark(stamp, "1 day")
    return timed.groupBy(key).applyInPandasWithState(step, f"{key} string, {stamp} timestamp, status string", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def remembered(docs: DataFrame, life: timedelta, key: str = "sha256") -> DataFrame:
    """(key, sights, status): "new" if the key was not seen within ``life`` of processing time, else "refreshed"; sights are those since it was new.

    The state forgets by its own time to live, which every sight starts anew. Needs the RocksDB state store.
    """

    class Memory(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.sights = handle.getValueState("sights", "n long", ttlDurationMs=int(life.total_seconds() * 1000))

        def handleInputRows(self, name, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            before = self.sights.get()[0] if self.sights.exists() else 0
            now = before + sum(len(batch) for batch in rows)
            self.sights.update((now,))
            yield pd.DataFrame({key: [name[0]] * (now - before), "sights": range(before + 1, now + 1), "status": ["refreshed" if n else "new" for n in range(before, now)]})

        def close(self) -> None:
            pass

    return docs.select(key).groupBy(key).transformWithStateInPandas(Memory(), f"{key} string, sights long, status string", "Append", "ProcessingTime")


def run(docs: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand every micro-batch to ``sink``, take what there is, and stop. The sink must tolerate a batch that comes twice."""
    return docs.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def file_sink(engine, channel: str = "web") -> Callable[[DataFrame, int], None]:
    """Files a batch through an engine; filing is by content, so a repeated batch changes nothing."""

    def sink(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            engine.file_documents(batch.drop("sha256"), channel)

    return sink


def index_sink(engine, collection: str, channel: str = "web", stream: str = "inbox", strategy: str | None = None) -> Callable[[DataFrame, int], None]:
    """Files a batch and indexes the bodies it brings: file, chunk, embed and upsert.

    A batch that is done is marked by its stream and number. One that comes again is left out; one that broke off half-way is done
    over: filing is by content and points are keyed by content, so what was written is only written again.
    """

    def sink(batch: DataFrame, number: int) -> None:
        mark = f"{engine.root}/batches/{stream}/{number}.json"
        if engine.store._read_text(mark) is not None or batch.isEmpty():
            return
        rows = materialize(batch.select("doc_id", "text", "title", "url", "fetched_at"), "batch")
        status = materialize(engine.file_documents(rows, channel), "filed")
        source = F.coalesce(F.nullif("url", F.lit("")), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")))
        told = F.map_filter(F.create_map(F.lit("title"), F.col("title"), F.lit("channel"), F.lit(channel)), lambda _, v: v.isNotNull())
        points = with_identity(rows).dropDuplicates(["sha256"]).select("text", source.alias("source_file"), told.alias("metadata"), F.array().cast("array<string>").alias("tags"))
        n = engine.index_documents(points, collection, strategy=strategy)
        engine.store._write_new(mark, json.dumps({"filed": status.count(), "rows": n}))
        release(rows, status)

    return sink
