"""The latest version of each key of a stream, kept in keyed state.

Rows may come in any order: the state of a key is the greatest (time, id) met so far, and a batch emits a key only when its latest
version changes. A timer forgets a key that has been quiet for ``ttl``; without one the state holds every key. The emitted rows are
written under their batch number, so a batch that runs again replaces its own, and ``current`` reads the last of each key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that keyed state with timers needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
VERSIONS = "key string, at long, id long"


class Latest(StatefulProcessor):
    """Input and output: key, at (microseconds), id."""

    def __init__(self, ttl: int | None = None):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.version = handle.getValueState("version", "at long, id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = best = tuple(self.version.get()) if self.version.exists() else None
        for part in rows:
            for version in zip(part["at"].tolist(), part["id"].tolist(), strict=True):
                best = version if best is None or version > best else best
        if self.ttl is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.ttl)
        if best != old:
            self.version.update(best)
            yield pd.DataFrame({"key": [key[0]], "at": [best[0]], "id": [best[1]]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.version.clear()
        return iter(())

    def close(self) -> None:
        """Nothing is held beside the state."""


def latest(stream: DataFrame, ttl: int | None = None) -> DataFrame:
    """Changes of the latest version of each key of ``stream`` (key, at, id); ``ttl`` in milliseconds."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return stream.groupBy("key").transformWithStateInPandas(Latest(ttl), VERSIONS, "update", "none" if ttl is None else "processingTime")


def start(changes: DataFrame, target: str, checkpoint: str, every: str | None = None):
    """Write the changes under ``target``, a folder a batch: what is there now, or on and on at intervals of ``every``.

    A stream with a ``ttl`` needs an interval: its timers ask for batch after batch, so it has no end of what is there."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = changes.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()


def current(spark: SparkSession, target: str) -> DataFrame:
    """(key, at, id): the latest version of each key as written."""
    rows = spark.read.schema(VERSIONS + ", batch long").option("basePath", target).parquet(target)
    return rows.groupBy("key").agg(F.max(F.struct("at", "id")).alias("top")).select("key", "top.at", "top.id")
