"""Streams: file sources, batch processing with an error budget, cumulative and windowed aggregates.

Every aggregate here is a plain DataFrame function that works alike on a batch and a stream.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from vantloom.runtime import ship


def file_stream(spark: SparkSession, path: str, schema: StructType | str, kind: str = "csv", files_per_batch: int = 1, **options) -> DataFrame:
    """A folder of files as a stream; rows that do not parse are dropped."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).options(**options)
    if kind in ("csv", "json"):
        reader = reader.option("mode", "DROPMALFORMED")
    return reader.format(kind).load(path)


def kafka_stream(spark: SparkSession, servers: str, topic: str, schema: str) -> DataFrame:
    """JSON values of a topic; the Kafka package must be on the class path."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("r"), "timestamp").select("r.*", "timestamp")


def cumulative(df: DataFrame, fields: list[str], by: list[str] | None = None) -> DataFrame:
    """<field>_count and <field>_sum so far, by group if any; for complete or update mode."""
    cells: list[Column] = []
    for f in fields:
        x = F.col(f).try_cast("double") if dict(df.dtypes)[f] == "string" else F.col(f).cast("double")
        cells += [F.count(x).alias(f"{f}_count"), F.coalesce(F.sum(x), F.lit(0.0)).alias(f"{f}_sum")]
    return df.groupBy(*(by or [])).agg(*cells)


def windowed(df: DataFrame, at: str, size: str, aggs: list[Column], slide: str | None = None, by: list[str] | None = None, late: str | None = None) -> DataFrame:
    """Tumbling or sliding windows; ``late`` is how long stragglers are waited for."""
    if late:
        df = df.withWatermark(at, late)
    w = F.window(at, size, slide) if slide else F.window(at, size)
    return df.groupBy(w.alias("w"), *(by or [])).agg(*aggs).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *(by or []), *[c for c in _names(aggs)])


def sessions(df: DataFrame, at: str, gap: str, by: list[str], aggs: list[Column], late: str | None = None) -> DataFrame:
    """Windows that end after a gap without rows."""
    if late:
        df = df.withWatermark(at, late)
    return df.groupBy(F.session_window(at, gap).alias("w"), *by).agg(*aggs).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *by, *_names(aggs))


def _names(aggs: list[Column]) -> list[str]:
    return [c._jc.toString().rsplit(" AS ", 1)[-1].strip("`") for c in aggs]


@dataclass
class Progress:
    batches: int = 0
    rows: int = 0
    errors: int = 0
    messages: list[str] = field(default_factory=list)
    seconds: float = 0.0
    slowest: float = 0.0
    began: float = field(default_factory=time.monotonic)

    @property
    def mean_ms(self) -> float:
        """Mean time of a batch."""
        return 1000 * self.seconds / self.batches if self.batches else 0.0

    @property
    def rows_per_second(self) -> float:
        """Rows by the time since the processor was made."""
        return self.rows / max(1e-9, time.monotonic() - self.began)

    @property
    def error_share(self) -> float:
        return self.errors / self.batches if self.batches else 0.0


class Processor:
    """Applies a function to each micro-batch; stops the stream when the share of failed batches passes the budget.

    A failed batch counts as an error and is skipped; the budget is checked after a success.
    """

    def __init__(self, fn: Callable[[DataFrame, int], None], error_budget: float = 0.01):
        self.fn, self.error_budget, self.progress = fn, error_budget, Progress()

    def __call__(self, batch: DataFrame, number: int) -> None:
        p, began = self.progress, time.monotonic()
        p.batches += 1
        try:
            self.fn(batch, number)
            p.rows += batch.count()
        except Exception as e:  # a batch's failure is data here, and is counted
            p.errors += 1
            p.messages.append(str(e)[:200])
            return
        finally:
            took = time.monotonic() - began
            p.seconds, p.slowest = p.seconds + took, max(p.slowest, took)
        if p.error_share > self.error_budget:
            raise RuntimeError(f"{p.errors} of {p.batches} batches failed")

    def start(self, stream: DataFrame, checkpoint: str, once: bool = True):
        writer = stream.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()


def run_to_files(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Everything that is there goes through the stream into Parquet files, by append; no row comes to the driver."""
    q = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_to_table(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Everything that is there goes through the stream into an in-memory table; for aggregates with few groups."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def running_state(stream: DataFrame, key: str, value: str, timeout_ms: int | None = None) -> DataFrame:
    """(key, n, total, highest) as custom state of each key, updated with every micro-batch that has it."""
    ship(stream.sparkSession)
    kind = dict(stream.dtypes)[key]

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total, highest = state.get if state.exists else (0, 0.0, float("-inf"))
        for f in frames:
            v = f[value].dropna()
            n, total, highest = n + len(v), total + float(v.sum()), max(highest, float(v.max()) if len(v) else highest)
        state.update((n, total, highest))
        yield pd.DataFrame({key: [k[0]], "n": [n], "total": [total], "highest": [highest]})

    return stream.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, n bigint, total double, highest double", "n bigint, total double, highest double", "update", GroupStateTimeout.NoTimeout)


def merge_vocabulary(counts: DataFrame, batch: DataFrame, tokens: str) -> DataFrame:
    """Term counts after one more batch: old counts and the batch's, added up."""
    fresh = batch.select(F.explode(tokens).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return counts.unionByName(fresh).groupBy("term").agg(F.sum("n").alias("n"))
