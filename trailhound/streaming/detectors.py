"""Streaming forms of the detectors. All but the phases are plain transformations of a streaming DataFrame, so the same
function also runs in batch; state is bounded by the watermark.

A stream of a finite input ends with windows, sessions and rows that the watermark has not passed yet. ``with_closing`` joins
a second source to the events, and ``close`` puts into it one row far ahead of all others: it moves the watermark past
the last event, so that the next run of the same stream gives out what was still open, and is counted nowhere itself.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from trailhound import fixed_values as V
from trailhound.functions.text import holds_any
from trailhound.operators.parse import parse_kv8
from trailhound.operators.timeline import phase_mark

#: Marks the row that closes a stream, and its time, after which every event counts as late.
CLOSING = "_closing"
CLOSING_TIME = dt.datetime(9999, 1, 1)


def read_events(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(folder)


def _closing_schema(schema: StructType) -> StructType:
    return StructType([StructField(f.name, f.dataType) for f in schema]).add(CLOSING, BooleanType())


def with_closing(stream: DataFrame, folder: str) -> DataFrame:
    """The stream together with the rows that :func:`close` puts into ``folder``."""
    spark, schema = stream.sparkSession, _closing_schema(stream.schema)
    spark.createDataFrame([], schema).write.mode("append").parquet(folder)  # the folder of a file source must exist
    closing = spark.readStream.schema(schema).parquet(folder)
    return stream.withColumn(CLOSING, F.lit(False)).unionByName(closing)


def close(stream: DataFrame, folder: str) -> None:
    """End the input of a stream made with :func:`with_closing`; its next run gives out all that is open. Events after it are late."""
    schema = _closing_schema(stream.schema)
    row = tuple(True if f.name == CLOSING else CLOSING_TIME if f.name == "ts" else None for f in schema)
    stream.sparkSession.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(folder)


def kept(df: DataFrame, condition: Column) -> DataFrame:
    """The rows of a condition; a closing row stays, for the watermark to see it."""
    return df.filter(condition | F.col(CLOSING)) if CLOSING in df.columns else df.filter(condition)


def with_event_time(df: DataFrame, delay: str) -> DataFrame:
    timed = df.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    if CLOSING not in df.columns:
        return timed
    # the test names the event time, so that it is not moved to before the watermark
    return timed.filter(~F.col(CLOSING) | F.col("ts").isNull()).drop(CLOSING)


def ingest(df: DataFrame, line: str = "line") -> DataFrame:
    """The stateless parser, unchanged."""
    return parse_kv8(df, line)


def brute_force(df: DataFrame, window: str = "10 minutes", slide: str = "5 minutes", minimum: int = V.BRUTE_FORCE_MIN, delay: str = "10 minutes") -> DataFrame:
    """Authentication failures per address in sliding windows."""
    fails = kept(df, holds_any(F.col("raw_log"), V.AUTH_FAIL_WORDS) & F.col("source_ip").isNotNull())
    return (
        with_event_time(fails, delay).groupBy("source_ip", F.window("ts", window, slide).alias("w"))
        .agg(F.count(F.lit(1)).alias("failed_attempts")).filter(F.col("failed_attempts") > minimum)
        .select("source_ip", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                "failed_attempts"))


def hourly(df: DataFrame, delay: str = "1 hour") -> DataFrame:
    return (
        with_event_time(df, delay).groupBy(F.window("ts", "1 hour").alias("w"))
        .agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("hour"), "n"))


def sessions(df: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Spans of activity per user."""
    return (
        with_event_time(df, delay).groupBy("user_name", F.session_window("ts", gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("n_events"))
        .select("user_name", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events"))


def first_alerts(df: DataFrame, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """Alerts with repeats of the same keys suppressed within the watermark delay."""
    return with_event_time(df, delay).dropDuplicatesWithinWatermark(keys)


def ioc_matches(df: DataFrame, feed: DataFrame) -> DataFrame:
    """Stream to static feed; the feed's size decides the join strategy."""
    known = feed.filter("kind = 'ip'").select(F.col("indicator").alias("source_ip")).distinct()
    return df.join(known, "source_ip", "left_semi")


def ioc_matches_to_table(stream: DataFrame, read_feed: Callable[[], DataFrame], folder: str) -> DataFrame:
    """Match a stream against a feed that changes: the feed is read again for each micro-batch.

    A batch writes the folder of its own number anew, so one that is run again leaves its rows once. Rows that a batch has
    matched stay as they are when the feed changes later. The result has the number in ``batch``.
    """
    def write(batch: DataFrame, number: int) -> None:
        ioc_matches(batch, read_feed()).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    schema = StructType([*stream.schema.fields]).add("batch", IntegerType())
    return stream.sparkSession.read.schema(schema).parquet(f"{folder}/out")


def phases(df: DataFrame, key: str = "user_name", text: str = "raw_log", delay: str = "1 hour") -> DataFrame:
    """The attack phase of every timed event of a key, as events of that key in order switch it: ``timeline.attack_phases`` on a stream.

    Each key keeps its phase, and its rows until the watermark passes them and their order is settled; a timer at the
    earliest of them gives them out even if the key has no further event. State is a phase for each key and the rows
    of one delay. Rows later than the watermark are left out, as in every stream here.
    """
    timed = with_event_time(kept(df, F.col("ts").isNotNull()), delay)
    narrow = timed.select("ts", F.col(key).cast("string").alias("key"), "event_id", F.unix_micros("ts").alias("micros"),
                          phase_mark(F.col(text)).alias("mark"))

    def run(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        phase, held = V.FIRST_PHASE, []
        if state.exists:
            phase, times, ids, marks = state.get
            held = list(zip(times, ids, marks, strict=True))
        for frame in frames:
            held += zip(frame["micros"].tolist(), frame["event_id"].tolist(), frame["mark"].tolist(), strict=True)
        held.sort(key=lambda row: row[:2])
        passed = state.getCurrentWatermarkMs()
        out = []
        while held and held[0][0] < passed * 1000:
            at, event, mark = held.pop(0)
            phase = mark or phase
            out.append((event, keys[0], at, phase))
        state.update((phase, *([row[k] for row in held] for k in range(3))))
        if held:
            state.setTimeoutTimestamp(max(held[0][0] // 1000, passed) + 1)
        yield pd.DataFrame(out, columns=["event_id", "key", "micros", "phase"])

    found = narrow.groupBy("key").applyInPandasWithState(
        run, "event_id bigint, key string, micros bigint, phase string",
        "phase string, times array<bigint>, ids array<bigint>, marks array<string>", "append", GroupStateTimeout.EventTimeTimeout)
    return found.select("event_id", F.timestamp_micros("micros").alias("ts"), F.col("key").alias(key), "phase")


def run_to_end(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """Drive a stream of finite input through a detector to its very end: all events, then the closing step."""
    spark = stream.sparkSession
    closing = f"{folder}/closing"
    found = transform(with_closing(stream, closing))
    run_to_table(found, spark, folder)
    close(stream, closing)
    return run_to_table(found, spark, folder)


def run_to_table(stream: DataFrame, spark: SparkSession, folder: str, mode: str = "append") -> DataFrame:
    """Drive a stream through everything available now into Parquet, and read the result."""
    query = (
        stream.writeStream.outputMode(mode).format("parquet").option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
