"""Ordered operators: carrying a value forward in time, phases, sequences, trends, priorities."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from trailhound import fixed_values as V
from trailhound.functions.lookup import banded, look_up
from trailhound.functions.text import contains_any, starts_with_any
from trailhound.functions.times import seconds_between
from trailhound.session import Stored, store


#: Rows of a range, about: what one task orders and fills.
ROWS_PER_RANGE = 2_000_000
#: Share of the rows that is counted to choose the number of ranges.
SAMPLED = 0.01
MARK, RANGE = "_mark", "_range"


@dataclass(frozen=True)
class Ranged:
    """Rows stored in even ranges of (keys, order), with the value to carry in ``_mark``. ``remove`` deletes them."""

    rows: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    stored: Stored

    def remove(self) -> None:
        self.stored.remove()


def store_ranges(
    df: DataFrame, value: Column, keys: tuple[str, ...] = (), order: tuple[str, ...] = ("ts", "event_id"),
    ranges: int | None = None, rows_per_range: int = ROWS_PER_RANGE,
) -> Ranged:
    """The explicit first step of an ordered pass: sort once into ranges that stay the same, whatever is lost or run again.

    Ranges are cut by (keys, order), so neither a hot key nor a hot hour lands in one task. Their number follows from a
    sampled count of the rows and not from the session's shuffle settings.
    """
    if ranges is None:
        ranges = max(1, math.ceil(df.select(*order).sample(SAMPLED, seed=1).count() / SAMPLED / rows_per_range))
    marked = df.withColumn(MARK, value).repartitionByRange(ranges, *keys, *order).withColumn(RANGE, F.spark_partition_id())
    kept = store(marked, "ranges")
    return Ranged(kept.rows, keys, order, kept)


def carried(ranged: Ranged, name: str, before_current: bool = False) -> DataFrame:
    """Last non-null value up to each row (or strictly before it), per key or over the whole input, as a plan only.

    Each range hands its last value to the next ones through a table of one row per (key, range).
    """
    rows, keys, order = ranged.rows, ranged.keys, ranged.order
    position = F.struct(*order)
    tails = rows.groupBy(*keys, RANGE).agg(
        F.max_by(MARK, F.when(F.col(MARK).isNotNull(), position)).alias("_tail"))
    earlier = W.partitionBy(*(keys or [F.lit(0)])).orderBy(RANGE).rowsBetween(W.unboundedPreceding, -1)
    incoming = tails.select(
        *[F.col(k).alias(f"_key_{k}") for k in keys], F.col(RANGE).alias("_in_range"),
        F.last("_tail", ignorenulls=True).over(earlier).alias("_incoming"))
    same = F.col(RANGE) == F.col("_in_range")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    # a row for each range (and key of it): how the join is done follows from its size
    joined = rows.join(incoming, same, "left")
    inside = W.partitionBy(*keys, RANGE).orderBy(*order).rowsBetween(
        W.unboundedPreceding, -1 if before_current else W.currentRow)
    filled = F.coalesce(F.last(MARK, ignorenulls=True).over(inside), F.col("_incoming"))
    return joined.withColumn(name, filled).select(*[c for c in rows.columns if c not in (MARK, RANGE)], name)


def carry_forward(
    df: DataFrame, value: Column, name: str, keys: tuple[str, ...] = (),
    order: tuple[str, ...] = ("ts", "event_id"), before_current: bool = False, ranges: int | None = None,
) -> DataFrame:
    """Both steps at once: the ranges are stored now and stay until the run's folder is removed."""
    return carried(store_ranges(df, value, keys, order, ranges), name, before_current)


def phase_mark(text: Column) -> Column:
    """Phase a message switches to, null when it switches nothing; only its first 100 characters count."""
    head = F.lower(F.substr(text, F.lit(1), F.lit(100)))
    result = None
    for phase, words in V.PHASE_RULES:
        test = contains_any(head, words)
        result = F.when(test, F.lit(phase)) if result is None else result.when(test, F.lit(phase))
    return result


def attack_phases(df: DataFrame, keys: tuple[str, ...] = (), text: str = "raw_log", ranges: int | None = None) -> DataFrame:
    """Phase of every timed event: a phase stays until a later message switches it."""
    return phases_of(store_phases(df, keys, text, ranges))


def store_phases(df: DataFrame, keys: tuple[str, ...] = (), text: str = "raw_log", ranges: int | None = None) -> Ranged:
    """The timed events in ranges with the phase that each switches to; no text is moved."""
    narrow = df.filter(F.col("ts").isNotNull()).select("event_id", "ts", *keys, phase_mark(F.col(text)).alias("_switch"))
    return store_ranges(narrow.select("event_id", "ts", *keys, "_switch"), F.col("_switch"), keys, ranges=ranges)


def phases_of(ranged: Ranged) -> DataFrame:
    """The phase of every stored event, as a plan only."""
    return carried(ranged, "phase").drop("_switch").withColumn("phase", F.coalesce("phase", F.lit(V.FIRST_PHASE)))


def timeline(df: DataFrame, text: str = "raw_log") -> DataFrame:
    return df.filter(F.col("ts").isNotNull()).orderBy("ts", "event_id").select(
        "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        F.coalesce("severity", F.lit("INFO")).alias("severity"),
        F.coalesce("source", F.lit("Unknown")).alias("source"),
        F.substr(F.col(text), F.lit(1), F.lit(150)).alias("event"),
        F.coalesce(F.col("severity").isin(V.TIMELINE_CRITICAL), F.lit(False)).alias("is_critical"))


def timeline_top(df: DataFrame, n: int = 30, text: str = "raw_log") -> DataFrame:
    """The first ``n`` timed events with their phase, and how many events remain.

    Phases of the first rows depend on no later row, so they are filled within those rows alone.
    """
    timed = df.filter(F.col("ts").isNotNull())
    head = timed.orderBy("ts", "event_id").limit(n)
    total = df.agg(F.count(F.lit(1)).alias("total")).scalar()
    order = W.orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    phase = F.coalesce(F.last(phase_mark(F.col(text)), ignorenulls=True).over(order), F.lit(V.FIRST_PHASE))
    return head.select(
        "event_id", "ts", phase.alias("phase"), "severity", "source",
        F.substr(F.col(text), F.lit(1), F.lit(100)).alias("event"),
        F.greatest(total - F.lit(n), F.lit(0)).cast("bigint").alias("remaining"))


def severity_rank(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "y_pos", look_up(F.upper("severity"), V.TIMELINE_RANK, 1).cast("bigint")).orderBy("ts", "event_id")


def risk_trend(history: DataFrame, keys: tuple[str, ...], time: str, score: str) -> DataFrame:
    """Each score against the one before it. The history has one row per key and assessment."""
    previous = F.lag(score).over(W.partitionBy(*keys).orderBy(time))
    change = F.col(score) - F.col("previous_score")
    return history.withColumn("previous_score", previous).withColumns({
        "change": F.coalesce(F.round(change, 2), F.lit(0.0)),
        "trend": F.when(change > 10, "INCREASING").when(change < -10, "DECREASING").otherwise("STABLE")})


def sequences(
    df: DataFrame, first: Column, then: Column, keys: tuple[str, ...], hours: float, ranges: int | None = None,
) -> DataFrame:
    """Events of the second kind with the latest earlier event of the first kind within the time span.

    One row per second event: pairs are never enumerated, so a key with many events of both kinds stays linear.
    """
    narrow = df.select("event_id", "ts", *keys, first.alias("_first"), then.alias("_then")).filter(
        F.col("ts").isNotNull() & (F.col("_first") | F.col("_then")))
    place = F.when(F.col("_first"), F.struct("ts", "event_id"))
    filled = carry_forward(narrow, place, "_prior", keys, before_current=True, ranges=ranges)
    gap = seconds_between(F.col("ts"), F.col("_prior.ts"))
    return filled.filter(F.col("_then") & (gap <= F.lit(hours * 3600.0))).select(
        *keys, "event_id", "ts", F.col("_prior.event_id").alias("first_event_id"),
        F.col("_prior.ts").alias("first_ts"))


def finding_score(base: Column) -> Column:
    """Score of one finding: base of its list, raised for privileged users and outside addresses, at most 100."""
    privileged = F.lower(F.coalesce("user_name", F.lit(""))).isin(V.PRIVILEGED_USERS)
    ip = F.coalesce("source_ip", F.lit(""))
    outside = (ip != "") & ~starts_with_any(ip, V.SCORER_INTERNAL_PREFIXES)
    return F.least(
        base + F.when(privileged, 15).otherwise(0) + F.when(outside, 10).otherwise(0), F.lit(100)).cast("bigint")


def score_findings(findings: DataFrame) -> DataFrame:
    """Individually scored findings of the lists that are prioritised."""
    base = look_up(F.col("list_name"), V.FINDING_BASE_SCORES, V.FINDING_BASE_SCORES["default"])
    return findings.filter(F.col("list_name").isin(V.PRIORITIZED_LISTS)).withColumn(
        "risk_score", finding_score(base)).withColumn("risk_level", banded(F.col("risk_score"), V.RISK_BANDS))


def prioritize(findings: DataFrame, n: int = 20) -> DataFrame:
    """The highest scored findings (a top-k report)."""
    return score_findings(findings).orderBy(
        F.desc("risk_score"), "ts", "event_id", "list_name", "finding_type", "details").limit(n)
