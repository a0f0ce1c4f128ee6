"""One analysis that every score, mapping, plan and report starts from.

The events are read once: each row rule that fires, and each event itself, adds to a count by keys, rule family, finding type, list
and severity, with the first and last time. The table of these counts is small whatever the input, is stored, and can be added up:
counts of days, files or batches merge into the counts of all of them. Anomalies follow from the merged
counts, so they are never added up themselves.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailhound import fixed_values as V
from trailhound.functions.lookup import ROWS, count_where
from trailhound.operators import detect, timeline
from trailhound.session import Stored, store

EVENT = "event"
NAMES = ["rule", "finding_type", "list_name", "severity"]
SUMS = ["n", "n_timed", "n_off_hours"]


def partial_counts(df: DataFrame, keys: tuple[str, ...] = ("host",), text: str = "raw_log") -> DataFrame:
    """Counts of events and of row findings, in one scan and one map-side-combined group-by."""
    lowered = "_lower"
    prepared = df.select(*keys, "severity", "ts", F.lower(F.col(text)).alias(lowered))
    none = F.lit(None).cast("string")
    event = F.struct(F.lit(EVENT).alias("rule"), none.alias("finding_type"), none.alias("list_name"), F.col("severity"))
    hits = [
        F.when(hit.isNotNull(), F.struct(F.lit(rule).alias("rule"), *[hit[c].alias(c) for c in NAMES[1:]]))
        for rule, made in detect.hits_by_rule(F.col(lowered)).items() for hit in made]
    entries = prepared.select(*keys, "ts", F.explode(F.array(event, *hits)).alias("_entry")).filter("_entry is not null")
    return entries.groupBy(*keys, *[F.col(f"_entry.{c}").alias(c) for c in NAMES]).agg(
        F.count(F.lit(1)).alias("n"), F.count("ts").alias("n_timed"),
        count_where(F.hour("ts").isin(V.OFF_HOURS)).alias("n_off_hours"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def merged(*tables: DataFrame, keys: tuple[str, ...] = ("host",)) -> DataFrame:
    """The counts of several inputs added up, by the same keys or by fewer."""
    rows = reduce(DataFrame.unionByName, [t.select(*keys, *NAMES, *SUMS, "first_ts", "last_ts") for t in tables])
    return rows.groupBy(*keys, *NAMES).agg(
        *[F.sum(c).cast("bigint").alias(c) for c in SUMS], F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))


@dataclass(frozen=True)
class Analysis:
    """A table of counts and what follows from it. ``stored`` is the handle of the table, where this analysis wrote it."""

    counts: DataFrame
    keys: tuple[str, ...] = ("host",)
    stored: Stored | None = None

    def profile(self, by: tuple[str, ...] = ()) -> DataFrame:
        """What :func:`detect.severity_profile` counts in the events, added up from the table."""
        rule = F.col("rule")

        def total(test: Column, column: str = "n") -> Column:
            return F.coalesce(F.sum(F.when(test, F.col(column))), F.lit(0)).cast("bigint")

        event, keyword = rule == EVENT, rule == "keyword"
        # only events and failed logins carry the severity of the event; the rest are counted beside them
        level = F.when(event | (rule == "failed_login"), F.col("severity"))
        return self.counts.groupBy(*by, level.alias("_level")).agg(
            total(event).alias("n_events"), total(rule == "failed_login").alias("n_auth_fail"),
            total(event, "n_off_hours").alias("n_off_hours"), total(event, "n_timed").alias("n_timed"),
            total(keyword & (F.col("severity") == "CRITICAL")).alias("n_keyword_critical"),
            total(keyword & (F.col("severity") == "HIGH")).alias("n_keyword_high"),
            F.max(F.when(event, F.col("last_ts"))).alias("latest_ts"),
        ).withColumnRenamed("_level", "severity")

    def findings(self) -> DataFrame:
        """A table of counts of all findings: each row stands for ``n_rows`` findings, the latest of them at ``ts``."""
        columns = [*self.keys, *NAMES[1:], "ts", ROWS]
        rows = self.counts.filter(F.col("rule") != EVENT).withColumns({"ts": F.col("last_ts"), ROWS: F.col("n")}).select(*columns)
        anomalies = detect.aggregate_anomalies(self.profile()).withColumn(ROWS, F.lit(1).cast("bigint"))
        missing = {k: F.lit(None).cast(rows.schema[k].dataType) for k in self.keys if k not in anomalies.columns}
        return rows.unionByName(anomalies.withColumns(missing).select(*columns))

    def remove(self) -> None:
        if self.stored:
            self.stored.remove()


def analyse(df: DataFrame, keys: tuple[str, ...] = ("host",), text: str = "raw_log") -> Analysis:
    """Read the events once and store their counts. The handle (``Analysis.remove``) deletes the table again."""
    kept = store(partial_counts(df, keys, text), "counts")
    return Analysis(kept.rows, keys, kept)


def top_findings(df: DataFrame, n: int = 20) -> DataFrame:
    """The highest scored findings: a top-k over one scan, which counts cannot give. Anomalies are not among the scored lists."""
    return timeline.prioritize(detect.row_findings(df).select(*detect.FINDING_COLUMNS), n)
