"""Counts, matrices and summaries. Every group-by combines on the map side, so a hot key costs one row per task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from trailhound import fixed_values as V
from trailhound.functions.lookup import count_where, rows_where
from trailhound.operators.distinct import ROWS, exact_counts, value_table
from trailhound.session import constant_table


def value_counts(df: DataFrame, *columns: str, name: str = "n") -> DataFrame:
    return df.groupBy(*columns).agg(rows_where(df).alias(name))


def ranked_counts(df: DataFrame, *columns: str, name: str = "n", limit: int | None = None) -> DataFrame:
    """Counts per non-null value, largest first, ties by value."""
    kept = df
    for c in columns:
        kept = kept.filter(F.col(c).isNotNull())
    counts = value_counts(kept, *columns, name=name).orderBy(F.desc(name), *columns)
    return counts if limit is None else counts.limit(limit)


def hourly(df: DataFrame) -> DataFrame:
    return (
        df.filter(F.col("ts").isNotNull())
        .groupBy(F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("hour"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def heatmap(df: DataFrame) -> DataFrame:
    """Date by hour-of-day counts: 24 conditional counts in one aggregate."""
    hour = F.hour("ts")
    return (
        df.filter(F.col("ts").isNotNull()).groupBy(F.to_date("ts").alias("day"))
        .agg(*[count_where(hour == h).alias(f"h{h:02d}") for h in range(24)])
    )


def top_indicators(iocs: DataFrame, limit: int = 10) -> DataFrame:
    """Most frequent values of an indicator table."""
    return (
        iocs.groupBy("value").agg(F.sum("n_events").alias("n"))
        .orderBy(F.desc("n"), "value").limit(limit)
    )


def top_terms(df: DataFrame, text: str = "text", limit: int = 50, stop_words: list[str] = V.STOP_WORDS) -> DataFrame:
    """Most frequent words of the whole texts."""
    return (
        terms(df, text, stop_words).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "term").limit(limit)
    )


def terms(df: DataFrame, text: str = "text", stop_words: list[str] = V.STOP_WORDS) -> DataFrame:
    """The words of the whole texts, a row for each."""
    word = F.explode(F.split(F.lower(F.col(text)), r"\W+")).alias("term")
    return df.select(word).filter((F.col("term") != "") & ~F.col("term").isin(stop_words))


def finding_severity_counts(findings: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Findings by severity: outside the four levels a list item counts as low and an anomaly as medium."""
    severity = F.col("severity")
    anomaly = F.col("list_name") == "anomalies"
    known = F.coalesce(severity.isin("CRITICAL", "HIGH"), F.lit(False))
    medium = F.coalesce(severity == "MEDIUM", F.lit(False))
    return findings.groupBy(*by).agg(
        rows_where(findings, severity == "CRITICAL").alias("critical_count"),
        rows_where(findings, severity == "HIGH").alias("high_count"),
        rows_where(findings, ~known & (anomaly | medium)).alias("medium_count"),
        rows_where(findings, ~known & ~anomaly & ~medium).alias("low_count"),
        rows_where(findings).alias("total_findings"),
    )


def categories(findings: DataFrame) -> DataFrame:
    return ranked_counts(findings, "list_name")


def before_after(findings: DataFrame, split: Column) -> DataFrame:
    """Category counts before and after a remediation time, on the categories seen before it, in one aggregate."""
    return (
        findings.groupBy("list_name")
        .agg(count_where(F.col("ts") < split).alias("n_before"), count_where(F.col("ts") >= split).alias("n_after"))
        .filter("n_before > 0")
    )


def dashboard(df: DataFrame) -> DataFrame:
    severity = F.col("severity")
    high = severity.isin(V.DASHBOARD_HIGH_SEVERITIES)
    values = value_table(
        df, {"suspicious_ips": F.when(high, F.col("source_ip")), "suspicious_users": F.when(high, F.col("user_name"))},
        {"critical_events": severity == "CRITICAL", "high_events": severity.isin("HIGH", "ERROR", "ALERT")})
    return exact_counts(values, ["suspicious_ips", "suspicious_users"], [ROWS, "critical_events", "high_events"]).withColumnRenamed(
        ROWS, "total_events")


def top_per_group(df: DataFrame, group: str, value: str, n: int = 5) -> DataFrame:
    """Most frequent values within each group; the row-number filter limits each task before the shuffle."""
    counts = value_counts(df.filter(F.col(value).isNotNull()), group, value)
    order = W.partitionBy(group).orderBy(F.desc("n"), value)
    return counts.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= n)


def tactic_counts(mapped: DataFrame) -> DataFrame:
    """Findings per tactic and in all, from findings already mapped to techniques."""
    return mapped.groupBy("tactic").agg(F.sum("n_findings").alias("n_findings"))


def technique_matrix(mapped: DataFrame) -> DataFrame:
    """The fixed tactics, in order, with the technique names seen under each (text joined by commas)."""
    spark = mapped.sparkSession
    tactics = constant_table(spark, ["rank", "tactic"], list(enumerate(V.MATRIX_TACTICS, 1)))
    names = mapped.groupBy("tactic").agg(
        F.array_join(F.array_sort(F.collect_set("technique_name")), ", ").alias("techniques"))
    return tactics.join(F.broadcast(names), "tactic", "left").select(
        "rank", "tactic", F.coalesce("techniques", F.lit("")).alias("techniques"))
