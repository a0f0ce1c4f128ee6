"""Report tables and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailhound import fixed_values as V
from trailhound.functions.lookup import banded, rows_where
from trailhound.operators.aggregates import finding_severity_counts

TECHNICAL_LISTS = [
    "failed_logins", "suspicious_powershell", "privilege_escalation", "lateral_movement",
    "persistence_attempts", "high_risk_commands", "anomalies",
]


#: Files that the rows of one day are dealt into at most, so that a busy day is not one task's.
DAY_FILES = 16


def executive_summary(score: DataFrame, findings: DataFrame) -> DataFrame:
    """Risk score and level with finding counts: two one-row aggregates, joined as scalar subqueries."""
    counts = finding_severity_counts(findings)
    one = score.select("risk_score", "total_events")
    return counts.select(
        one.select("risk_score").scalar().alias("risk_score"),
        banded(one.select("risk_score").scalar(), V.DASHBOARD_BANDS).alias("risk_level"),
        one.select("total_events").scalar().alias("total_events"),
        "critical_count", "high_count", "medium_count", "low_count", "total_findings")


def technical_counts(findings: DataFrame) -> DataFrame:
    return findings.filter(F.col("list_name").isin(TECHNICAL_LISTS)).groupBy("list_name").agg(
        rows_where(findings).alias("n"))


def indicator_table(iocs: DataFrame, n: int = 10) -> DataFrame:
    return iocs.filter("kind = 'ip'").orderBy(F.desc("n_events"), "value").limit(n).select("value", "n_events")


def markdown_report(summary: DataFrame, technical: DataFrame, indicators: DataFrame, advice: DataFrame) -> DataFrame:
    """The report tables as one Markdown text. The parts are a summary row, one row per list, and two top-k tables,
    so what is gathered here has a fixed size."""
    def lines(part: int, df: DataFrame, order, text) -> DataFrame:
        return df.select(F.lit(part).alias("part"), order.alias("pos"), text.alias("line"))

    def heading(part: int, text: str) -> DataFrame:
        return summary.select(F.lit(part).alias("part"), F.lit("").alias("pos"), F.lit(text).alias("line"))

    s = summary.select(
        F.lit(1).alias("part"), F.lit("").alias("pos"), F.concat(
            F.lit("- **Risk Score:** "), F.col("risk_score").cast("string"), F.lit("/100\n- **Risk Level:** "),
            F.col("risk_level"), F.lit("\n- **Total Events Analyzed:** "),
            F.col("total_events").cast("string")).alias("line"))
    rows = (
        heading(0, "# Security Incident Report\n\n## Executive Summary").unionByName(s)
        .unionByName(heading(2, "\n## Technical Findings\n\n| Finding Type | Count |\n|---|---|"))
        .unionByName(lines(3, technical, F.col("list_name"), F.concat(
            F.lit("| "), F.initcap(F.replace("list_name", F.lit("_"), F.lit(" "))), F.lit(" | "),
            F.col("n").cast("string"), F.lit(" |"))))
        .unionByName(heading(4, "\n## Indicators of Compromise"))
        .unionByName(lines(5, indicators, F.format_string("%012d %s", F.lit(10**11) - F.col("n_events"), "value"),
                           F.concat(F.lit("- `"), "value", F.lit("`"))))
        .unionByName(heading(6, "\n## Recommendations"))
        .unionByName(lines(7, advice, F.format_string("%03d", "rank"), F.concat(
            F.col("rank").cast("string"), F.lit(". "), "recommendation"))))
    ordered = F.array_sort(F.collect_list(F.struct("part", "pos", "line")))
    return rows.agg(F.array_join(F.transform(ordered, lambda r: r["line"]), "\n").alias("markdown"))


def technique_markdown(mapped: DataFrame) -> DataFrame:
    """Technique table lines, one per mapped kind."""
    return mapped.select("mapped_as", F.concat(
        F.lit("| "), "technique_id", F.lit(" | "), "technique_name", F.lit(" | "), "tactic", F.lit(" | "),
        "confidence", F.lit(" |")).alias("line"))


def write(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> str:
    """Write a table. Parquet is the default; text columns only for ``text``."""
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        writer.format(fmt).save(path)
    return path


def write_days(df: DataFrame, path: str, time: str = "ts", day: str = "day") -> str:
    """Rows into one folder per day, so that a run may be repeated: the days among ``df`` are replaced, all others stay.

    Rows without a time go to a folder of their own. ``day`` is added as the partition column.
    """
    dated = df.withColumn(day, F.to_date(time)).repartition(day, F.pmod(F.xxhash64(*df.columns), F.lit(DAY_FILES)))
    dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)
    return path


def read_between(spark: SparkSession, path: str, first: Column, end: Column, time: str = "ts", day: str = "day") -> DataFrame:
    """Rows written by :func:`write_days` with ``first <= time < end``; only the folders of these days are listed and read."""
    within = (F.col(day) >= F.to_date(first)) & (F.col(day) <= F.to_date(end))
    return spark.read.parquet(path).filter(within & (F.col(time) >= first) & (F.col(time) < end))


def write_all(df: DataFrame, folder: str, formats: tuple[str, ...] = ("json", "csv", "parquet")) -> dict[str, str]:
    """Several formats of one table. The rows are computed once, as Parquet, and the others are written from it."""
    base = write(df, f"{folder}/parquet")
    stored = df.sparkSession.read.parquet(base)
    return {fmt: base if fmt == "parquet" else write(stored, f"{folder}/{fmt}", fmt) for fmt in formats}
