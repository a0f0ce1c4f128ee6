"""Mapping findings to ATT&CK techniques and tactics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from trailhound import fixed_values as V
from trailhound.functions.lookup import ROWS, count_where, rows_where
from trailhound.functions.text import first_contained
from trailhound.session import constant_table


def tactics(spark: SparkSession) -> DataFrame:
    return constant_table(
        spark, ["tactic_rank", "tactic_id", "tactic", "tactic_description"],
        [(i, *t) for i, t in enumerate(V.TACTICS, 1)])


def techniques(spark: SparkSession) -> DataFrame:
    return constant_table(
        spark, ["technique_id", "name", "tactic_id", "description", "detection", "mitigation"], V.TECHNIQUES)


def finding_techniques(spark: SparkSession) -> DataFrame:
    """Finding type to technique with everything a mapping shows, as one fixed table."""
    known = {t[0]: t for t in V.TECHNIQUES}
    tactic_ids = {name: i for i, name, _ in V.TACTICS}
    rows = []
    for kind, tid, name, confidence, tactic in V.FINDING_TECHNIQUES:
        full = known.get(tid)
        rows.append((
            kind, tid, name, tactic, tactic_ids[tactic], confidence, full[3] if full else "",
            full[4] if full else V.DEFAULT_DETECTION, full[5] if full else V.DEFAULT_MITIGATION))
    return constant_table(
        spark, ["key", "technique_id", "technique_name", "tactic", "tactic_id", "confidence",
                "technique_description", "detection", "mitigation"], rows)


def mapped_counts(findings: DataFrame) -> DataFrame:
    """Counts by what gets mapped: the six lists under their own name, anomalies under their type."""
    key = F.when(F.col("list_name") == "anomalies", F.col("finding_type")).when(
        F.col("list_name").isin(V.PRIORITIZED_LISTS), F.col("list_name"))
    kept = [c for c in findings.columns if c == ROWS]
    return (
        findings.select(key.alias("mapped_as"), (F.col("list_name") == "anomalies").alias("is_anomaly"), *kept)
        .filter("mapped_as is not null").groupBy("mapped_as", "is_anomaly")
        .agg(rows_where(findings).alias("n_findings")))


def map_findings(findings: DataFrame, alias: bool = False) -> DataFrame:
    """Technique, tactic and advice per mapped kind of finding, with its number of findings.

    The look-up is exact; ``alias`` also maps a type that merely contains a known name.
    """
    spark = findings.sparkSession
    counts = mapped_counts(findings)
    key = F.lower("mapped_as")
    if alias:
        key = F.coalesce(first_contained(key, [r[0] for r in V.FINDING_TECHNIQUES]), key)
    joined = counts.withColumn("key", key).join(F.broadcast(finding_techniques(spark)), "key", "left").drop("key")
    return joined.withColumns({k: F.coalesce(k, F.lit(v)) for k, v in V.UNMAPPED.items()}).withColumn(
        "tactic_id", F.coalesce("tactic_id", F.lit("Unknown")))


def tactic_summary(mapped: DataFrame) -> DataFrame:
    """Findings per tactic; known tactics carry their place in the attack order."""
    spark = mapped.sparkSession
    counts = mapped.groupBy("tactic").agg(F.sum("n_findings").alias("n_findings"))
    return counts.join(F.broadcast(tactics(spark).select("tactic", "tactic_rank")), "tactic", "left")


def attack_order(mapped: DataFrame) -> DataFrame:
    """Tactics present, numbered from 1 in attack order. At most one row per known tactic."""
    order = W.orderBy("tactic_rank")
    return tactic_summary(mapped).filter("tactic_rank is not null").select(
        "tactic", "n_findings", F.row_number().over(order).cast("bigint").alias("phase"))


def attack_flow(mapped: DataFrame) -> DataFrame:
    """One line of text: the tactics in order with their counts."""
    steps = F.array_sort(F.collect_list(F.struct("phase", "tactic", "n_findings")))
    texts = F.transform(steps, lambda s: F.concat(
        F.when(s["phase"] == 1, F.lit("Starts with ")).otherwise(F.lit("")), s["tactic"],
        F.when(s["n_findings"] > 1, F.concat(F.lit(" ("), s["n_findings"].cast("string"), F.lit(" techniques)")))
        .otherwise(F.lit(""))))
    flow = F.array_join(texts, " → ")
    return attack_order(mapped).agg(flow.alias("_f"), F.count(F.lit(1)).alias("n_tactics")).select(
        F.when(F.col("n_tactics") > 0, F.col("_f"))
        .otherwise(F.lit("No attack chain detected from findings.")).alias("attack_flow"), "n_tactics")


def mapping_totals(mapped: DataFrame) -> DataFrame:
    return mapped.agg(
        F.coalesce(F.sum("n_findings"), F.lit(0)).alias("total_mapped_findings"),
        (count_where(~F.col("is_anomaly"))
         + F.coalesce(F.sum(F.when(F.col("is_anomaly"), F.col("n_findings"))), F.lit(0)))
        .alias("techniques_used"))


def mitigations(mapped: DataFrame, n: int = 10) -> DataFrame:
    """Each mitigation text once, under the first technique that brings it."""
    known = {t[0] for t in V.TECHNIQUES}
    ranks = constant_table(
        mapped.sparkSession, ["mapped_as", "list_rank"], [(m, i) for i, m in enumerate(V.MITIGATION_LISTS)])
    rows = mapped.filter(~F.col("is_anomaly") & F.col("technique_id").isin(list(known))).join(
        F.broadcast(ranks), "mapped_as")
    first = W.partitionBy("mitigation").orderBy("list_rank")
    return (
        rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").orderBy("list_rank").limit(n)
        .select(
            F.col("technique_name").alias("technique"), "technique_id", "mitigation",
            F.when(F.col("confidence") == "HIGH", "HIGH").otherwise("MEDIUM").alias("priority")))


def technique_details(ids: DataFrame) -> DataFrame:
    """Full details of the techniques in a frame with ``technique_id``."""
    spark = ids.sparkSession
    subs = constant_table(spark, ["technique_id", "sub_id", "sub_name"], V.SUBTECHNIQUES)
    listed = subs.groupBy("technique_id").agg(F.array_join(F.array_sort(F.collect_list(
        F.concat_ws(" ", "sub_id", "sub_name"))), ", ").alias("subtechniques"))
    return (
        ids.select("technique_id").distinct().join(F.broadcast(techniques(spark)), "technique_id")
        .join(F.broadcast(tactics(spark).select("tactic_id", F.col("tactic").alias("tactic_name"))), "tactic_id")
        .join(F.broadcast(listed), "technique_id", "left")
        .select(
            "technique_id", F.col("name").alias("technique_name"), "tactic_id", "tactic_name", "description",
            "detection", "mitigation", F.coalesce("subtechniques", F.lit("")).alias("subtechniques")))
