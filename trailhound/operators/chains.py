"""Correlations, attack chains and their classification, as column maths on the one-pass pattern counts.

Inputs are the ``pattern_counts`` of the detectors: one row per group, so nothing here grows with the events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailhound import fixed_values as V
from trailhound.functions.lookup import banded
from trailhound.session import constant_table


def flags() -> dict[str, Column]:
    """Which pattern clusters of a counts row are over their thresholds."""
    out = {name: F.col(name) > minimum for name, _, minimum in V.PATTERN_CLUSTERS}
    out["off_hours_activity"] = F.col("off_hours_activity") > F.col("total_events") * F.lit(V.OFF_HOURS_SHARE)
    return out


def correlation_array() -> Column:
    f = flags()
    return F.array_compact(F.array(
        F.when(f["authentication_failure_cluster"] & f["privilege_escalation"],
               F.lit("authentication_failure_to_privilege_escalation")),
        F.when(f["privilege_escalation"] & f["ransomware_indicators"],
               F.lit("privilege_escalation_to_ransomware"))))


def correlations(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return counts.select(*by, F.explode(correlation_array()).alias("correlation"))


def chain_confidence() -> Column:
    """95 with ransomware, 75 with database trouble, 50 for any other chain, null without a chain."""
    f = flags()
    return (
        F.when(f["ransomware_indicators"], 95).when(f["database_availability"], 75)
        .when(f["authentication_failure_cluster"] | f["privilege_escalation"], 50))


def _rule_array(pick) -> Column:
    f = flags()
    rules = sorted(V.CHAIN_RULES, key=lambda r: r[4])
    values = [(r[0], pick(r)) for r in rules]
    return F.array_compact(F.array(*[F.when(f[p], F.lit(v)) for p, v in values if v is not None]))


def phases() -> Column:
    return _rule_array(lambda r: r[1])


def techniques() -> Column:
    return _rule_array(lambda r: r[2] if r[3] else None)


def attack_chain(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return counts.select(
        *by, F.lit("CHAIN-001").alias("chain_id"), chain_confidence().cast("bigint").alias("confidence"),
        phases().alias("phases"), techniques().alias("techniques")).filter("confidence is not null")


def chain_assets(assets: DataFrame, n: int = 5) -> DataFrame:
    """The first assets of each kind, by first appearance.

    The kinds are a handful and the row-number filter keeps only ``n`` rows per task before the shuffle.
    """
    from pyspark.sql import Window as W

    order = W.partitionBy("kind").orderBy("first_ts", "value")
    return assets.filter(F.col("kind").isin("user", "host", "service", "ip")).withColumn(
        "rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= n).select("kind", "rank", "value")


def classify(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Incident type, severity, urgency, root cause and final band from the pattern flags."""
    f = flags()
    ransom, priv = f["ransomware_indicators"], f["privilege_escalation"]
    auth, db = f["authentication_failure_cluster"], f["database_availability"]
    confidence = chain_confidence()
    return counts.select(
        *by,
        F.when(ransom, "RANSOMWARE ATTACK").when(priv & auth, "CREDENTIAL COMPROMISE")
        .when(priv, "PRIVILEGE ESCALATION").when(db, "DATABASE AVAILABILITY")
        .otherwise("SUSPICIOUS ACTIVITY").alias("incident_type"),
        F.when(ransom, "CRITICAL").when(priv & db, "HIGH").when(priv, "MEDIUM-HIGH")
        .otherwise("MEDIUM").alias("incident_severity"),
        F.when(ransom, "IMMEDIATE RESPONSE REQUIRED").when(priv & db, "URGENT INVESTIGATION REQUIRED")
        .when(priv, "PRIORITY INVESTIGATION").otherwise("INVESTIGATE WITHIN 24 HOURS").alias("urgency"),
        F.when(ransom, "credential_compromise_to_ransomware")
        .when(priv & auth, "credential_compromise_with_privilege_escalation")
        .when(priv, "insider_or_malicious_privilege_escalation").otherwise("undetermined").alias("root_cause"),
        F.when(ransom, 85).when(priv & auth, 70).when(priv, 50).otherwise(30).cast("bigint")
        .alias("root_cause_confidence"),
        F.when(confidence.isNull(), "LOW").otherwise(banded(confidence, V.FINAL_RISK_BANDS)).alias("final_risk"))


def coverage(counts: DataFrame) -> DataFrame:
    """The fixed technique sequence against the techniques found: a left join of two tiny tables."""
    spark = counts.sparkSession
    steps = constant_table(
        spark, ["step", "tactic", "technique_id", "technique_name"],
        [(i, *s) for i, s in enumerate(V.COVERAGE_STEPS, 1)])
    found = counts.select(F.explode(techniques()).alias("technique_id")).distinct().withColumn(
        "detected", F.lit(True))
    return steps.join(F.broadcast(found), "technique_id", "left").select(
        "step", "tactic", "technique_id", "technique_name",
        F.coalesce("detected", F.lit(False)).alias("detected"))


def coverage_gaps(counts: DataFrame) -> DataFrame:
    return coverage(counts).filter("not detected").drop("detected")


def chain_techniques(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Techniques of the chain with the chain's confidence."""
    known = constant_table(
        counts.sparkSession, ["technique_id", "technique_name", "tactic"], V.AGENT_TECHNIQUES)
    rows = attack_chain(counts, by).select(*by, "confidence", F.explode("techniques").alias("technique_id"))
    return rows.join(F.broadcast(known), "technique_id").select(
        *by, "technique_id", "technique_name", "tactic", "confidence")
