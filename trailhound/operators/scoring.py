"""Risk scores: column maths on one counts row per group.

Events and findings are reduced by a single map-side-combined group-by; all formulas then work on that row.
``by=()`` scores the whole input, ``by=("host",)`` each host, and so on, at the same cost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailhound import fixed_values as V
from trailhound.functions.lookup import ROWS, banded, count_where, look_up, rows_where
from trailhound.functions.times import age_banded, as_time, seconds_between
from trailhound.operators import chains, detect
from trailhound.operators.iocs import external_ip
from trailhound.operators.timeline import score_findings

HOUR, DAY, WEEK, MONTH = 3600, 86400, 604800, 2592000


def _at_most_100(value: Column) -> Column:
    return F.least(value, F.lit(100.0))


# --- detector score -----------------------------------------------------------------------------

def detector_score(profile: DataFrame, as_of: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The detector's risk score from the severity profile of the events."""
    severity, n = F.col("severity"), F.col("n_events")
    weight = look_up(F.upper(severity), V.SEVERITY_WEIGHTS, V.DEFAULT_SEVERITY_WEIGHT)
    part = F.when(severity.isNotNull(), _at_most_100(weight * F.least(n, F.lit(10)) / F.lit(10.0)))
    critical_row = severity == "CRITICAL"
    high_row = severity == "HIGH"
    auth = F.col("n_auth_fail")
    raised_critical = severity.isin(V.CRITICAL_ANOMALY_SEVERITIES)
    raised_high = severity.isin(V.HIGH_ANOMALY_SEVERITIES) & ~raised_critical

    def total(c) -> Column:
        return F.coalesce(F.sum(c), F.lit(0))

    groups = profile.groupBy(*by).agg(
        F.sum(part).alias("_weighted"), F.count(part).alias("_levels"), F.sum("n_events").alias("total_events"),
        F.max("latest_ts").alias("latest_ts"), total("n_auth_fail").alias("_auth"),
        (total("n_keyword_critical") + total(F.when(critical_row, auth)) + count_where(raised_critical))
        .alias("critical_count"),
        (total("n_keyword_high") + total(F.when(high_row, auth)) + count_where(raised_high)).alias("_high"),
    )
    brute = F.when(F.col("_auth") > V.BRUTE_FORCE_MIN, 1).otherwise(0)
    total_events = F.col("total_events")
    volume = (
        F.when(total_events > 100, _at_most_100(F.lit(70.0) + (total_events - 100) / F.lit(10.0)))
        .when(total_events > 50, 50.0).when(total_events > 20, 30.0).when(total_events > 10, 20.0).otherwise(10.0))
    parts = groups.withColumns({
        "high_count": F.col("_high") + brute,
        "severity_score": F.coalesce(_at_most_100(F.col("_weighted") / F.col("_levels")), F.lit(0.0)),
        "volume_score": volume,
        "recency_score": age_banded(
            F.col("latest_ts"), as_of, [(HOUR, 100), (DAY, 80), (WEEK, 50)], 30, 50).cast("double"),
    }).withColumn(
        "detection_score", _at_most_100(F.col("critical_count") * 20.0 + F.col("high_count") * 10.0))
    score = (
        F.col("severity_score") * 0.4 + F.col("detection_score") * 0.3 + F.col("volume_score") * 0.15
        + F.col("recency_score") * 0.15)
    return parts.select(
        *by, "total_events", "critical_count", "high_count", F.round("severity_score", 6).alias("severity_score"),
        "detection_score", "volume_score", "recency_score",
        # the rounding removes binary noise, so that a sum that is a whole number is not cut below it
        F.least(F.floor(F.round(score, 9)), F.lit(100)).cast("bigint").alias("risk_score"))


def recency(df: DataFrame, as_of: str, by: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.max("ts").alias("latest_ts")).withColumn(
        "recency_score",
        age_banded(F.col("latest_ts"), as_of, [(HOUR, 100), (DAY, 80), (WEEK, 50)], 30, 50).cast("bigint"))


# --- findings score -----------------------------------------------------------------------------

def finding_profile(findings: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row per group with every count the finding scores use. ``findings`` may be a table of counts of findings."""

    def count(condition: Column | None = None) -> Column:
        return rows_where(findings, condition)

    kind, list_name = F.col("finding_type"), F.col("list_name")
    anomaly = list_name == "anomalies"
    level = F.col("severity")
    lists = ["failed_logins", "suspicious_powershell", "privilege_escalation", "lateral_movement",
             "persistence_attempts", "data_exfiltration"]
    scored = (list_name.isin(V.RECENCY_LISTS)) | anomaly
    return findings.groupBy(*by).agg(
        *[count(kind == t).alias(f"type_{t}") for t in V.FINDING_BASE_SCORES],
        *[count((list_name == n) | (kind == n)).alias(f"list_{n}") for n in lists],
        *[count(anomaly & (level == s)).alias(f"anomaly_{s}") for s in V.ANOMALY_SCORES],
        count(anomaly & ~F.coalesce(level.isin(list(V.ANOMALY_SCORES)), F.lit(False))).alias("anomaly_other"),
        count(anomaly).alias("anomalies"),
        count(anomaly & F.lower(kind).contains("exfiltration")).alias("anomaly_exfiltration"),
        count(anomaly & F.lower(kind).contains("ransomware")).alias("anomaly_ransomware"),
        count().alias("total_findings"),
        F.max(F.when(scored, F.col("ts"))).alias("latest_ts"),
        F.max(F.when(list_name.isin(V.RECENT_LISTS), F.col("ts"))).alias("latest_serious_ts"),
    )


def severity_score() -> Column:
    """The most severe contribution: base score by type weighted by count, or an anomaly's severity."""
    parts = [F.lit(0.0)]
    for kind, base in V.FINDING_BASE_SCORES.items():
        n = F.col(f"type_{kind}")
        parts.append(F.when(n > 0, F.lit(float(base)) * F.least(n / F.lit(10.0), F.lit(1.5))))
    for level, points in V.ANOMALY_SCORES.items():
        parts.append(F.when(F.col(f"anomaly_{level}") > 0, F.lit(float(points))))
    parts.append(F.when(F.col("anomaly_other") > 0, F.lit(50.0)))
    return _at_most_100(F.greatest(*parts))


def volume_score() -> Column:
    n = F.col("total_findings")
    return (
        F.when(n == 0, 0.0).when(n <= 5, 20.0).when(n <= 20, 40.0).when(n <= 50, 60.0).when(n <= 100, 80.0)
        .otherwise(100.0))


def recency_score(as_of: str) -> Column:
    return age_banded(
        F.col("latest_ts"), as_of, [(HOUR, 100), (DAY, 85), (WEEK, 60), (MONTH, 40)], 20, 50).cast("double")


def _points(rules: list[tuple[str, int]]) -> Column:
    return sum((F.when(F.col(f"list_{n}") > 0, p).otherwise(0) for n, p in rules), F.lit(0))


def impact_score() -> Column:
    """``asset_points`` is a tenth of the criticality of the affected assets, 0 where none are given."""
    return _at_most_100(
        _points(V.IMPACT_POINTS) + F.col("anomaly_exfiltration") * 30 + F.col("anomaly_ransomware") * 50
        + F.col("asset_points"))


def likelihood_score() -> Column:
    failed = F.col("list_failed_logins")
    return _at_most_100((
        F.when(failed > 50, 30).when(failed > 20, 20).when(failed > 5, 10).otherwise(0)
        + _points(V.LIKELIHOOD_POINTS) + F.least(F.col("anomalies") * 5, F.lit(25))).cast("double"))


def contributing_factors(as_of: str) -> Column:
    def n(name: str) -> Column:
        return F.col(name).cast("string")

    def when_any(name: str, head: str, tail: str, above: int = 0) -> Column:
        return F.when(F.col(name) > above, F.concat(F.lit(head), n(name), F.lit(tail)))

    recent = seconds_between(as_time(as_of), F.col("latest_serious_ts")) < F.lit(float(HOUR))
    return F.slice(F.array_compact(F.array(
        when_any("list_suspicious_powershell", "Suspicious PowerShell execution (", " instances)"),
        when_any("list_lateral_movement", "Lateral movement detected (", " attempts)"),
        when_any("list_privilege_escalation", "Privilege escalation attempts (", " events)"),
        when_any("list_persistence_attempts", "Persistence mechanisms detected (", " attempts)"),
        when_any("list_failed_logins", "High volume of failed logins (", " attempts)", 20),
        when_any("anomalies", "Multiple anomalies detected (", ")", 5),
        F.when(recent, F.lit("Recent activity detected - immediate attention required")),
        when_any("total_findings", "High volume of security events (", " total)", 50),
    )), 1, 10)


def asset_points(findings: DataFrame, assets: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """A tenth of the criticality of the distinct assets with findings, per group."""
    key = "_asset_host"
    touched = findings.filter(F.col("host").isNotNull()).select(*by, F.col("host").alias(key)).distinct()
    points = look_up(F.lower("asset_type"), V.ASSET_CRITICALITY, 40) * F.lit(0.1)
    joined = touched.join(assets.select("asset_name", points.alias("_p")), F.col(key) == F.col("asset_name"))
    return joined.groupBy(*by).agg(F.round(F.sum("_p"), 6).alias("asset_points"))


def overall_risk(
    findings: DataFrame, as_of: str, by: tuple[str, ...] = (), assets: DataFrame | None = None,
) -> DataFrame:
    """The five component scores, their weighted mean, level, action, time frame and factors."""
    counts = finding_profile(findings, by)
    if assets is None:
        counts = counts.withColumn("asset_points", F.lit(0.0))
    elif by:
        counts = counts.join(asset_points(findings, assets, by), list(by), "left").na.fill({"asset_points": 0.0})
    else:
        points = asset_points(findings, assets).select(F.coalesce("asset_points", F.lit(0.0))).scalar()
        counts = counts.withColumn("asset_points", points)
    scored = counts.withColumns({
        "severity_score": severity_score(), "volume_score": volume_score(),
        "recency_score": recency_score(as_of), "impact_score": impact_score(),
        "likelihood_score": likelihood_score()})
    overall = (
        F.col("severity_score") * 0.35 + F.col("volume_score") * 0.15 + F.col("recency_score") * 0.15
        + F.col("impact_score") * 0.20 + F.col("likelihood_score") * 0.15)
    return scored.withColumn("_overall", F.round(overall, 9)).select(
        *by, F.round("_overall", 2).alias("overall_risk_score"),
        banded(F.col("_overall"), V.RISK_BANDS, 1).alias("risk_level"),
        *[F.round(c, 2).alias(c) for c in (
            "severity_score", "volume_score", "recency_score", "impact_score", "likelihood_score")],
        banded(F.col("_overall"), V.RISK_BANDS, 2).alias("recommended_action"),
        banded(F.col("_overall"), V.RISK_BANDS, 3).alias("response_timeframe"),
        F.array_join(contributing_factors(as_of), "; ").alias("contributing_factors"))


def component(findings: DataFrame, name: str, score: Column, by: tuple[str, ...] = ()) -> DataFrame:
    counts = finding_profile(findings, by).withColumn("asset_points", F.lit(0.0))
    return counts.select(*by, F.round(score, 2).alias(name))


def risk_bands(df: DataFrame, score: str) -> DataFrame:
    return df.withColumns({
        "risk_level": banded(F.col(score), V.RISK_BANDS, 1),
        "recommended_action": banded(F.col(score), V.RISK_BANDS, 2),
        "response_timeframe": banded(F.col(score), V.RISK_BANDS, 3)})


def asset_risk(findings: DataFrame, assets: DataFrame) -> DataFrame:
    """Risk per asset from its criticality and the mean base score of its findings.

    Findings are summed per host first, so the join sees one row per host however hot a host is.
    """
    base = look_up(F.col("finding_type"), V.FINDING_BASE_SCORES, V.FINDING_BASE_SCORES["default"])
    rows = F.col(ROWS) if ROWS in findings.columns else F.lit(1)
    per_host = findings.filter(F.col("host").isNotNull()).groupBy("host").agg(
        F.sum(rows).alias("finding_count"), (F.sum(base.cast("double") * rows) / F.sum(rows)).alias("_mean"))
    criticality = look_up(F.col("asset_type"), V.ASSET_CRITICALITY, 40)
    risk = F.round(criticality * F.lit(0.6) + F.coalesce("_mean", F.lit(0.0)) * F.lit(0.4), 9)
    joined = assets.join(per_host, F.col("asset_name") == F.col("host"), "left").withColumn("_risk", risk)
    advice = [(low, text.replace("{}", "%s")) for low, text in V.ASSET_ADVICE]
    return joined.select(
        "asset_name", "asset_type", criticality.cast("bigint").alias("asset_criticality"),
        F.coalesce("finding_count", F.lit(0)).alias("finding_count"), F.round("_risk", 2).alias("risk_score"),
        banded(F.col("_risk"), V.RISK_BANDS).alias("risk_level"),
        F.replace(banded(F.col("_risk"), advice), F.lit("%s"), F.col("asset_type")).alias("recommendation"))


def risk_metrics(findings: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return score_findings(findings).groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_findings"),
        count_where(F.col("risk_level") == "CRITICAL").alias("critical_findings"),
        count_where(F.col("risk_level") == "HIGH").alias("high_findings"),
        F.round(F.coalesce(F.avg("risk_score"), F.lit(0.0)), 6).alias("average_risk_score"))


def recommendations(overall: DataFrame, top: DataFrame, n: int = 8) -> DataFrame:
    """Advice from the overall score and the lists among the top findings (``top`` has ``list_name``, ``rank``)."""
    def among(name: str, first: int) -> Column:
        return F.max((F.col("list_name") == name) & (F.col("rank") <= first)).alias(f"has_{name}")

    seen = top.agg(
        among("suspicious_powershell", 5), among("lateral_movement", 5), among("privilege_escalation", 5),
        among("failed_logins", 10))
    score = overall.select("overall_risk_score").scalar()
    tests = {"score": score >= 70, "always": F.lit(True)}
    for name in ("suspicious_powershell", "lateral_movement", "privilege_escalation", "failed_logins"):
        tests[name] = F.coalesce(F.col(f"has_{name}"), F.lit(False))
    texts = [F.when(tests[k], F.lit(t)) for k, group in V.RECOMMENDATION_RULES.items() for t in group]
    return seen.select(F.posexplode(F.slice(F.array_compact(F.array(*texts)), 1, n))).select(
        (F.col("pos") + 1).cast("bigint").alias("rank"), F.col("col").alias("recommendation"))


def decay(age_seconds: Column) -> Column:
    result = F.when(age_seconds < V.TIME_DECAY[0][0], V.TIME_DECAY[0][1])
    for limit, factor in V.TIME_DECAY[1:]:
        result = result.when(age_seconds < limit, factor)
    return result.otherwise(V.TIME_DECAY_OLDER)


def decayed_findings(findings: DataFrame, as_of: str) -> DataFrame:
    """Individually scored findings with their score weighted by age."""
    age = seconds_between(as_time(as_of), F.col("ts"))
    return score_findings(findings).withColumn("decayed_score", F.round(F.col("risk_score") * decay(age), 6))


# --- dashboard, agent and report scores ---------------------------------------------------------

def dashboard_score(dashboard: DataFrame) -> DataFrame:
    score = F.least(
        F.lit(100), F.col("critical_events") * 10 + F.col("high_events") * 5 + F.col("suspicious_ips"))
    return dashboard.select(
        score.cast("bigint").alias("risk_score"), banded(score, V.DASHBOARD_BANDS).alias("risk_level"))


def _auth_significance() -> Column:
    return F.when(F.col("authentication_failure_cluster") > V.AUTH_CLUSTER_HIGH, 75).otherwise(50)


def agent_score(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean of the mean pattern significance and the chain confidence."""
    f = chains.flags()
    points = [
        F.when(f["authentication_failure_cluster"], _auth_significance()), F.when(f["privilege_escalation"], 75),
        F.when(f["database_availability"], 75), F.when(f["ransomware_indicators"], 95),
        F.when(f["off_hours_activity"], 50)]
    found = F.array_compact(F.array(*points))
    total = sum((F.coalesce(p, F.lit(0)) for p in points), F.lit(0))
    mean = F.when(F.size(found) > 0, total / F.size(found)).otherwise(20.0)
    confidence = F.coalesce(chains.chain_confidence(), F.lit(20))
    score = F.floor(F.round((mean + confidence) / 2.0, 9)).cast("bigint")
    return counts.select(
        *by, score.alias("overall_risk"), banded(score, V.AGENT_BANDS, 1).alias("risk_level"),
        banded(score, V.AGENT_BANDS, 2).alias("action"), confidence.cast("bigint").alias("chain_confidence"))


def confidence_scores(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Overall, indicator and root cause confidence of the investigation."""
    chain = chains.chain_confidence()
    ransom = chains.flags()["ransomware_indicators"]

    def pick(none: int, with_ransom: int, strong: int, partial: int, weak: int) -> Column:
        return (
            F.when(chain.isNull(), none).when(ransom, with_ransom).when(chain >= 70, strong)
            .when(chain >= 50, partial).otherwise(weak)).cast("bigint")

    return counts.select(
        *by, pick(20, 85, 70, 55, 35).alias("overall_confidence"),
        F.coalesce(chain, F.lit(0)).cast("bigint").alias("attack_chain_confidence"),
        pick(0, 80, 65, 50, 0).alias("ioc_confidence"), pick(0, 85, 70, 50, 0).alias("root_cause_confidence"))


def evidence_counts(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Pattern counts together with the rows that hold an outside address, in one pass. A null key is a group."""
    return detect.pattern_counts(df, by, also={"n_external_ip": external_ip(df.columns)})


def evidence_score(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean weight of the kinds of evidence present."""
    f = chains.flags()
    auth = F.least(F.lit(50.0) + F.col("authentication_failure_cluster") / F.lit(10.0), F.lit(85.0))
    weights = [
        F.when(f["ransomware_indicators"], 95.0), F.when(f["privilege_escalation"], 85.0),
        F.when(f["authentication_failure_cluster"], auth), F.when(F.col("n_external_ip") > 0, 60.0),
        F.when(F.size(chains.correlation_array()) > 0, 70.0)]
    total = sum((F.coalesce(w, F.lit(0.0)) for w in weights), F.lit(0.0))
    kinds = F.size(F.array_compact(F.array(*weights)))
    mean = F.round(F.when(kinds > 0, total / kinds).otherwise(20.0), 9)
    return counts.select(
        *by, kinds.cast("bigint").alias("evidence_kinds"), F.floor(mean).cast("bigint").alias("confidence"),
        banded(mean, V.EVIDENCE_BANDS).alias("confidence_level"))


def report_confidence(findings: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    c = finding_profile(findings, by)
    confidence = F.least(
        F.lit(20) + F.when(F.col("list_suspicious_powershell") > 0, 30).otherwise(0)
        + F.when(F.col("list_lateral_movement") > 0, 25).otherwise(0)
        + F.when(F.col("list_privilege_escalation") > 0, 20).otherwise(0)
        + F.when(F.col("list_failed_logins") > 10, 15).otherwise(0), F.lit(95))
    return c.select(
        *by, confidence.cast("bigint").alias("confidence"),
        F.least(F.lit(85), confidence + 10).cast("bigint").alias("evidence_quality"),
        F.least(F.lit(70), confidence).cast("bigint").alias("correlation_confidence"))


def report_bands(df: DataFrame, score: str, suspicious: Column) -> DataFrame:
    """The report's wording for a score; ``suspicious`` says whether PowerShell or lateral findings exist."""
    s = F.col(score)
    words = V.REPORT_CONCLUSIONS
    names = ["severity_level", "likelihood", "impact", "sophistication", "priority", "incident_category"]
    out = {n: banded(s, V.REPORT_BANDS, i) for i, n in enumerate(names, 1)}
    out["conclusion"] = (
        F.when(s >= 70, words["confirmed"]).when(s >= 40, words["strong"]).when(suspicious, words["anomalous"])
        .otherwise(words["none"]))
    return df.withColumns(out)
