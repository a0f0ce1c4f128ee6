"""Log detectors. All row detectors are one projection over one scan; the anomalies come from one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailhound import fixed_values as V
from trailhound.functions.bits import bit_map, may_hold
from trailhound.functions.lookup import count_where, look_up
from trailhound.functions.text import all_matches, any_of, contains_any, holds_any, pattern_hit
from trailhound.operators.aggregates import hourly
from trailhound.operators.normalize import event_names

FINDING_COLUMNS = [
    "finding_type", "list_name", "severity", "event_id", "ts", "user_name", "source_ip", "host", "details",
    "metric",
]
_HIT = "_hit"
_LOWER = "_lower"


def _hit(condition: Column, finding_type: str, list_name: str, severity: str | Column, word: str | None) -> Column:
    level = severity if isinstance(severity, Column) else F.lit(severity)
    return F.when(condition, F.struct(
        F.lit(finding_type).alias("finding_type"), F.lit(list_name).alias("list_name"),
        level.alias("severity"), F.lit(word).cast("string").alias("matched")))


def keyword_hits(text: Column) -> list[Column]:
    return [
        _hit(text.contains(word), kind, list_name, severity, word)
        for kind, severity, list_name, words in V.KEYWORD_RULES for word in words]


def auth_fail_hits(text: Column) -> list[Column]:
    return [_hit(contains_any(text, V.AUTH_FAIL_WORDS), "failed_logins", "failed_logins", F.col("severity"), None)]


def login_ok_hits(text: Column, event_id: Column | None = None) -> list[Column]:
    test = contains_any(text, V.LOGIN_OK_WORDS)
    if event_id is not None:
        test = test | F.coalesce(event_id.cast("string") == str(V.LOGIN_OK_EVENT_ID), F.lit(False))
    return [_hit(test, "successful_logins", "successful_logins", "INFO", None)]


def process_hits(text: Column) -> list[Column]:
    return [
        _hit(text.contains(name), "suspicious_process", "suspicious_processes", "MEDIUM", name)
        for name in V.SUSPICIOUS_PROCESSES]


def powershell_hits(text: Column) -> list[Column]:
    test = text.contains("powershell") & contains_any(text, V.POWERSHELL_ARGS)
    return [_hit(test, "suspicious_powershell", "suspicious_powershell", "HIGH", None)]


COMMAND_TARGETS = {
    "privilege_escalation": ("privilege_escalation", "privilege_escalation", "CRITICAL"),
    "persistence": ("persistence_attempts", "persistence_attempts", "HIGH"),
    "lateral_movement": ("lateral_movement", "lateral_movement", "HIGH"),
    "exfiltration": ("data_exfiltration", "high_risk_commands", "HIGH"),
}


def command_hits(text: Column, category: str) -> list[Column]:
    test = any_of([pattern_hit(text, p) for p in V.COMMAND_PATTERNS[category]])
    return [_hit(test, *COMMAND_TARGETS[category], None)]


def rule_hits(text: Column, rules: list[tuple[str, str, str, str]]) -> list[Column]:
    """User-supplied rules ``(finding type, list, severity, pattern)``: the registry form of the lists above."""
    return [_hit(pattern_hit(text, p), kind, list_name, sev, p) for kind, list_name, sev, p in rules]


def hits_by_rule(text: Column) -> dict[str, list[Column]]:
    """All row rules by the family they belong to."""
    return {
        "keyword": keyword_hits(text), "failed_login": auth_fail_hits(text), "login": login_ok_hits(text),
        "process": process_hits(text), "powershell": powershell_hits(text),
        "command": [h for c in V.COMMAND_PATTERNS for h in command_hits(text, c)],
    }


def all_hits(text: Column) -> list[Column]:
    return [h for hits in hits_by_rule(text).values() for h in hits]


def row_findings(df: DataFrame, make_hits=all_hits, text: str = "raw_log", distinct_rows: bool = False) -> DataFrame:
    """One finding per row and rule that fires (per row and finding type with ``distinct_rows``).

    The rules are an array per row that is unrolled in place, so there is no join and no shuffle. The lower-cased
    text is projected first: inside the generator it would be computed once per rule.
    """
    columns = ["event_id", "ts", "user_name", "source_ip", "host", "_text"]
    prepared = df.select(
        *columns[:-1], "severity", F.col(text).alias("_text"), F.lower(F.col(text)).alias(_LOWER))
    hits = F.array(*make_hits(F.col(_LOWER)))
    if distinct_rows:
        hits = F.array_distinct(F.transform(
            hits, lambda h: F.when(h.isNotNull(), h.withField("matched", F.lit(None).cast("string")))))
    return (
        prepared.select(*columns, F.explode(hits).alias(_HIT))
        .filter(F.col(_HIT).isNotNull())
        .select(
            f"{_HIT}.finding_type", f"{_HIT}.list_name", f"{_HIT}.severity", "event_id", "ts", "user_name",
            "source_ip", "host", F.substr("_text", F.lit(1), F.lit(200)).alias("details"),
            F.lit(None).cast("double").alias("metric"), f"{_HIT}.matched")
    )


def severity_profile(df: DataFrame, by: tuple[str, ...] = (), text: str = "raw_log") -> DataFrame:
    """Per group and severity: events, authentication failures, off-hours events, latest time.

    This is all the aggregate detectors and the detector score need from the events; it has a handful of rows
    per group, whatever the input size.
    """
    has_time = F.col("ts").isNotNull()
    lowered = F.col(_LOWER)
    counts: dict[str, list[Column]] = {}
    for _, severity, _, words in V.KEYWORD_RULES:
        counts.setdefault(severity, []).extend(lowered.contains(w).cast("int") for w in words)
    keyword_n = {s: sum(c[1:], c[0]) for s, c in counts.items()}
    prepared = df.select(*by, "severity", "ts", F.lower(F.col(text)).alias(_LOWER))
    return prepared.groupBy(*by, "severity").agg(
        F.count(F.lit(1)).alias("n_events"),
        count_where(contains_any(lowered, V.AUTH_FAIL_WORDS)).alias("n_auth_fail"),
        count_where(F.hour("ts").isin(V.OFF_HOURS)).alias("n_off_hours"),
        count_where(has_time).alias("n_timed"),
        F.coalesce(F.sum(keyword_n["CRITICAL"]), F.lit(0)).cast("bigint").alias("n_keyword_critical"),
        F.coalesce(F.sum(keyword_n["HIGH"]), F.lit(0)).cast("bigint").alias("n_keyword_high"),
        F.max("ts").alias("latest_ts"),
    )


def group_profile(profile: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The severity profile folded to one row per group, with the counts of the severities that raise an anomaly."""
    def of(severity: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("severity") == severity, F.col("n_events"))), F.lit(0))

    return profile.groupBy(*by).agg(
        *[F.sum(c).alias(c) for c in ("n_auth_fail", "n_off_hours", "n_timed")],
        *[of(s).alias(f"n_{s.lower()}") for s in V.HIGH_ANOMALY_SEVERITIES],
        F.sum("n_events").alias("n_events"))


def _anomaly(test: Column, kind: str, severity: str, details: Column, metric: Column) -> Column:
    return F.when(test, F.struct(
        F.lit(kind).alias("finding_type"), F.lit(severity).alias("severity"), details.alias("details"),
        metric.cast("double").alias("metric")))


def _severity_entries() -> list[Column]:
    out = []
    for severity in V.HIGH_ANOMALY_SEVERITIES:
        n = F.col(f"n_{severity.lower()}")
        level = "CRITICAL" if severity in V.CRITICAL_ANOMALY_SEVERITIES else "HIGH"
        text = F.concat(n.cast("string"), F.lit(f" {severity} severity events detected"))
        out.append(_anomaly(n > 0, f"high_severity_{severity.lower()}_events", level, text, n))
    return out


def _brute_force_entry(minimum: int) -> Column:
    n = F.col("n_auth_fail")
    text = F.concat(n.cast("string"), F.lit(" authentication failure events detected"))
    return _anomaly(n > minimum, "brute_force_suspected", "HIGH", text, n)


def _off_hours_entry(share: float) -> Column:
    n, total = F.col("n_off_hours"), F.col("n_timed")
    text = F.concat(n.cast("string"), F.lit(" events occurred during off-hours"))
    return _anomaly(
        n > total * F.lit(share), "off_hours_activity", "MEDIUM", text, F.round(n / total * F.lit(100.0), 6))


def _raised(groups: DataFrame, by: tuple[str, ...], entries: list[Column]) -> DataFrame:
    """The entries that fire, one row each: all of them come from the same row of counts."""
    none = F.lit(None)
    fixed = {
        "list_name": F.lit("anomalies"), "event_id": none.cast("bigint"), "ts": none.cast("timestamp_ntz"),
        **{c: F.col(c) if c in by else none.cast("string") for c in ("user_name", "source_ip", "host")},
        **{c: F.col(f"_raised.{c}") for c in ("finding_type", "severity", "details", "metric")},
    }
    return (
        groups.select(*by, F.explode(F.array(*entries)).alias("_raised")).filter("_raised is not null")
        .select(*[fixed[c].alias(c) for c in FINDING_COLUMNS]))


def high_severity_anomalies(profile: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return _raised(group_profile(profile, by), by, _severity_entries())


def brute_force_anomaly(groups: DataFrame, by: tuple[str, ...] = (), minimum: int = V.BRUTE_FORCE_MIN) -> DataFrame:
    return _raised(groups, by, [_brute_force_entry(minimum)])


def off_hours_anomaly(groups: DataFrame, by: tuple[str, ...] = (), share: float = V.OFF_HOURS_SHARE) -> DataFrame:
    return _raised(groups, by, [_off_hours_entry(share)])


def aggregate_anomalies(profile: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """All anomalies that come from counts, in one pass over the events."""
    return _raised(group_profile(profile, by), by, [
        *_severity_entries(), _brute_force_entry(V.BRUTE_FORCE_MIN), _off_hours_entry(V.OFF_HOURS_SHARE)])


def ioc_matches(df: DataFrame, feed: DataFrame, text: str = "raw_log", slots: int | None = None) -> DataFrame:
    """Events whose address, or any domain in their text, is in the feed.

    A row's address and domains are one array that is unrolled in the scan, so events and feed are each read once. The
    feed is reduced to distinct values. Its join strategy is left to the optimizer, which broadcasts it only while its
    size is known to be small; beyond that the sort-merge join splits hot keys at run time. For such feeds ``slots`` asks
    for a bit map of the indicators, read ahead, which drops what cannot match before the rows are unrolled.
    """
    known = feed.filter(F.col("kind").isin("ip", "domain")).select(
        F.col("kind").alias("_kind"), F.col("indicator").alias("_value")).distinct()
    columns = ["event_id", "ts", "user_name", "source_ip", "host", F.col(text).alias("_text")]
    entry = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    found = F.array_distinct(F.transform(all_matches(F.col(text), V.DOMAIN_PATTERN, 0), lambda d: F.lower(d)))
    values = F.concat(F.array(entry("ip", F.col("source_ip"))), F.transform(found, lambda d: entry("domain", d)))
    if slots:
        bits = bit_map(known, "_value", slots)
        values = F.filter(values, lambda v: may_hold(bits, v["value"], slots))
    return df.select(*columns, F.explode(values).alias("_found")).select(
        "*", F.col("_found.kind").alias("_kind"), F.col("_found.value").alias("_value")).join(known, ["_kind", "_value"]).select(
        F.lit("ioc_match").alias("finding_type"), F.lit("ioc_matches").alias("list_name"),
        F.lit("HIGH").alias("severity"), "event_id", "ts", "user_name", "source_ip", "host",
        F.substr("_text", F.lit(1), F.lit(200)).alias("details"), F.lit(None).cast("double").alias("metric"),
        F.col("_value").alias("matched"))


def detect_all(df: DataFrame, feed: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Every log detector as one findings table. ``by`` computes the aggregate anomalies per group."""
    rows = row_findings(df).select(*FINDING_COLUMNS)
    found = rows.unionByName(aggregate_anomalies(severity_profile(df, by), by))
    if feed is not None:
        found = found.unionByName(ioc_matches(df, feed).select(*FINDING_COLUMNS))
    return found


def auth_fail_report(df: DataFrame, n: int = 100) -> DataFrame:
    """The report's list of authentication failures: its first ``n`` in time order."""
    return row_findings(df, auth_fail_hits).orderBy("ts", "event_id").limit(n)


def brute_force_by_ip(df: DataFrame, window: str = "10 minutes", minimum: int = V.BRUTE_FORCE_MIN) -> DataFrame:
    """Authentication failures per address and tumbling window above a minimum."""
    return (
        df.filter(holds_any(F.col("raw_log"), V.AUTH_FAIL_WORDS) & F.col("source_ip").isNotNull())
        .groupBy("source_ip", F.window(F.col("ts").cast("timestamp"), window).alias("w"))
        .agg(F.count(F.lit(1)).alias("failed_attempts"))
        .filter(F.col("failed_attempts") > minimum)
        .select("source_ip", F.col("w.start").cast("timestamp_ntz").alias("window_start"), "failed_attempts")
    )


def event_id_categories(df: DataFrame, event_id: str = "win_event_id") -> DataFrame:
    """Tag rows by the category of their Windows event id."""
    by_id = {i: V.WINDOWS_EVENT_CATEGORIES[n] for n, i in V.WINDOWS_EVENT_IDS}
    key = F.col(event_id).cast("int")
    return df.withColumns({
        "event_name": F.coalesce(look_up(key, event_names()), F.lit("unknown")),
        "category": look_up(key, by_id, "other"),
    })


def night_activity(df: DataFrame, by: tuple[str, ...] = (), share: float = V.OFF_HOURS_SHARE) -> DataFrame:
    """Share of events between 0 and 5 o'clock among all rows."""
    n, total = F.col("night_events"), F.col("total_events")
    return df.groupBy(*by).agg(
        count_where(F.hour("ts").isin(V.NIGHT_HOURS)).alias("night_events"),
        F.count(F.lit(1)).alias("total_events"),
    ).withColumns({
        "percentage": F.round(n / total * F.lit(100.0), 6), "is_anomaly": n > total * F.lit(share)})


def spikes(df: DataFrame, deviations: float = 2.0) -> DataFrame:
    """Hours whose count exceeds the mean by so many sample standard deviations."""
    counts = hourly(df)
    limit = counts.agg((F.avg("n") + F.lit(deviations) * F.stddev_samp("n")).alias("spike_limit")).scalar()
    return counts.filter(F.col("n") > limit)


def pattern_counts(
    df: DataFrame, by: tuple[str, ...] = (), text: str = "raw_log", also: dict[str, Column] | None = None,
) -> DataFrame:
    """Counts of every pattern cluster in one pass: one row per group. ``also``: further conditions to count rows by."""
    lowered, also = F.col(_LOWER), also or {}
    return df.select(*by, "ts", F.lower(F.col(text)).alias(_LOWER), *[c.alias(n) for n, c in also.items()]).groupBy(*by).agg(
        *[count_where(F.col(n)).alias(n) for n in also],
        *[count_where(contains_any(lowered, words)).alias(name) for name, words, _ in V.PATTERN_CLUSTERS],
        count_where(F.hour("ts").isin(V.NIGHT_HOURS)).alias("off_hours_activity"),
        F.count(F.lit(1)).alias("total_events"),
    )


def suspicious_patterns(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Pattern clusters over their thresholds, with significance, from the one-pass counts."""
    significance = {
        "authentication_failure_cluster":
            F.when(F.col("authentication_failure_cluster") > V.AUTH_CLUSTER_HIGH, "HIGH").otherwise("MEDIUM"),
        "privilege_escalation": F.lit("HIGH"), "database_availability": F.lit("HIGH"),
        "ransomware_indicators": F.lit("CRITICAL"), "off_hours_activity": F.lit("MEDIUM"),
    }
    tests = {name: F.col(name) > minimum for name, _, minimum in V.PATTERN_CLUSTERS}
    tests["off_hours_activity"] = F.col("off_hours_activity") > F.col("total_events") * F.lit(V.OFF_HOURS_SHARE)
    rows = [
        F.when(test, F.struct(F.lit(name).alias("pattern"), F.col(name).alias("n"), significance[name].alias("significance")))
        for name, test in tests.items()]
    return counts.select(*by, F.explode(F.array(*rows)).alias("_pattern")).filter(
        "_pattern is not null").select(*by, "_pattern.*")
