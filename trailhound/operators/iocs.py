"""Indicator and entity extraction: explode inside the scan, then one map-side-combined group-by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailhound import fixed_values as V
from trailhound.functions.lookup import count_where
from trailhound.functions.text import contains_any, first_match, hinted_matches, starts_with_any

KINDS = ["ip", "user", "host", "service", "command"]


def internal(value: Column) -> Column:
    return starts_with_any(value, V.INTERNAL_PREFIXES)


def _kept(values: Column, stop: list[str]) -> Column:
    return F.filter(values, lambda v: ~F.lower(v).isin(stop))


def _column_values(name: str | None, stop: list[str]) -> Column:
    if name is None:
        return F.array().cast("array<string>")
    value = F.col(name).cast("string")
    return F.array(F.when(~F.lower(value).isin(stop), value) if stop else value)


def _pattern_values(text: Column, lowered: Column, patterns: list[str], hints: list[str]) -> Column:
    return F.concat(*[hinted_matches(text, lowered, p, h) for p, h in zip(patterns, hints)])


def values_of(kind: str, text: Column, lowered: Column, columns: set[str], strict: bool = False) -> Column:
    """Candidate values of one kind in a row, from its text and its own columns.

    ``lowered`` is the lower-cased text. What can be told from a value alone is filtered by ``accepted`` later.
    """
    def own(name: str, stop: list[str]) -> Column:
        return _column_values(name if name in columns else None, stop)

    if kind == "ip":
        pattern = V.STRICT_IP_PATTERN if strict else V.IP_PATTERN
        return F.concat(hinted_matches(text, lowered, pattern, ".", 0), own("source_ip", []), own("src_ip", []))
    if kind == "user":
        found = _pattern_values(text, lowered, V.USER_PATTERNS, V.USER_HINTS)
        return F.concat(_kept(found, V.USER_STOP), own("user_name", V.USER_COLUMN_STOP))
    if kind == "host":
        found = _pattern_values(text, lowered, V.HOST_PATTERNS, V.HOST_HINTS)
        return F.concat(_kept(found, V.HOST_STOP), own("host", V.HOST_COLUMN_STOP))
    if kind == "service":
        return F.concat(hinted_matches(text, lowered, V.SERVICE_PATTERN, V.SERVICE_HINT), own("source", []))
    if kind == "command":
        return _pattern_values(text, lowered, V.COMMAND_IOC_PATTERNS, V.COMMAND_HINTS)
    if kind == "domain":
        return F.transform(hinted_matches(text, lowered, V.DOMAIN_PATTERN, ".", 0), lambda v: F.lower(v))
    raise ValueError(f"unknown indicator kind: {kind}")


def accepted(kind: Column, value: Column) -> Column:
    return (
        value.isNotNull() & (value != "") & ~((kind == "ip") & internal(value))
        & ~((kind == "command") & (F.length(value) <= 5)))


def extract(df: DataFrame, kinds: list[str], text: str = "raw_log", ts: str | None = "ts", strict: bool = False) -> DataFrame:
    """Indicators of the given kinds with how many rows hold each and when it was first and last seen.

    One pass over the rows: candidates of all kinds are unrolled, filtered, and combined on the map side.
    """
    columns = {"source_ip", "src_ip", "user_name", "host", "source"} & set(df.columns)
    when = F.col(ts) if ts else F.lit(None).cast("timestamp_ntz")
    prepared = df.select(
        when.alias("_ts"), F.coalesce(F.col(text), F.lit("")).alias("_text"),
        F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_lower"), *sorted(columns))
    by_kind = F.array(*[
        F.struct(F.lit(k).alias("kind"), F.array_distinct(
            values_of(k, F.col("_text"), F.col("_lower"), columns, strict)).alias("found")) for k in kinds])
    rows = prepared.select("_ts", F.explode(by_kind).alias("_of")).select(
        "_ts", F.col("_of.kind").alias("kind"), F.explode("_of.found").alias("_value"))
    value = F.when(F.col("kind") == "command", F.substr("_value", F.lit(1), F.lit(200))).otherwise(F.col("_value"))
    return (
        rows.filter(accepted(F.col("kind"), F.col("_value"))).groupBy("kind", value.alias("value"))
        .agg(F.count(F.lit(1)).alias("n_events"), F.min("_ts").alias("first_ts"), F.max("_ts").alias("last_ts")))


def kind_counts(iocs: DataFrame) -> DataFrame:
    return iocs.groupBy("kind").agg(F.count(F.lit(1)).alias("n_values"))


def suspicious_entities(df: DataFrame, observed_only: bool = True) -> DataFrame:
    """Addresses and users in suspicious rows, with their first appearance.

    Without ``observed_only`` every extracted address and user is added to the list.
    """
    prepared = df.select(
        "ts", "severity", F.coalesce(F.col("raw_log"), F.lit("")).alias("_text"),
        F.lower(F.coalesce(F.col("raw_log"), F.lit(""))).alias("_lower"))
    suspicious = contains_any(F.col("_lower"), V.ENTITY_WORDS) | F.coalesce(
        F.upper("severity").isin(V.ENTITY_SEVERITIES), F.lit(False))
    ip = first_match(F.col("_text"), V.ENTITY_IP)
    user = first_match(F.col("_text"), V.ENTITY_USER)
    named = F.when(~F.lower(user).isin(V.ENTITY_USER_STOP), user)
    entities = F.when(suspicious, F.array(*[
        F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in (("ip", ip), ("user", named))]))
    found = (
        prepared.select("ts", F.explode(entities).alias("_entity"))
        .select("ts", "_entity.*").filter("value is not null"))
    if not observed_only:
        extra = extract(df, ["ip", "user"]).select(F.col("first_ts").alias("ts"), "kind", "value")
        found = found.unionByName(extra)
    return found.groupBy("kind", "value").agg(F.min("ts").alias("first_ts"))


def counts_of_flagged(df: DataFrame, column: str, flagged: Column, limit: int | None = None) -> DataFrame:
    """Values with at least one flagged row, counted over all their rows.

    The membership test and the count are one aggregate, so the set of flagged values is never joined back.
    """
    out = (
        df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"), F.max(F.coalesce(flagged, F.lit(False))).alias("_flag"))
        .filter("_flag").drop("_flag").orderBy(F.desc("n"), "value"))
    return out if limit is None else out.limit(limit)


def dashboard_entities(df: DataFrame, limit: int = 20) -> DataFrame:
    """Top addresses and users among those with a dashboard-high event."""
    high = F.col("severity").isin(V.DASHBOARD_HIGH_SEVERITIES)
    parts = [
        counts_of_flagged(df, c, high, limit).select(F.lit(k).alias("kind"), "value", "n")
        for k, c in (("ip", "source_ip"), ("user", "user_name"))]
    return parts[0].unionByName(parts[1])


def affected_assets(df: DataFrame) -> DataFrame:
    """Users, hosts, services and addresses affected; services carry a status."""
    return extract(df, ["user", "host", "service", "ip"]).withColumn(
        "status",
        F.when(F.col("kind") == "service",
               F.when(F.col("value").isin(V.IMPACTED_SERVICES), "IMPACTED").otherwise("MONITORING")))


def block_list(iocs: DataFrame, n: int = 5) -> DataFrame:
    """Addresses to block: the first ones seen."""
    return iocs.filter("kind = 'ip'").orderBy("first_ts", "value").limit(n).select("value", "first_ts")


def external_ip(columns: list[str], text: str = "raw_log") -> Column:
    """Whether a row holds an address from outside; ``columns``: those that the row has."""
    raw = F.coalesce(F.col(text), F.lit(""))
    found = values_of("ip", raw, raw, {"source_ip", "src_ip"} & set(columns))
    return F.exists(found, lambda v: ~internal(v))


def has_external_ip(df: DataFrame, by: tuple[str, ...] = (), text: str = "raw_log") -> DataFrame:
    """Rows per group that hold an address from outside."""
    return df.groupBy(*by).agg(count_where(external_ip(df.columns, text)).alias("n_external_ip"))
