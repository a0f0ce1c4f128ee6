"""Event filters and question routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailhound import fixed_values as V
from trailhound.functions.lookup import count_where
from trailhound.functions.text import contains_any, holds_any


def severity_in(df: DataFrame, severities: list[str]) -> DataFrame:
    return df.filter(F.upper("severity").isin(severities))


def with_fallback(df: DataFrame, main: Column, otherwise: Column) -> DataFrame:
    """Rows that meet ``main``; where no row of the input does, those that meet ``otherwise``.

    Whether any row meets ``main`` is a scalar subquery: one partial aggregate, decided inside the same job.
    """
    nothing = df.agg(F.coalesce(F.max(main), F.lit(False)).alias("any_main")).scalar()
    return df.filter(F.coalesce(main, F.lit(False)) | (~nothing & otherwise))


def high_severity(df: DataFrame) -> DataFrame:
    return severity_in(df, V.QUESTION_HIGH_SEVERITIES)


def errors(df: DataFrame, text: str = "raw_log") -> DataFrame:
    words = holds_any(F.col(text), ["error", "fail", "exception"])
    return with_fallback(df, F.upper("severity").isin(V.QUESTION_ERROR_SEVERITIES), words)


def warnings(df: DataFrame) -> DataFrame:
    return severity_in(df, V.QUESTION_WARN_SEVERITIES)


def by_ip(df: DataFrame, ip: str) -> DataFrame:
    return with_fallback(df, F.col("source_ip").contains(ip), F.col("raw_log").contains(ip))


def by_user(df: DataFrame, user: str) -> DataFrame:
    return df.filter(F.lower("user_name").contains(user.lower()))


def first_events(df: DataFrame, n: int = 50) -> DataFrame:
    """First ``n`` events in time order (a preview, so the limit is the feature)."""
    return df.orderBy("ts", "event_id").limit(n)


def dashboard_high(df: DataFrame, n: int = 10) -> DataFrame:
    """Top of the dashboard's high severity table."""
    return (
        df.filter(F.col("severity").isin(V.DASHBOARD_HIGH_SEVERITIES))
        .select("event_id", "ts", "severity", "source", "source_ip", "user_name")
        .orderBy("ts", "event_id").limit(n)
    )


def insight(df: DataFrame) -> DataFrame:
    """Size of a result, its high severity share, and whether errors or failures occur in it."""
    text = F.lower("raw_log")
    return df.agg(
        F.count(F.lit(1)).alias("n_events"),
        count_where(F.col("severity").isin(V.QUESTION_HIGH_SEVERITIES)).alias("n_high"),
        F.coalesce(F.max(contains_any(text, ["error", "fail"])), F.lit(False)).alias("has_errors"),
    )


def _rule_chain(text: Column, rules: list[tuple], special: dict[str, Column], default: str) -> Column:
    chosen = None
    for name, words in rules:
        test = special[name] if words is None else contains_any(text, words)
        chosen = F.when(test, F.lit(name)) if chosen is None else chosen.when(test, F.lit(name))
    return chosen.otherwise(F.lit(default))


def tag_question(df: DataFrame, text: str = "text") -> DataFrame:
    """Kind of a question, with the address and the user it names."""
    question, lowered = F.col(text), F.lower(F.col(text))
    ip = F.nullif(F.regexp_extract(question, V.IP_PATTERN, 0), F.lit(""))
    return df.withColumns({
        "intent": _rule_chain(lowered, V.QUESTION_RULES, {"ip": ip.isNotNull()}, "default"),
        "asked_ip": ip,
        "asked_user": F.nullif(F.regexp_extract(lowered, r"user[:\s]+(\S+)", 1), F.lit("")),
    })


def tag_investigation(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("investigation", _rule_chain(F.lower(F.col(text)), V.AGENT_RULES, {}, "summary"))
