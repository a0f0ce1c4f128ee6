"""Normalising projections: aliases, back-filling, timestamps, severities, profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailhound import fixed_values as V
from trailhound.functions.lookup import look_up
from trailhound.functions.text import first_match
from trailhound.functions.times import parse_time, seconds_between
from trailhound.operators.distinct import exact_counts, value_table


def standard_name(name: str) -> str:
    return name.lower().replace(" ", "_")


def find_column(columns: list[str], candidates: list[str]) -> str | None:
    """First candidate present, ignoring case. Looks at the schema only."""
    by_lower = {c.lower(): c for c in reversed(columns)}
    for name in candidates:
        if name in columns:
            return name
        if name.lower() in by_lower:
            return by_lower[name.lower()]
    return None


def standardize(df: DataFrame) -> DataFrame:
    """Lower-case names and add each canonical column from its first alias; other columns stay."""
    clean = df.toDF(*[standard_name(c) for c in df.columns])
    present = set(clean.columns)
    added = []
    for canonical, aliases in V.COLUMN_ALIASES.items():
        source = next((a for a in aliases if a in present), None)
        if source and canonical not in present:
            added.append(F.col(f"`{source}`").alias(canonical))
    return clean.select("*", *added)


def require_columns(df: DataFrame) -> DataFrame:
    """Trimmed lower-case names, with the required columns present (empty text when missing)."""
    clean = df.toDF(*[c.strip().lower() for c in df.columns])
    missing = [F.lit("").alias(c) for c in V.REQUIRED_COLUMNS if c not in clean.columns]
    return clean.select("*", *missing)


def backfill(df: DataFrame, text: str = "raw_log", per_row: bool = False) -> DataFrame:
    """Fill fields from the raw text.

    By default a field is filled only when it is missing or null in every row, and the looser second pattern
    is used only when the first finds nothing anywhere; one aggregate, a subquery of the plan, decides for all fields
    together.
    ``per_row`` fills each null on its own and needs no aggregate.
    """
    raw = F.col(text)

    def found(pattern: str, name: str) -> Column:
        hit = first_match(raw, pattern)
        return F.upper(hit) if name == "severity" else hit

    options = {n: [found(p, n) for p in patterns] for n, patterns in V.BACKFILL_PATTERNS.items()}
    have = {n: F.col(n) if n in df.columns else F.lit(None).cast("string") for n in options}
    if per_row:
        return df.withColumns({n: F.coalesce(have[n], *options[n]) for n in options})
    present = lambda c: F.coalesce(F.max(c.isNotNull()), F.lit(False))
    probe = df.agg(F.struct(
        *[present(have[n]).alias(f"{n}_have") for n in options],
        *[present(options[n][0]).alias(f"{n}_first") for n in options]).alias("probe")).scalar()
    return df.withColumns({
        name: F.when(probe[f"{name}_have"], have[name]).when(probe[f"{name}_first"], choices[0]).otherwise(choices[-1])
        for name, choices in options.items()})


def coerce_time(df: DataFrame, text: str = "timestamp", name: str = "ts", year: int | None = None) -> DataFrame:
    return df.withColumn(name, parse_time(F.col(text), year))


def normalized_severity(severity: Column) -> Column:
    return look_up(F.upper(severity), V.SEVERITY_NORMALIZED, "MEDIUM")


def normalize_severity(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "severity": F.upper("severity"), "severity_norm": normalized_severity(F.col("severity"))})


def event_names() -> dict[int, str]:
    """Windows event id to name; an id with several names keeps all of them."""
    names: dict[int, str] = {}
    for name, event_id in V.WINDOWS_EVENT_IDS:
        names[event_id] = f"{names[event_id]} / {name}" if event_id in names else name
    return names


def describe_event(df: DataFrame, event_id: str = "event_id") -> DataFrame:
    key = F.col(event_id).cast("string")
    number = F.when(key.rlike(r"^\d+$"), key).try_cast("int")
    return df.withColumns({
        "event_description": F.coalesce(look_up(number, event_names()), F.concat(F.lit("Event "), key)),
        "event_text": F.coalesce(look_up(number, V.EVENT_TEXTS), F.concat(F.lit("Event ID "), key)),
    })


CANONICAL = {
    "event_id": "bigint", "ts": "timestamp_ntz", "severity": "string", "severity_norm": "string", "source": "string",
    "source_ip": "string", "dest_ip": "string", "user_name": "string", "host": "string", "process": "string",
    "commandline": "string", "message": "string", "event_type": "string", "status_code": "int", "latency_ms": "bigint",
    "raw_log": "string", "line_number": "bigint", "file_name": "string", "extras": "map<string,string>",
}


def canonical(df: DataFrame, text: str | None = None, year: int | None = None) -> DataFrame:
    """The canonical event table of any parsed input: its columns are fixed, and those the input lacks are null.

    Columns are found by their aliases. ``ts`` comes from ``ts_parsed`` or the text of ``timestamp``. ``raw_log`` is the
    column ``text``, or the line, else the message. Rows without an ``event_id`` column get a unique number that follows
    the order of the input's partitions. Columns of other names go to ``extras`` as text.
    """
    text = text or next((c for c in ("raw_log", "line", "value") if c in df.columns), None)
    named = standardize(df)
    have = set(named.columns)
    found: dict[str, Column] = {n: F.col(n) for n in CANONICAL if n in have}
    if "ts" not in have:
        times = [F.col("ts_parsed")] if "ts_parsed" in have else []
        if "timestamp" in have:
            times.append(parse_time(F.col("timestamp").cast("string"), year))
        if times:
            found["ts"] = F.coalesce(*times)
    if "event_id" not in have:
        found["event_id"] = F.monotonically_increasing_id()
    if "severity" in have:
        found["severity"] = F.upper(F.col("severity").cast("string"))
        found.setdefault("severity_norm", normalized_severity(F.col("severity")))
    if text:
        found["raw_log"] = F.col(standard_name(text))
    elif "raw_log" not in have and "message" in have:
        found["raw_log"] = F.col("message")
    used = {*CANONICAL, "timestamp", "ts_parsed", "line_format", text, *(a for x in V.COLUMN_ALIASES.values() for a in x)}
    rest = [c for c in named.columns if c not in used]
    if rest:
        pairs = F.map_filter(F.create_map(*[x for c in rest for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]),
                             lambda k, v: v.isNotNull())
        found["extras"] = F.map_concat(F.map_filter(found["extras"], lambda k, v: ~k.isin(rest)), pairs) \
            if "extras" in have else pairs
    cast = lambda c, kind: c.try_cast(kind) if kind in ("bigint", "int") else c.cast(kind)
    return named.select(*[cast(found.get(n, F.lit(None)), kind).alias(n) for n, kind in CANONICAL.items()])


def sort_events(df: DataFrame) -> DataFrame:
    """By time, nulls last, ties by id: a range-partitioned sort with even parts."""
    return df.orderBy(F.asc_nulls_last("ts"), "event_id")


def profile(df: DataFrame, distinct_of: list[str], approximate: bool = False) -> DataFrame:
    """Rows, columns, null share, time range and distinct counts.

    ``approximate`` swaps the exact distinct counts, which shuffle their values, for sketches.
    """
    width = len(df.columns)
    nulls = sum((F.count(F.when(F.col(c).isNull(), F.lit(1))) for c in df.columns[1:]),
                F.count(F.when(F.col(df.columns[0]).isNull(), F.lit(1))))
    out = df.agg(
        F.count(F.lit(1)).alias("total_rows"), nulls.alias("_nulls"),
        F.min("ts").alias("time_range_start"), F.max("ts").alias("time_range_end"),
        *[F.approx_count_distinct(c).alias(f"unique_{c}") for c in distinct_of if approximate])
    if distinct_of and not approximate:
        kinds = {f"unique_{c}": F.col(c) for c in distinct_of}
        exact = exact_counts(value_table(df, kinds), list(kinds))
        out = out.withColumns({k: exact.select(k).scalar() for k in kinds})
    return out.withColumns({
        "total_columns": F.lit(width).cast("bigint"),
        "null_percentage": F.col("_nulls") / (F.col("total_rows") * F.lit(float(width))) * F.lit(100.0),
        "time_range_hours":
            seconds_between(F.col("time_range_end"), F.col("time_range_start")) / F.lit(3600.0),
    }).drop("_nulls")


def sample(df: DataFrame, n: int = 5) -> DataFrame:
    """First ``n`` events in time order (a preview, so the limit is the feature)."""
    return df.orderBy("ts", "event_id").limit(n)
