"""Line parsers: regex projections that run inside the scan stage, with no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailhound import fixed_values as V
from trailhound.functions.lookup import look_up
from trailhound.functions.text import (
    all_matches, any_of, bound, first_contained, first_match, packed, pairs_to_map, slots,
)
from trailhound.functions.times import parse_time

GENERAL_FIELDS = [
    "timestamp", "severity", "source", "source_ip", "user_name", "host", "process", "status_code",
    "latency_ms", "event_type", "message",
]


def kv_fields(line: Column) -> dict[str, Column]:
    """The eight fixed fields of the service log layout, each found anywhere in the line."""
    found = {name: first_match(line, pattern) for name, pattern in V.KV8_PATTERNS.items()}
    found["message"] = F.coalesce(found["event_type"], line)
    return found


def parse_kv8(df: DataFrame, line: str = "line") -> DataFrame:
    return df.select("*", *[c.alias(n) for n, c in kv_fields(F.col(line)).items()])


def _groups(line: Column, pattern: str, names: list[str]) -> dict[str, Column]:
    """Groups of an anchored pattern by name. The regex runs once: the shared array is a common subexpression."""
    found = slots(packed(line, pattern, [f"${i}" for i in range(1, len(names) + 1)]))
    return {n: F.get(found, i) for i, n in enumerate(names)}


def _layout_fields(line: Column, layout: str) -> dict[str, Column]:
    """Fields of one of the five anchored layouts."""
    if layout == "sev_pipe":
        got = _groups(line, V.SEV_PIPE, ["severity", "source", "message"])
        got["timestamp"] = F.lit(None).cast("string")
    else:
        pattern = {
            "iso_pipe": V.ISO_PIPE, "space_pipe": V.SPACE_PIPE, "comma_ms": V.COMMA_MS,
            "space_plain": V.SPACE_PLAIN,
        }[layout]
        got = _groups(line, pattern, ["timestamp", "severity", "source", "message"])
    if layout == "comma_ms":
        got["timestamp"] = F.translate(got["timestamp"], ",", ".")
    got["severity"] = F.upper(got["severity"])
    got["message"] = F.trim(got["message"])
    return got


def layout_test(line: Column, layout: str) -> Column:
    """Whether a line has the layout, with the guards that keep layouts apart."""
    tests = {
        "json": lambda: line.rlike(r"^\s*(\{|\[\s*\{)"),
        "syslog": lambda: line.rlike(V.SYSLOG),
        "clf": lambda: line.rlike(V.CLF),
        "iso_pipe": lambda: line.rlike(V.ISO_PIPE),
        "space_pipe": lambda: line.rlike(V.SPACE_PIPE),
        "comma_ms": lambda: line.rlike(V.COMMA_MS),
        "sev_pipe": lambda: line.rlike(V.SEV_PIPE)
        & F.upper(F.regexp_extract(line, V.SEV_PIPE, 1)).isin(V.SEV_PIPE_WORDS),
        "wazuh": lambda: line.rlike(V.WAZUH),
        "iis": lambda: line.rlike(V.IIS) & F.regexp_extract(line, V.IIS, 3).isin(V.IIS_METHODS),
        "syslog_nopri": lambda: line.rlike(V.SYSLOG_NOPRI),
        "kv": lambda: line.rlike(r"\w+=") & line.rlike(V.KV_OPEN),
        "space_plain": lambda: line.rlike(V.SPACE_PLAIN),
        "sev_anywhere": lambda: line.rlike(V.SEV_ANYWHERE),
    }
    return tests[layout]()


ROW_ORDER = [
    "json", "syslog", "clf", "iso_pipe", "space_pipe", "comma_ms", "sev_pipe", "wazuh", "iis",
    "syslog_nopri", "kv", "space_plain", "sev_anywhere",
]
# the order in which a whole input is tried; the first family with any row wins
INPUT_ORDER = ["json", "syslog_nopri", "wazuh", "kv", "generic"]


def parse_layout(df: DataFrame, layout: str, line: str = "line") -> DataFrame:
    """Rows that have one anchored layout, with its fields."""
    text = F.col(line)
    return df.filter(layout_test(text, layout)).select(
        "*", *[c.alias(n) for n, c in _layout_fields(text, layout).items()])


def parse_severity_anywhere(df: DataFrame, line: str = "line") -> DataFrame:
    text = F.col(line)
    return df.filter(layout_test(text, "sev_anywhere")).select(
        "*",
        F.translate(first_match(text, V.TS_ANYWHERE_MS), ",", ".").alias("timestamp"),
        F.upper(F.regexp_extract(text, V.SEV_ANYWHERE, 1)).alias("severity"),
        text.alias("message"),
    )


def _open_pairs(rest: Column) -> Column:
    """Key/value map of ``k=v k="v v"`` text; quotes are stripped and a repeated key keeps its last value."""
    return bound(all_matches(rest, V.KV_OPEN_PAIR, 0), lambda found: pairs_to_map(
        F.transform(found, lambda p: F.substring_index(p, "=", 1)), F.transform(found, _open_value)))


def _open_value(pair: Column) -> Column:
    """The value of one ``k=v``: a closed quote that holds something goes."""
    raw = F.substr(pair, F.locate("=", pair) + F.lit(1))
    quoted = F.startswith(raw, F.lit('"')) & F.endswith(raw, F.lit('"')) & (F.length(raw) > 2)
    return F.when(quoted, F.substr(raw, F.lit(2), F.length(raw) - F.lit(2))).otherwise(raw)


def parse_kv_open(df: DataFrame, line: str = "line") -> DataFrame:
    """``[SEV] k=v k="v v"`` lines with any key: known keys become columns, the rest goes to ``extras``.

    The test takes its line once: a filter that is pushed below the expression that makes the line would else hold a copy of it
    for each pattern, and generated code of that size is not compiled.
    """
    text = F.col(line)
    with_pairs = df.filter(bound(text, lambda t: layout_test(t, "kv"))).select(
        "*",
        first_match(text, V.KV_OPEN, 1).alias("timestamp"),
        F.upper(F.regexp_extract(text, V.KV_OPEN, 2)).alias("severity"),
        F.regexp_extract(text, V.KV_OPEN, 3).alias("_rest")).withColumn("_pairs", _open_pairs(F.col("_rest")))
    known = {name: F.try_element_at("_pairs", F.lit(key)) for key, name in V.KV_OPEN_NAMES.items()}
    return with_pairs.select(
        "*", *[c.alias(n) for n, c in known.items()],
        F.coalesce(known["event_type"], F.col("_rest")).alias("message"),
        F.map_filter("_pairs", lambda k, v: ~k.isin(list(V.KV_OPEN_NAMES))).alias("extras"),
    ).drop("_rest", "_pairs")


def syslog_severity(priority: Column) -> Column:
    return look_up(priority.bitwiseAND(F.lit(7)), V.SYSLOG_SEVERITY, "Unknown")


def parse_syslog(df: DataFrame, line: str = "line", year: int = 2024) -> DataFrame:
    """``<pri>Mon d time host prog[pid]: msg``; the year is not in the line, so it is a parameter."""
    text = F.col(line)
    got = _groups(text, V.SYSLOG, ["priority", "timestamp", "host", "program", "pid", "message"])
    got["priority"] = got["priority"].try_cast("int")
    got["pid"] = F.nullif(got["pid"], F.lit(""))
    return (
        df.filter(layout_test(text, "syslog"))
        .select("*", *[c.alias(n) for n, c in got.items()])
        .withColumn("severity", syslog_severity(F.col("priority")))
        .withColumn("ts_parsed", parse_time(F.col("timestamp"), year))
    )


def parse_iis(df: DataFrame, line: str = "line", strict: bool = True) -> DataFrame:
    """Web server lines; ``strict`` asks for a request method so that other layouts do not slip in."""
    text = F.col(line)
    got = _groups(text, V.IIS, ["date", "time", "method", "uri", "uri_query", "user_name", "source_ip"])
    test = layout_test(text, "iis") if strict else text.rlike(V.IIS)
    stamp = F.concat_ws(" ", got.pop("date"), got.pop("time"))
    return df.filter(test).select("*", stamp.alias("timestamp"), *[c.alias(n) for n, c in got.items()])


def parse_clf(df: DataFrame, line: str = "line") -> DataFrame:
    text = F.col(line)
    got = _groups(
        text, V.CLF, ["source_ip", "user_name", "timestamp", "method", "uri", "protocol", "status_code", "size"])
    got["status_code"] = got["status_code"].try_cast("int")
    got["size"] = got["size"].try_cast("bigint")
    return (
        df.filter(layout_test(text, "clf"))
        .select("*", *[c.alias(n) for n, c in got.items()])
        .withColumn("ts_parsed", parse_time(F.col("timestamp")))
    )


def parse_syslog_nopri(df: DataFrame, line: str = "line") -> DataFrame:
    text = F.col(line)
    got = _groups(text, V.SYSLOG_NOPRI, ["timestamp", "host", "process", "message"])
    return df.filter(layout_test(text, "syslog_nopri")).select("*", *[c.alias(n) for n, c in got.items()])


def parse_wazuh(df: DataFrame, line: str = "line") -> DataFrame:
    text = F.col(line)
    got = _groups(text, V.WAZUH, ["timestamp", "level", "type", "message"])
    return df.filter(layout_test(text, "wazuh")).select("*", *[c.alias(n) for n, c in got.items()])


def parse_kv_map(df: DataFrame, line: str = "line") -> DataFrame:
    """Every ``k=v`` pair as a map, for lines that hold ``=``."""
    text = F.col(line)
    return df.filter(text.contains("=")).select(
        "*",
        first_match(text, V.GENERIC_TS).alias("timestamp"),
        F.coalesce(first_contained(text, V.KV_MAP_LEVELS), F.lit("INFO")).alias("level"),
        pairs_to_map(all_matches(text, V.KV_MAP_PAIR, 1), all_matches(text, V.KV_MAP_PAIR, 2)).alias("pairs"),
    )


def parse_generic(df: DataFrame, line: str = "line") -> DataFrame:
    text = F.col(line)
    level = F.coalesce(*[
        F.when(any_of([text.contains(f"[{w}]"), text.contains(f" {w} ")]), F.lit(w)) for w in V.GENERIC_LEVELS])
    got = {n: first_match(text, p) for n, p in V.GENERIC_PATTERNS.items()}
    got["status_code"] = got["status_code"].try_cast("int")
    return df.select(
        "*", first_match(text, V.GENERIC_TS).alias("timestamp"), level.alias("level"),
        *[c.alias(n) for n, c in got.items()])


def line_format(line: Column) -> Column:
    """Layout of a line: the first layout in order that fits, ``raw`` otherwise."""
    result = None
    for layout in ROW_ORDER:
        test = layout_test(line, layout)
        result = F.when(test, F.lit(layout)) if result is None else result.when(test, F.lit(layout))
    return result.otherwise(F.lit("raw"))


def tag_format(df: DataFrame, line: str = "line", name: str = "line_format") -> DataFrame:
    return df.withColumn(name, line_format(F.col(line)))


def input_format(df: DataFrame, line: str = "line") -> DataFrame:
    """The parser family a whole input belongs to: one aggregate counts all families at once."""
    text = F.col(line)
    tests = {
        "json": layout_test(text, "json"), "syslog_nopri": layout_test(text, "syslog_nopri"),
        "wazuh": layout_test(text, "wazuh"), "kv": text.contains("="), "generic": F.lit(True),
    }
    counted = df.agg(*[F.count(F.when(tests[n], F.lit(1))).alias(n) for n in INPUT_ORDER])
    chosen = F.coalesce(*[
        F.when(F.col(n) > 0, F.struct(F.lit(n).alias("input_format"), F.col(n).alias("n_rows")))
        for n in INPUT_ORDER])
    return counted.select(chosen.alias("_c")).filter("_c is not null").select("_c.*")


def input_rows(df: DataFrame, line: str = "line", year: int = 2024) -> DataFrame:
    """The rows that the family of the whole input (:func:`input_format`) parses, with the general fields."""
    text = F.col(line)
    chosen = input_format(df, line).select("input_format").scalar()
    fits = F.when(chosen == "kv", text.contains("=")).when(chosen == "generic", F.lit(True))
    for layout in ("json", "syslog_nopri", "wazuh"):
        fits = fits.when(chosen == layout, layout_test(text, layout))
    return parse_any(df.filter(fits), line, year)


# where the general fields of an anchored layout come from: replacement texts over the groups of its pattern
_GENERAL_SLOTS = {
    "syslog": (V.SYSLOG, {"timestamp": "$2", "severity": "$1", "host": "$3", "process": "$4", "message": "$6"}),
    "clf": (V.CLF, {
        "timestamp": "$3", "source_ip": "$1", "user_name": "$2", "status_code": "$7", "message": "$4 $5"}),
    "iso_pipe": (V.ISO_PIPE, {"timestamp": "$1", "severity": "$2", "source": "$3", "message": "$4"}),
    "space_pipe": (V.SPACE_PIPE, {"timestamp": "$1", "severity": "$2", "source": "$3", "message": "$4"}),
    "comma_ms": (V.COMMA_MS, {"timestamp": "$1", "severity": "$2", "source": "$3", "message": "$4"}),
    "sev_pipe": (V.SEV_PIPE, {"severity": "$1", "source": "$2", "message": "$3"}),
    "space_plain": (V.SPACE_PLAIN, {"timestamp": "$1", "severity": "$2", "source": "$3", "message": "$4"}),
    "wazuh": (V.WAZUH, {"timestamp": "$1", "severity": "$2", "source": "$3", "message": "$4"}),
    "iis": (V.IIS, {"timestamp": "$1 $2", "user_name": "$6", "source_ip": "$7", "message": "$3 $4"}),
    "syslog_nopri": (V.SYSLOG_NOPRI, {"timestamp": "$1", "host": "$2", "process": "$3", "message": "$4"}),
}


# names that a general field may have in JSON lines, lower-cased, the first that is there wins
_JSON_NAMES = {n: V.COLUMN_ALIASES.get(n, [n]) for n in GENERAL_FIELDS} | {
    "host": ["host", "hostname", "computer"], "event_type": ["event_type", "event"]}
# keys of key=value lines that are general fields already
_KV_NAMES = [*V.KV_OPEN_NAMES, "host"]


def _json_pairs(text: Column) -> Column:
    """Lower-cased names and values of a JSON object; nested values are JSON text, anything else gives null."""
    found = F.from_json(text, "map<string,string>")
    return F.when(found.isNotNull(), pairs_to_map(F.transform(F.map_keys(found), F.lower), F.map_values(found)))


def parse_any(df: DataFrame, line: str = "line", year: int = 2024) -> DataFrame:
    """Parse a mixed input row by row into the general fields, with what else a row names in ``extras``.

    A row is tagged with its layout, then rewritten once into the same slots whatever the layout; only key=value
    lines and lines without a layout are searched field by field, and JSON lines are read by name.
    """
    text, tag = F.col(line), F.col("line_format")
    rewritten = None
    for layout, (pattern, sources) in _GENERAL_SLOTS.items():
        slot_text = packed(text, pattern, [sources.get(n, "") for n in GENERAL_FIELDS])
        test = tag == layout
        rewritten = F.when(test, slot_text) if rewritten is None else rewritten.when(test, slot_text)
    searched = kv_fields(text)
    searched["host"] = first_match(text, r"host=([a-zA-Z0-9_-]+)")
    loose = {
        "timestamp": first_match(text, V.TS_ANYWHERE_MS), "severity": first_match(text, V.SEV_ANYWHERE),
        "message": text}
    fields = {}
    for i, name in enumerate(GENERAL_FIELDS):
        value = F.nullif(F.trim(F.get("_slots", F.lit(i))), F.lit(""))
        if name in searched:
            value = F.when(tag == "kv", searched[name]).otherwise(value)
        if name in loose:
            value = F.when(tag.isin("sev_anywhere", "raw", "json"), loose[name]).otherwise(value)
        named = F.coalesce(*[F.try_element_at("_json", F.lit(k)) for k in _JSON_NAMES[name]])
        fields[name] = F.when(tag == "json", F.coalesce(named, value)).otherwise(value)
    number = F.when(tag == "syslog", fields["severity"]).try_cast("int")
    fields["severity"] = F.upper(F.when(tag == "syslog", syslog_severity(number)).otherwise(fields["severity"]))
    fields["timestamp"] = F.translate(fields["timestamp"], ",", ".")
    tagged = tag_format(df, line)
    return (
        tagged.withColumns({"_slots": slots(rewritten), "_json": F.when(tag == "json", _json_pairs(text)),
                            "_pairs": F.when(tag == "kv", _open_pairs(text))})
        .select(*tagged.columns, *[c.alias(n) for n, c in fields.items()], F.coalesce(
            F.map_filter("_json", lambda k, v: ~k.isin(sorted({a for x in _JSON_NAMES.values() for a in x}))),
            F.map_filter("_pairs", lambda k, v: ~k.isin(_KV_NAMES))).alias("extras"))
        .withColumn("ts_parsed", parse_time(F.col("timestamp"), year)))
