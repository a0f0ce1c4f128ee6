"""Time expressions. Sessions run in UTC, and anything about "now" takes an ``as_of`` time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_time(text: Column, year: int | None = None) -> Column:
    """Timestamp from the layouts the parsers meet; anything else gives null."""
    plain = F.regexp_replace(F.trim(text), r"(\d{2}:\d{2}:\d{2}),(\d)", "$1.$2")
    iso = F.when(plain.rlike(r"^\d{4}-\d{2}-\d{2}[T ]"), plain).try_cast("timestamp")
    day = F.when(plain.rlike(r"^\d{4}-\d{2}-\d{2}$"), plain).try_cast("timestamp")
    web = F.try_to_timestamp(
        F.when(plain.rlike(r"^\d{2}/\w{3}/\d{4}:"), plain), F.lit("dd/MMM/yyyy:HH:mm:ss Z"))
    options = [iso, day, web]
    if year is not None:
        short = F.when(
            plain.rlike(r"^[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:"),
            F.concat(F.lit(f"{year} "), F.regexp_replace(plain, r"\s+", " ")))
        options.append(F.try_to_timestamp(short, F.lit("yyyy MMM d HH:mm:ss")))
    return F.coalesce(*options).cast("timestamp_ntz")


def seconds_between(later: Column, earlier: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", earlier, later) / F.lit(1e6)


def as_time(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def age_banded(latest: Column, as_of: str, limits: list[tuple[int, int]], older, missing) -> Column:
    """Score by age: the first limit (in seconds) the age stays under."""
    age = seconds_between(as_time(as_of), latest)
    result = F.when(latest.isNull(), F.lit(missing))
    for seconds, score in limits:
        result = result.when(age < F.lit(seconds), F.lit(score))
    return result.otherwise(F.lit(older))
