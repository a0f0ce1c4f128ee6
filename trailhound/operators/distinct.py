"""Distinct counts that can be added up, exactly or by sketches, and exact top-k that counts only candidates.

Exact: a row gives an entry (kind, value) for each thing to be told apart, and the table of entries is counted with combining on the
map side, so that a task sends each value once; nothing else of the rows moves, and one scan serves all kinds. Tables of
entries merge into those of longer spans. Sketches: a row of them for each day, of fixed size, that merges into any span.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS = "rows"
#: Registers of a sketch as a power of two: a standard error below one per cent.
LG_REGISTERS = 14


def value_table(df: DataFrame, values: dict[str, Column], counts: dict[str, Column] | None = None,
                keys: tuple[str, ...] = ()) -> DataFrame:
    """``kind``, ``value``, ``n`` by ``keys``: one row for each distinct non-null value of a kind, and one for each count.

    ``counts`` are conditions to count rows by; all rows are counted under the kind ``rows``.
    """
    tests = {ROWS: F.lit(True)} | (counts or {})
    entry = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"))
    none = F.lit(None).cast("string")
    entries = F.array(*[F.when(test, entry(kind, none)) for kind, test in tests.items()],
                      *[F.when(value.isNotNull(), entry(kind, value)) for kind, value in values.items()])
    rows = df.select(*keys, F.explode(entries).alias("_entry")).filter("_entry is not null")
    return rows.groupBy(*keys, "_entry.kind", "_entry.value").agg(F.count(F.lit(1)).alias("n"))


def merged_values(values: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Tables of entries (a union of them, or one by more keys) added up."""
    return values.groupBy(*keys, "kind", "value").agg(F.sum("n").cast("bigint").alias("n"))


def exact_counts(values: DataFrame, distinct: list[str], counts: list[str] = (), keys: tuple[str, ...] = ()) -> DataFrame:
    """One row by ``keys``: distinct values of each kind, and the counts, from a merged table of entries."""
    of = lambda kind: F.col("kind") == kind
    return values.groupBy(*keys).agg(
        *[F.count(F.when(of(k), F.lit(1))).alias(k) for k in distinct],
        *[F.coalesce(F.sum(F.when(of(k), F.col("n"))), F.lit(0)).cast("bigint").alias(k) for k in counts])


def sketches(df: DataFrame, values: dict[str, Column], keys: tuple[str, ...], registers: int = LG_REGISTERS) -> DataFrame:
    """A sketch of the distinct values of each kind for each group of ``keys`` (a day, say): binary, of fixed size."""
    return df.groupBy(*keys).agg(*[F.hll_sketch_agg(v.cast("string"), registers).alias(k) for k, v in values.items()])


def estimates(sketched: DataFrame, kinds: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Distinct counts of any span of sketches by ``keys``: they are merged, the rows behind them are not read again."""
    merged = sketched.groupBy(*keys).agg(*[F.hll_union_agg(k).alias(k) for k in kinds])
    return merged.select(*keys, *[F.coalesce(F.hll_sketch_estimate(k), F.lit(0)).alias(k) for k in kinds])


@dataclass(frozen=True)
class Top:
    """The largest counts, and how they were found: by ``candidates`` alone, or by counting all values."""

    rows: DataFrame
    by_candidates: bool
    bound: int


def exact_top(df: DataFrame, value: str, limit: int, tracked: int = 100_000, spare: int = 4) -> Top:
    """The ``limit`` most frequent non-null values, exactly, ties by value: ``value`` and ``n``.

    A summary of ``tracked`` counters names candidates and bounds what it may have missed by 3.5 rows in ``tracked``. A second pass counts
    the candidates only, so that a task sends a row for each of them at most. Where the last of the top is not above the bound,
    all values are counted after all. Fetched: ``spare`` times ``limit`` candidates and their counts.
    """
    seen = df.filter(F.col(value).isNotNull()).select(value)
    k = spare * limit
    summary = seen.agg(F.expr(f"approx_top_k(`{value}`, {k}, {max(tracked, k)})").alias("top"), F.count(F.lit(1)).alias("n")).first()
    counted = lambda rows: rows.groupBy(value).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), value).limit(limit)
    candidates = [r["item"] for r in summary["top"] or []]
    # a value that is no candidate is estimated no higher than the last one, or not tracked at all
    bound = max(math.ceil(summary["n"] * 3.5 / max(tracked, k)), summary["top"][-1]["count"] if len(candidates) == k else 0)
    if summary["n"] < tracked * 0.75 and len(candidates) < k:
        bound = 0  # every value was tracked
    found = counted(seen.filter(F.col(value).isin(candidates))).collect() if candidates else []
    if (len(found) == limit and found[-1]["n"] > bound) or (bound == 0 and len(found) <= limit):
        schema = seen.select(value, F.lit(0).cast("bigint").alias("n")).schema
        return Top(df.sparkSession.createDataFrame(found, schema), True, bound)
    return Top(counted(seen), False, bound)
