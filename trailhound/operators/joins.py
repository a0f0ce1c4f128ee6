"""Look-up joins against dimension tables and feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailhound import fixed_values as V
from trailhound.functions.bits import bit_map, may_hold
from trailhound.functions.lookup import look_up
from trailhound.session import constant_table


#: Bits of the map of a feed's indicators: 128 KB in the plan, two per cent of them set by 20,000 indicators.
FEED_SLOTS = 1 << 20


def with_dimension(df: DataFrame, dimension: DataFrame, key: str, value: str, default) -> DataFrame:
    """Equi look-up with a default; the join strategy follows the dimension's size."""
    return df.join(dimension, key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def severity_weights(df: DataFrame) -> DataFrame:
    table = constant_table(df.sparkSession, ["severity", "weight"], list(V.SEVERITY_WEIGHTS.items()))
    return with_dimension(df, table, "severity", "weight", V.DEFAULT_SEVERITY_WEIGHT)


def in_feed(df: DataFrame, feed: DataFrame, column: str = "source_ip", kind: str = "ip") -> DataFrame:
    """Events whose value is in the feed; the join strategy follows the feed's size."""
    wanted = feed.filter(F.col("kind") == kind).select(F.col("indicator").alias(column))
    return df.join(wanted, column, "left_semi")


def in_large_feed(df: DataFrame, feed: DataFrame, column: str = "source_ip", kind: str = "ip", slots: int = FEED_SLOTS) -> DataFrame:
    """The same rows for a feed beyond the broadcast limit: events that cannot match go in the scan stage.

    The feed is read once more for a bit map of ``slots`` bits, so that the join shuffles the matches and, of the rest, the
    share of bits that the feed sets. A hot address that is not in the feed is then no hot key of the join.
    """
    wanted = feed.filter(F.col("kind") == kind).select(F.col("indicator").alias(column)).distinct()
    bits = bit_map(wanted.filter(F.col(column).isNotNull()), column, slots)
    return df.filter(may_hold(bits, F.col(column), slots)).join(wanted, column, "left_semi")


def seen_in_feed(df: DataFrame, feed: DataFrame, column: str = "source_ip", kind: str = "ip") -> DataFrame:
    """Distinct observed values that the feed also lists."""
    seen = df.filter(F.col(column).isNotNull()).select(F.col(column).alias("indicator"))
    return seen.intersect(feed.filter(F.col("kind") == kind).select("indicator"))


def asset_findings(findings: DataFrame, assets: DataFrame) -> DataFrame:
    """Findings per asset with its type and criticality. Findings are counted per host before the join."""
    counts = findings.filter(F.col("host").isNotNull()).groupBy("host").agg(F.count(F.lit(1)).alias("n_findings"))
    return assets.join(counts, F.col("asset_name") == F.col("host"), "left").select(
        "asset_name", "asset_type",
        look_up(F.lower("asset_type"), V.ASSET_CRITICALITY, 40).cast("bigint").alias("criticality"),
        F.coalesce("n_findings", F.lit(0)).alias("n_findings"))


def distinct_union(*frames: DataFrame) -> DataFrame:
    """Append-if-absent over several lists: union, then one distinct."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out.distinct()
