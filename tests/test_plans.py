"""Plans: no Python in the hot path, no nested-loop joins, pruned scans, pushed filters, one scan for the rules."""

import pytest
from pyspark.sql import functions as F

from trailhound.operators import detect, filters, iocs, joins, parse, scoring
from trailhound.plans.catalog import QUERIES
from trailhound.plans.fixtures import view

BANNED = ["BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroups", "CartesianProduct", "BroadcastNestedLoop"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stored") / "events")
    view(spark, sf_dir, "log_events").write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("name", [n for n in sorted(QUERIES) if not n.startswith(("st_", "src_", "snk_"))])
def test_no_python_and_no_nested_loops(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert not [b for b in BANNED if b in text]


def test_row_rules_are_one_narrow_stage(stored):
    text = plan(detect.row_findings(stored))
    assert "Exchange" not in text and "Join" not in text
    assert text.count("FileScan") == 1
    assert "line#" not in text  # the wide text column that no rule needs is not read


def test_all_detectors_read_the_events_twice(stored):
    """Once for the row rules and once for everything that is counted."""
    assert plan(detect.detect_all(stored)).count("FileScan") == 2


def test_filters_reach_the_scan(stored):
    text = plan(stored.filter(F.col("severity") == "CRITICAL").select("event_id"))
    assert "EqualTo(severity,CRITICAL)" in text
    assert "PushedFilters: [IsNotNull(ts)]" in plan(
        detect.hourly(stored)) or "IsNotNull(ts)" in plan(detect.hourly(stored))


def test_parsers_do_not_shuffle(stored):
    assert "Exchange" not in plan(parse.parse_any(stored.select("event_id", "line")))
    assert "Exchange" not in plan(parse.parse_kv8(stored.select("event_id", "line")))


def test_aggregates_combine_before_the_shuffle(stored):
    for df in (detect.pattern_counts(stored), detect.severity_profile(stored, ("source_ip",)),
               iocs.extract(stored, ["ip", "user"]), scoring.finding_profile(detect.row_findings(stored), ("host",))):
        text = plan(df)
        assert "partial_count" in text
        assert text.count("Exchange") == 1


def test_feed_join_strategy_follows_size(spark, stored):
    feed = spark.range(10).select(F.col("id").cast("string").alias("indicator"), F.lit("ip").alias("kind"))
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" in plan(joins.in_feed(stored, feed))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
    assert "BroadcastHashJoin" in plan(joins.in_feed(stored, feed))


def test_fallback_filter_needs_no_join(stored):
    assert "Join" not in plan(filters.errors(stored))
