"""User rules, mergeable distinct counts, top-k by candidates, ordered passes in two steps."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from trailhound.operators import aggregates, detect, distinct, joins, packets, registry, reports, timeline
from trailhound.plans.fixtures import view

EVENT = "event_id bigint, ts timestamp_ntz, user_name string, source_ip string, host string, raw_log string"
RULE = "rule_id string, category string, pattern string, severity string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rules_equal_trying_each_on_each_row(spark):
    rng = random.Random(2)
    words = ["Admin", "powershell", "-enc", "reg add", "x", "ÄÖ", "10.0.0.1", "ab", "\n", "(", "*", "a.b", ""]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 9))) for _ in range(60)] + [None, "", "z" * 20_000 + "admin"]
    patterns = ["admin", "ADMIN power", "ab", "-", "x", "a.b", "*", "reg.*add", "power.*-enc", "a.*|zz", "(reg|x).*a", "[ax]dmin.*10", "q+min.*x",
                "admi?n.*ps", r"10\.0.*1", ".*", "äö", "n\nx", None, "", "admin"]
    events = spark.createDataFrame([(i, dt.datetime(2024, 1, 1), None, None, "h", t) for i, t in enumerate(texts)], EVENT)
    rules = spark.createDataFrame([(str(k), f"c{k}", p, "HIGH") for k, p in enumerate(patterns)], RULE)
    got = sorted((r["event_id"], r["matched"]) for r in registry.rule_findings(events, rules).collect())
    want = []
    for i, t in enumerate(texts):
        for k, p in enumerate(patterns):
            if t is None or not p:
                continue
            hit = re.search(p, t, re.IGNORECASE | re.ASCII) if ".*" in p else p.lower() in t.lower()
            if hit:
                want.append((i, str(k)))
    assert got == sorted(want)


def test_rules_meet_rows_by_an_equi_join(spark, sf_dir):
    rules = spark.createDataFrame([(str(k), "c", f"user{k} ", "LOW") for k in range(1000)], RULE)
    text = plan(registry.rule_findings(view(spark, sf_dir, "log_events"), rules))
    assert "NestedLoop" not in text and "Cartesian" not in text and "HashJoin" in text or "SortMergeJoin" in text
    assert registry.rule_findings(view(spark, sf_dir, "log_events"), rules.limit(0)).collect() == []


def test_rules_are_made_once(spark, sf_dir):
    made = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").cast("string").alias("rule_id"), F.lit("c").alias("category"),
                                                                  F.concat(F.lit("user"), "user_id").alias("pattern"), F.lit("LOW").alias("severity"))
    text = registry.rule_findings(view(spark, sf_dir, "log_events"), made)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Relation [") == 2, "the rows and the stored rules; nothing of what makes the rules"


def test_distinct_counts_need_no_expand_and_merge(spark, sf_dir):
    e = view(spark, sf_dir, "log_events")
    assert "Expand" not in plan(aggregates.dashboard(e)) and "Expand" not in plan(packets.summary(view(spark, sf_dir, "packets")))
    values = {"ips": F.col("source_ip"), "users": F.col("user_name")}
    parts = [distinct.value_table(e.filter(F.col("event_id") % 2 == k), values) for k in (0, 1)]
    got = distinct.exact_counts(distinct.merged_values(parts[0].unionByName(parts[1])), ["ips", "users"], ["rows"]).first()
    want = e.agg(F.countDistinct("source_ip"), F.countDistinct("user_name"), F.count("*")).first()
    assert tuple(got) == tuple(want)
    empty = distinct.exact_counts(distinct.value_table(e.limit(0), values), ["ips", "users"], ["rows"]).first()
    assert tuple(empty) == (0, 0, 0)


def test_sketches_of_days_merge(spark):
    df = spark.range(40_000).select((F.col("id") % 10).alias("day"), (F.col("id") % 15_000).alias("v"), F.lit(None).cast("string").alias("w"))
    sketched = distinct.sketches(df, {"v": F.col("v"), "w": F.col("w")}, ("day",))
    got = distinct.estimates(sketched, ["v", "w"]).first()
    assert abs(got["v"] - 15_000) < 450 and got["w"] == 0
    by_day = {r["day"]: r["v"] for r in distinct.estimates(sketched, ["v"], ("day",)).collect()}
    assert all(abs(n - 1500) < 45 for n in by_day.values()) and len(by_day) == 10


@pytest.mark.parametrize("tracked, candidates", [(100_000, True), (64, False)])
def test_top_by_candidates_is_exact(spark, tracked, candidates):
    rng = random.Random(4)
    values = [f"v{int(rng.paretovariate(0.6)) % 4000}" for _ in range(6000)] + ["tie1"] * 300 + ["tie0"] * 300 + [None] * 9
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(6)
    top = distinct.exact_top(df, "v", 7, tracked=tracked)
    want = df.filter("v is not null").groupBy("v").count().orderBy(F.desc("count"), "v").limit(7).collect()
    assert [tuple(r) for r in top.rows.orderBy(F.desc("n"), "v").collect()] == [tuple(r) for r in want]
    assert top.by_candidates == candidates or not candidates


def test_top_of_few_and_of_none(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "v string")
    assert [tuple(r) for r in distinct.exact_top(df, "v", 10).rows.orderBy(F.desc("n")).collect()] == [("a", 2), ("b", 1)]
    assert distinct.exact_top(df.limit(0), "v", 10).rows.collect() == []
    flat = spark.range(5000).select((F.col("id") % 1000).cast("string").alias("v"))  # no value stands out
    top = distinct.exact_top(flat, "v", 3, tracked=16)
    assert not top.by_candidates and [r["v"] for r in top.rows.collect()] == ["0", "1", "10"]


def jobs(spark, group, action):
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = action()
        return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_an_ordered_plan_starts_no_job(spark, sf_dir):
    e = view(spark, sf_dir, "log_events")
    ranged, stored_by = jobs(spark, "store", lambda: timeline.store_phases(e, ("host",)))
    assert stored_by > 0
    df, built_by = jobs(spark, "build", lambda: timeline.phases_of(ranged))
    assert built_by == 0
    assert df.count() == e.count()
    ranged.remove()


def test_ranges_follow_the_rows_and_not_the_session(spark):
    df = spark.range(20_000).select(F.col("id").alias("event_id"), F.lit(dt.datetime(2024, 1, 1)).alias("ts"), F.lit("hot").alias("host"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    counts = []
    for n in ("2", "9"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        ranged = timeline.store_ranges(df, F.lit(None).cast("string"), ("host",), rows_per_range=2000)
        sizes = [r["count"] for r in ranged.rows.groupBy("_range").count().collect()]
        counts.append(len(sizes))
        assert max(sizes) < 6000  # one key, one time: ids cut it
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert counts[0] == counts[1] > 5


def test_a_day_written_again_is_one_copy(spark, sf_dir, tmp_path):
    e = view(spark, sf_dir, "log_events").select("event_id", "ts", "severity")
    undated = e.limit(3).withColumn("ts", F.lit(None).cast("timestamp_ntz"))
    path = reports.write_days(e.unionByName(undated), str(tmp_path / "days"))
    one = F.to_date("ts") == F.lit("2024-01-05").cast("date")
    for _ in range(2):
        reports.write_days(e.filter(one), path)
    back = spark.read.parquet(path)
    assert back.count() == e.count() + 3 and back.filter("day is null").count() == 3
    assert sorted(map(str, back.filter("day is not null").drop("day").collect())) == sorted(map(str, e.collect()))
    reports.write_days(e.filter(one).limit(1), path)
    assert spark.read.parquet(path).filter("day = date'2024-01-05'").count() == 1


def test_a_time_filter_reads_only_its_days(spark, sf_dir, tmp_path):
    path = reports.write_days(view(spark, sf_dir, "log_events").select("event_id", "ts"), str(tmp_path / "days"))
    at = lambda text: F.lit(text).cast("timestamp_ntz")
    got = reports.read_between(spark, path, at("2024-01-05 12:00:00"), at("2024-01-06 00:00:00"))
    text = plan(got)
    assert re.search(r"PartitionFilters: \[[^\]]*day", text)
    assert {r["day"] for r in got.select(F.col("day").cast("string").alias("day")).distinct().collect()} == {"2024-01-05"}


def test_rows_shuffled_for_a_large_feed_are_near_the_matches(spark, tmp_path):
    """With the feed beyond the broadcast limit, what reaches the exchange of the events is counted in the running plan."""
    rows = spark.range(20_000).select(
        F.col("id").alias("event_id"), F.lit(None).cast("timestamp_ntz").alias("ts"), F.lit(None).cast("string").alias("user_name"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("ip"), F.col("id"))).alias("source_ip"),
        F.lit(None).cast("string").alias("host"), F.lit("x").alias("raw_log"))
    rows.write.parquet(str(tmp_path / "events"))
    events = spark.read.parquet(str(tmp_path / "events"))
    feed = spark.range(3000).select(F.concat(F.lit("ip"), F.col("id") * 31).alias("indicator"), F.lit("ip").alias("kind"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        near, plain = joins.in_large_feed(events, feed), joins.in_feed(events, feed)
        assert "SortMergeJoin" in plan(near)
        assert sorted(r["event_id"] for r in near.collect()) == sorted(r["event_id"] for r in plain.collect())
        found = detect.ioc_matches(events, feed, slots=joins.FEED_SLOTS)
        assert sorted(r["event_id"] for r in found.collect()) == sorted(r["event_id"] for r in detect.ioc_matches(events, feed).collect())
        kept = events.filter(joins.may_hold(joins.bit_map(feed, "indicator", joins.FEED_SLOTS), F.col("source_ip"), joins.FEED_SLOTS)).count()
        assert plain.count() <= kept < plain.count() + 200
        joined = near._jdf.queryExecution().executedPlan().toString()
        assert joined.index("Filter") > joined.index("Exchange")  # the test stands under the exchange, in the scan stage
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
