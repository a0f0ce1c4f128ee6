"""Streams fed file by file must end with the batch result, for everything the watermark has closed."""

import datetime as dt

from pyspark.sql import functions as F

from trailhound import fixed_values as V
from trailhound.operators import aggregates, timeline
from trailhound.plans.fixtures import view
from trailhound.streaming import detectors as ST


def feed(spark, sf_dir, folder, parts=4):
    """The log view as several files in time order, and their stream."""
    e = view(spark, sf_dir, "log_events")
    times = sorted(r["ts"] for r in e.select("ts").collect())
    cuts = [times[len(times) * k // parts] for k in range(parts)] + [dt.datetime(9000, 1, 1)]
    for first, last in zip(cuts[:-1], cuts[1:], strict=True):  # one after the other: a file stream goes by the files' times
        e.filter((F.col("ts") >= F.lit(first)) & (F.col("ts") < F.lit(last))).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.read.parquet(str(folder)), ST.read_events(spark, str(folder), e.schema, per_trigger=1)


def test_ingest_equals_batch(spark, sf_dir, tmp_path):
    batch, stream = feed(spark, sf_dir, tmp_path / "in")
    got = ST.run_to_table(ST.ingest(stream.select("event_id", "line")), spark, str(tmp_path / "run"))
    want = ST.ingest(batch.select("event_id", "line"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_hourly_equals_batch_up_to_the_watermark(spark, sf_dir, tmp_path):
    batch, stream = feed(spark, sf_dir, tmp_path / "in")
    got = ST.run_to_table(ST.hourly(stream, "100 days"), spark, str(tmp_path / "late"))
    assert got.count() == 0  # nothing is closed while the delay covers the whole input
    got = ST.run_to_table(ST.hourly(stream, "40 days").filter("n > 0"), spark, str(tmp_path / "run"))
    limit = batch.agg(F.max("ts")).first()[0] - dt.timedelta(days=40)
    assert got.filter(F.col("hour").cast("timestamp_ntz") > F.lit(limit)).count() == 0


def test_hourly_batch_form(spark, sf_dir):
    e = view(spark, sf_dir, "log_events")
    got = ST.hourly(e).select(F.col("hour").cast("timestamp_ntz").alias("hour"), "n")
    assert got.exceptAll(aggregates.hourly(e)).count() == 0


def test_repeated_alerts_are_suppressed_across_files(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1, 0, i), "h", "alert") for i in range(4)]
    for i, row in enumerate(rows):
        spark.createDataFrame([row], "ts timestamp_ntz, host string, kind string").coalesce(1).write.mode(
            "append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = ST.read_events(spark, str(tmp_path / "in"), schema, per_trigger=1)
    got = ST.run_to_table(ST.first_alerts(stream, ["host", "kind"], "1 hour"), spark, str(tmp_path / "run"))
    assert got.count() == 1


def test_feed_match_equals_batch(spark, sf_dir, tmp_path):
    batch, stream = feed(spark, sf_dir, tmp_path / "in")
    known = view(spark, sf_dir, "ioc_feed")
    got = ST.run_to_table(ST.ioc_matches(stream, known).select("event_id"), spark, str(tmp_path / "run"))
    assert got.count() == ST.ioc_matches(batch, known).count() > 0


def equal(a, b):
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    key = lambda r: tuple(str(r[c]) for c in columns)
    assert sorted(map(key, a.collect())) == sorted(map(key, b.collect()))


def test_closed_streams_equal_batch_to_the_last_event(spark, sf_dir, tmp_path):
    batch, stream = feed(spark, sf_dir, tmp_path / "in")
    equal(ST.run_to_end(stream, ST.hourly, str(tmp_path / "hourly")), ST.hourly(batch))
    equal(ST.run_to_end(stream, ST.sessions, str(tmp_path / "sessions")), ST.sessions(batch))
    many = lambda df: ST.brute_force(df, "24 hours", "12 hours", 0)
    equal(ST.run_to_end(stream, many, str(tmp_path / "brute")), many(batch))


def test_what_is_open_waits_for_the_closing_step(spark, sf_dir, tmp_path):
    batch, stream = feed(spark, sf_dir, tmp_path / "in")
    found = ST.hourly(ST.with_closing(stream, str(tmp_path / "closing")))
    before = ST.run_to_table(found, spark, str(tmp_path / "run")).count()
    assert before < ST.hourly(batch).count()
    assert ST.run_to_table(found, spark, str(tmp_path / "run")).count() == before  # nothing new, nothing twice
    ST.close(stream, str(tmp_path / "closing"))
    equal(ST.run_to_table(found, spark, str(tmp_path / "run")), ST.hourly(batch))


def test_phases_on_a_stream_equal_batch(spark, sf_dir, tmp_path):
    batch, stream = feed(spark, sf_dir, tmp_path / "in", 5)
    got = ST.run_to_end(stream, ST.phases, str(tmp_path / "run"))
    want = timeline.attack_phases(batch, ("user_name",))
    equal(got.withColumn("ts", F.col("ts").cast("timestamp_ntz")), want)


def test_phases_wait_for_rows_out_of_order(spark, tmp_path):
    """Within the delay a later file may hold earlier rows; ties go by id; a user of one event needs a timer."""
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    schema = "event_id bigint, ts timestamp_ntz, user_name string, raw_log string"
    words = {"recon": "x"} | {phase: w[0] for phase, w in V.PHASE_RULES}
    names = [p for p, _ in V.PHASE_RULES][:2]
    files = [[(5, at(30), "u", "x"), (1, at(10), "u", "x"), (9, at(20), "v", words[names[1]])],
             [(2, at(10), "u", words[names[0]]), (3, at(20), "u", words[names[1]])], [(7, at(50), "u", "x")]]
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
        spark.read.parquet(str(tmp_path / f"in/{k}")).coalesce(1).write.mode("append").parquet(str(tmp_path / "all"))
    stream = ST.read_events(spark, str(tmp_path / "all"), spark.read.parquet(str(tmp_path / "all")).schema, per_trigger=1)
    got = {r["event_id"]: r["phase"] for r in ST.run_to_end(stream, ST.phases, str(tmp_path / "run")).collect()}
    assert got == {1: V.FIRST_PHASE, 2: names[0], 3: names[1], 5: names[1], 7: names[1], 9: names[1]}


def test_a_changing_feed_and_a_batch_run_again(spark, tmp_path):
    rows = lambda *ips: spark.createDataFrame([(i, ip) for i, ip in enumerate(ips)], "event_id bigint, source_ip string").coalesce(1)
    known = ["a"]
    read_feed = lambda: spark.createDataFrame([(k, "ip") for k in known], "indicator string, kind string")
    folder, run = str(tmp_path / "in"), str(tmp_path / "run")
    rows("a", "b", "a").write.parquet(folder)
    stream = ST.read_events(spark, folder, spark.read.parquet(folder).schema)
    found = lambda: sorted((r["batch"], r["source_ip"]) for r in ST.ioc_matches_to_table(stream, read_feed, run).collect())
    assert found() == [(0, "a"), (0, "a")]
    known.append("b")
    rows("b", "c", "a").write.mode("append").parquet(folder)
    assert found() == [(0, "a"), (0, "a"), (1, "a"), (1, "b")]
    commit = tmp_path / "run/state/commits/1"
    for lost in (commit, commit.with_name(".1.crc")):  # as if the driver had been lost before the batch was marked as done
        lost.unlink(missing_ok=True)
    assert found() == [(0, "a"), (0, "a"), (1, "a"), (1, "b")]
