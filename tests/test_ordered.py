"""Ordered operators against brute force, with one key holding most rows and values crossing many ranges."""

import datetime as dt
import random

from pyspark.sql import functions as F

from trailhound.operators import timeline

START = dt.datetime(2024, 1, 1)


def made(n=400, seed=3):
    random.seed(seed)
    out = []
    for i in range(n):
        host = "hot" if random.random() < 0.6 else random.choice(["a", "b", None])
        # many events share a time, so ties must be broken by id
        ts = START + dt.timedelta(minutes=random.choice([0, 0, 0, random.randrange(600)]))
        mark = random.choice([None] * 12 + ["x", "y"])
        out.append((i, ts, host, mark))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, host string, mark string")


def expected(rows, keyed, before):
    last, out = {}, {}
    for i, ts, host, mark in sorted(rows, key=lambda r: (r[1], r[0])):
        key = host if keyed else 0
        if before:
            out[i] = last.get(key)
        if mark is not None:
            last[key] = mark
        if not before:
            out[i] = last.get(key)
    return out


def test_carry_forward_matches_brute_force(spark):
    rows = made()
    df = frame(spark, rows)
    for keys in ((), ("host",)):
        for before in (False, True):
            for ranges in (1, 7, 40):
                got = timeline.carry_forward(
                    df, F.col("mark"), "filled", keys, before_current=before, ranges=ranges).collect()
                assert len(got) == len(rows)
                assert {r["event_id"]: r["filled"] for r in got} == expected(rows, bool(keys), before)


def test_ranges_split_a_hot_key(spark):
    rows = [(i, START, "hot", None) for i in range(4000)]
    df = frame(spark, rows).repartitionByRange(8, "host", "ts", "event_id").groupBy(
        F.spark_partition_id().alias("p")).count()
    assert max(r["count"] for r in df.collect()) < 2000


def test_sequences_match_brute_force(spark):
    rows = made(300, 5)
    df = frame(spark, rows)
    first, then = F.coalesce(F.col("mark") == "x", F.lit(False)), F.coalesce(F.col("mark") == "y", F.lit(False))
    got = {(r["event_id"], r["first_event_id"]) for r in timeline.sequences(
        df, first, then, ("host",), 2, ranges=9).collect()}
    want = set()
    for i, ts, host, mark in rows:
        if mark == "y":
            prior = [(t, j) for j, t, h, m in rows if m == "x" and h == host and (t, j) < (ts, i)]
            if prior and ts - max(prior)[0] <= dt.timedelta(hours=2):
                want.add((i, max(prior)[1]))
    assert want and got == want


def test_trend(spark):
    df = spark.createDataFrame(
        [("a", 1, 10.0), ("a", 2, 25.0), ("a", 3, 15.0), ("a", 4, 4.0)], "k string, t int, score double")
    got = [r["trend"] for r in timeline.risk_trend(df, ("k",), "t", "score").orderBy("t").collect()]
    assert got == ["STABLE", "INCREASING", "STABLE", "DECREASING"]
