"""Empty input, nulls, thresholds and band boundaries."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from trailhound.functions.lookup import banded
from trailhound import fixed_values as V
from trailhound.operators import aggregates, chains, detect, filters, iocs, packets, parse, playbooks, scoring, timeline

EVENTS = ("event_id bigint, ts timestamp_ntz, severity string, source string, user_name string, source_ip string, "
          "host string, raw_log string")


def events(spark, rows):
    return spark.createDataFrame(rows, EVENTS)


def event(i, text, severity="INFO", hour=12, host="h", ip="10.0.0.1", user="u"):
    ts = None if hour is None else dt.datetime(2024, 1, 1, hour, 0, 0)
    return (i, ts, severity, "s", user, ip, host, text)


def test_empty_input(spark):
    df = events(spark, [])
    findings = detect.detect_all(df)
    assert findings.count() == 0
    assert aggregates.finding_severity_counts(findings).first()["total_findings"] == 0
    assert detect.suspicious_patterns(detect.pattern_counts(df)).count() == 0
    assert chains.attack_chain(detect.pattern_counts(df)).count() == 0
    assert timeline.attack_phases(df).count() == 0
    assert iocs.extract(df, ["ip", "user"]).count() == 0
    score = scoring.overall_risk(findings, "2024-01-02 00:00:00").first()
    # nothing found: only the neutral recency of 50 counts
    assert (score["overall_risk_score"], score["risk_level"]) == (7.5, "INFO")


def test_null_fields(spark):
    df = events(spark, [(1, None, None, None, None, None, None, None), event(2, "ransomware", None, None)])
    kinds = {r["finding_type"] for r in detect.detect_all(df).collect()}
    assert kinds == {"ransomware"}
    assert timeline.attack_phases(df).count() == 0
    assert filters.high_severity(df).count() == 0


@pytest.mark.parametrize("n, fires", [(5, 0), (6, 1)])
def test_brute_force_threshold(spark, n, fires):
    df = events(spark, [event(i, "failed login") for i in range(n)])
    assert detect.brute_force_anomaly(detect.group_profile(detect.severity_profile(df))).count() == fires


@pytest.mark.parametrize("off, fires", [(3, 0), (4, 1)])
def test_off_hours_share(spark, off, fires):
    df = events(spark, [event(i, "x", hour=23 if i < off else 12) for i in range(10)])
    assert detect.off_hours_anomaly(detect.group_profile(detect.severity_profile(df))).count() == fires


@pytest.mark.parametrize("n, fires", [(100, 0), (101, 1)])
def test_port_scan_threshold(spark, n, fires):
    df = spark.range(n).select(
        F.lit("1.1.1.1").alias("src_ip"), F.lit(2).alias("tcp_flags_int"))
    assert packets.port_scans(df).count() == fires


def test_bands(spark):
    df = spark.createDataFrame([(s,) for s in (0, 19, 20, 39, 40, 69, 70, 89, 90, 100)], "s int")
    got = [r[0] for r in df.orderBy("s").select(banded(F.col("s"), V.RISK_BANDS)).collect()]
    assert got == ["INFO", "INFO", "LOW", "LOW", "MEDIUM", "MEDIUM", "HIGH", "HIGH", "CRITICAL", "CRITICAL"]


def test_error_filter_falls_back_to_text(spark):
    quiet = events(spark, [event(1, "disk failure"), event(2, "ok")])
    assert [r["event_id"] for r in filters.errors(quiet).collect()] == [1]
    loud = quiet.unionByName(events(spark, [event(3, "x", "ERROR")]))
    assert [r["event_id"] for r in filters.errors(loud).collect()] == [3]
    assert [r["event_id"] for r in filters.by_ip(quiet.withColumn("raw_log", F.lit("from 9.9.9.9")), "9.9.9.9")
            .orderBy("event_id").collect()] == [1, 2]


def test_flags_and_payload(spark):
    df = spark.createDataFrame(
        [(None, None), (0, "x"), (255, "eval( base64")], "tcp_flags_int int, payload string").withColumns({
            "icmp_type": F.lit(None).cast("int"), "dns_query": F.lit("bad.XYZ.xyz."), "dst_port": F.lit(4444),
            "http_user_agent": F.lit("Python-Requests")})
    got = packets.with_suspicious_flags(packets.with_tcp_flags(df), "payload").collect()
    assert [r["tcp_flags"] for r in got] == [None, "None", "FSRPAUEC"]
    assert got[2]["suspicious_flags"] == [
        "rst_packet", "dns_suspicious_tld_.xyz", "suspicious_ua_python", "encoded_payload", "code_execution",
        "suspicious_port_4444"]


def test_distinct_rows_option(spark):
    df = events(spark, [event(1, "file encryption: encryption spike, ransomware")])
    assert detect.row_findings(df, detect.keyword_hits).count() == 3
    assert detect.row_findings(df, detect.keyword_hits, distinct_rows=True).count() == 1


def test_own_rules(spark):
    df = events(spark, [event(1, "Kerberoast attempt"), event(2, "del /shadow copies now")])
    rules = [("kerberos", "anomalies", "HIGH", "kerberoast"), ("shadow", "anomalies", "CRITICAL", "del.*copies")]
    got = detect.row_findings(df, lambda t: detect.rule_hits(t, rules)).collect()
    assert {(r["event_id"], r["finding_type"]) for r in got} == {(1, "kerberos"), (2, "shadow")}


def test_internal_addresses_are_left_out(spark):
    df = events(spark, [event(1, "a 172.99.1.1 b 999.1.1.1 c 8.8.8.8", ip="127.0.0.1")])
    assert {r["value"] for r in iocs.extract(df, ["ip"]).collect()} == {"999.1.1.1", "8.8.8.8"}
    assert {r["value"] for r in iocs.extract(df, ["ip"], strict=True).collect()} == {"8.8.8.8"}


def test_feed_repeats_do_not_multiply_matches(spark):
    df = events(spark, [event(1, "to evil.example.com and EVIL.example.com", ip="8.8.8.8")])
    feed = spark.createDataFrame(
        [("8.8.8.8", "ip"), ("8.8.8.8", "ip"), ("evil.example.com", "domain")], "indicator string, kind string")
    assert sorted(r["matched"] for r in detect.ioc_matches(df, feed).collect()) == ["8.8.8.8", "evil.example.com"]


def test_playbook_order_of_substrings(spark):
    df = spark.createDataFrame([("high_severity_scan",), ("POWERSHELL_x",), ("port_scan",), ("x",)], "t string")
    got = {r[0]: r[1] for r in df.select("t", playbooks.playbook_key(F.col("t"))).collect()}
    assert got == {
        "high_severity_scan": "port_scan", "POWERSHELL_x": "suspicious_powershell", "port_scan": "port_scan",
        "x": "generic_compromise"}


def test_open_pairs_are_searched_once_a_line(spark):
    rows = [(1, 'X [WARN] a=1 b="two words" a="3" q="" u="open é=x z==1'), (2, "[INFO] none=" + "\t"), (3, "[INFO] nothing here"), (4, None),
            (5, 'INFO k="x" k="" _=a"b" k=""" v=")')]
    df = spark.createDataFrame(rows, "event_id bigint, line string")
    out = parse.parse_kv_open(df)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1
    got = {r["event_id"]: r["extras"] for r in out.collect()}
    want = {}
    for i, line in rows:
        found = re.search(V.KV_OPEN, line or "", re.ASCII)
        if found and re.search(r"\w+=", line, re.ASCII):
            want[i] = {k: quoted or raw for k, raw, quoted, _ in re.findall(V.KV_OPEN_PAIR, found.group(3), re.ASCII)}
    assert got == want and got[1]["a"] == "3" and got[1]["q"] == '""'
