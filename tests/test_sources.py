"""Readers on small files: delimiters, encodings, line numbers across file blocks, mixed formats."""

import json

import pytest
from pyspark.sql import functions as F

from trailhound.operators import detect, normalize, parse, reports, scoring
from trailhound.sources import feeds, files


def test_delimiters():
    assert files.sniff_delimiter("a,b;c") == ","
    assert files.sniff_delimiter("a;b;c,d") == ";"
    assert files.sniff_delimiter("a|b|c") == "|"
    assert files.sniff_delimiter("plain") == ","


def test_csv_encodings_mix(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("name;n\nMüller;1\n".encode("utf-8"))
    (tmp_path / "b.csv").write_bytes("name;n\nMüller;2\n".encode("latin-1"))
    got = files.read_csv(spark, str(tmp_path)).collect()
    assert {(r["name"], r["n"]) for r in got} == {("Müller", "1"), ("Müller", "2")}


def test_csv_without_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("one\ntwo\n")
    assert files.read_csv_any(spark, str(tmp_path)).count() == 2


def test_json_array_and_object(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": 1, "o": {"x": "p", "y": {"z": 2}}}, {"id": 2}]))
    (tmp_path / "b.json").write_text(json.dumps({"id": 3, "o": {"x": "q"}}))
    got = files.read_json(spark, str(tmp_path))
    assert set(got.columns) == {"id", "o_x", "o_y_z"}
    assert got.count() == 3


def test_line_numbers_across_blocks(spark, tmp_path):
    """Small blocks put one file into many tasks; numbers must still run through, blank lines counted."""
    texts = {}
    for name in ("one.log", "two.log"):
        lines = [f"{name} line {i} " + "x" * (i % 50) if i % 7 else "" for i in range(900)]
        (tmp_path / name).write_text("\n".join(lines))
        texts.update({(name, i): line for i, line in enumerate(lines) if line})
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        df = files.read_text(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 4
        got = {(r["file_name"], r["line_number"]): r["raw_log"] for r in df.collect()}
        assert got == texts
        capped = files.read_text(spark, str(tmp_path), max_rows=10)
        assert max(r["line_number"] for r in capped.collect()) == 9
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)


def test_mixed_formats(spark, tmp_path):
    (tmp_path / "a.csv").write_text("event_id,level\n1,INFO\n")
    (tmp_path / "b.json").write_text('[{"event_id": 2, "level": "WARN"}]')
    (tmp_path / "c.log").write_text("plain text\n\n")
    (tmp_path / "d.unknown").write_text('{"event_id": 3, "level": "HIGH"}')
    (tmp_path / "e").write_text("id;v\n4;5\n")
    got = files.read_any(spark, [str(tmp_path / n) for n in ("a.csv", "b.json", "c.log", "d.unknown", "e")])
    assert {(r["source_format"], r["event_id"]) for r in got.collect()} == {
        ("csv", "1"), ("json", "2"), ("json", "3"), ("text", None), ("csv", None)}


def test_manifest(spark, tmp_path):
    (tmp_path / "b").mkdir()
    for name, text in (("a.log", "one\ntwo\n"), ("b/a.log", "one\ntwo\n"), ("c.log", "two\none\n"), ("d.csv", "x;y;z\n1;2;3\n")):
        (tmp_path / name).write_text(text)
    rows = {r["path"].removeprefix(f"file:{tmp_path}/"): r for r in files.manifest(
        spark, [str(tmp_path / n) for n in ("a.log", "b/a.log", "c.log", "d.csv")]).collect()}
    assert len(rows) == 4
    assert (rows["a.log"]["file_name"], rows["a.log"]["rows"], rows["a.log"]["columns"]) == ("a.log", 2, 1)
    assert rows["d.csv"]["columns"] == 3
    assert all(len(r["file_hash"]) == 32 for r in rows.values())
    assert rows["a.log"]["file_hash"] == rows["b/a.log"]["file_hash"] != rows["c.log"]["file_hash"]


def test_allowed(spark, tmp_path):
    for name in ("a.log", "b.exe", "c.PCAP"):
        (tmp_path / name).write_text("x")
    listed = files.file_list(spark, [str(tmp_path / n) for n in ("a.log", "b.exe", "c.PCAP")])
    assert {r["extension"] for r in files.allowed_files(listed).collect()} == {".log", ".pcap"}
    assert files.allowed_files(listed, max_bytes=0).count() == 0


def test_no_reader_loses_records(spark, tmp_path):
    objects = [json.dumps({"event_id": i, "v": "x"}) for i in range(5)]
    (tmp_path / "lines.json").write_text("\n".join(objects))
    (tmp_path / "lines.dat").write_text("\n".join(objects))
    (tmp_path / "array.json").write_text("[\n" + ",\n".join(objects) + "\n]")
    (tmp_path / "object.json").write_text('{\n"event_id": 9,\n"v": "y"}')
    for i in range(3):
        (tmp_path / f"bare{i}.csv").write_text(f"{i},alpha\n{i + 10},beta\n")
    (tmp_path / "named.csv").write_text("event_id,v\n7,z\n")
    got = files.read_any(spark, [str(p) for p in tmp_path.iterdir()])
    assert got.groupBy("source_format").count().collect() and got.filter("source_format = 'json'").count() == 16
    assert sorted(r["_c0"] for r in got.filter("_c0 is not null").collect()) == ["0", "1", "10", "11", "12", "2"]
    assert [r["event_id"] for r in got.filter("source_format = 'csv' and v = 'z'").collect()] == ["7"]


def test_files_that_differ_share_a_branch_when_they_can(spark, tmp_path):
    for i in range(60):
        (tmp_path / f"{i}.csv").write_text(f"{i};some text {i};10.0.0.{i}\n")
    got = files.read_csv_any(spark, str(tmp_path))
    assert got.count() == 60 and len(got.columns) == 3
    assert "Union" not in got._jdf.queryExecution().toString()


def test_empty_and_binary_input(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert files.read_any(spark, str(tmp_path / "none")).collect() == []
    (tmp_path / "x.evtx").write_bytes(b"ElfFile\x00\x00rest")
    with pytest.raises(ValueError, match="binary event log"):
        files.read_winevents(spark, str(tmp_path / "x.evtx"))


def test_event_records_in_lines_and_arrays(spark, tmp_path):
    record = lambda i: json.dumps({"Event": {"System": {"EventID": {"#text": str(i)}, "Computer": "h"}}})
    (tmp_path / "a.json").write_text(record(1) + "\nno record\n" + record(2) + "\n")
    (tmp_path / "b.json").write_text("[\n" + record(3) + ",\n" + record(4) + "\n]")
    assert sorted(r["event_id"] for r in files.read_winevents(spark, str(tmp_path)).collect()) == ["1", "2", "3", "4"]
    assert files.winevent_rejects(spark.read.text(str(tmp_path / "a.json"))).count() == 1


def test_canonical_events_of_all_layouts(spark):
    lines = [
        "<34>Jan  5 10:00:01 host1 sshd[77]: failed password", "10.0.0.1 - bob [05/Jan/2024:10:00:01 +0000] \"GET /x HTTP/1.1\" 200 5",
        "2024-01-05T10:00:01.000Z ERROR | AUTH | failed login", "2024-01-05 10:00:01.000Z WARN | DB | slow",
        "2024-01-05 10:00:01,000 INFO [app] started", "HIGH | SECURITY | breach", "2024-01-05 10:00:01 ERROR gateway down",
        '2024-01-05T10:00:01Z [ERROR] service=app user=eve ip=10.0.0.9 session=zz event="bad"',
        '{"Time": "2024-01-05T10:00:01Z", "Level": "high", "Account": "mallory", "note": {"a": 1}}', "plain words", "",
    ]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    events = normalize.canonical(parse.parse_any(df))
    assert events.columns == list(normalize.CANONICAL)
    got = {r["raw_log"]: r for r in events.collect()}
    assert got[lines[7]]["extras"]["session"] == "zz" and got[lines[7]]["user_name"] == "eve"
    assert (got[lines[8]]["user_name"], got[lines[8]]["severity"], got[lines[8]]["extras"]["note"]) == ("mallory", "HIGH", '{"a":1}')
    assert str(got[lines[8]]["ts"]) == "2024-01-05 10:00:01"
    assert len({r["event_id"] for r in got.values()}) == len(lines)
    assert detect.detect_all(events).filter("list_name = 'failed_logins'").count() > 0
    bare = normalize.canonical(spark.createDataFrame([("x", 3)], "odd string, n int"))
    assert bare.first()["extras"] == {"odd": "x", "n": "3"} and bare.first()["ts"] is None


def test_noncharacters_in_lines_survive(spark):
    df = spark.createDataFrame([("2024-01-05T10:00:01.000Z ERROR | AUTH | b\uffffc\ufffe0d",)], "line string")
    assert parse.parse_layout(df, "iso_pipe").first()["message"] == "b\uffffc\ufffe0d"


def test_planning_a_backfill_runs_no_job(spark):
    df = spark.createDataFrame([("ip=1.2.3.4",)], "raw_log string")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plan", "plan")
    try:
        out = normalize.backfill(df)
        assert len(tracker.getJobIdsForGroup("plan")) == 0
        assert out.first()["source_ip"] == "1.2.3.4"
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_evidence_keeps_the_group_without_a_host(spark):
    rows = [(1, None, "failed login", None), (2, "h1", "ransomware detected", "8.8.8.8")]
    df = spark.createDataFrame(rows, "event_id long, host string, raw_log string, source_ip string").withColumns(
        {"ts": F.lit(None).cast("timestamp_ntz"), "user_name": F.lit(None).cast("string"), "severity": F.lit("HIGH")})
    got = {r["host"]: r["n_external_ip"] for r in scoring.evidence_counts(df, ("host",)).collect()}
    assert got == {None: 0, "h1": 1}


def test_feed_matches_read_events_once(spark, sf_dir, tmp_path):
    from trailhound.plans.fixtures import view

    view(spark, sf_dir, "log_events").write.parquet(str(tmp_path / "e"))
    view(spark, sf_dir, "ioc_feed").write.parquet(str(tmp_path / "f"))
    plan = detect.ioc_matches(spark.read.parquet(str(tmp_path / "e")), spark.read.parquet(str(tmp_path / "f")))
    assert plan._jdf.queryExecution().executedPlan().toString().count("FileScan") == 2


def test_feed(spark, tmp_path):
    (tmp_path / "ips.txt").write_text("1.2.3.4\n\n  5.6.7.8 \n")
    assert {r["indicator"] for r in feeds.read_feed(spark, str(tmp_path), "ip").collect()} == {"1.2.3.4", "5.6.7.8"}


def test_backfill_decides_for_the_whole_input(spark):
    df = spark.createDataFrame(
        [("login from 9.9.9.9 username bob", None), ("ip=8.8.8.8 x", None)], "raw_log string, severity string")
    whole = normalize.backfill(df).orderBy("raw_log").collect()
    # the direct pattern finds something in one row, so the looser one is not used for the other
    assert [r["source_ip"] for r in whole] == ["8.8.8.8", None]
    # no row has user=, so the looser pattern is used
    assert [r["user_name"] for r in whole] == [None, "bob"]
    each = normalize.backfill(df, per_row=True).orderBy("raw_log").collect()
    assert [r["source_ip"] for r in each] == ["8.8.8.8", "9.9.9.9"]


def test_key_value_repeats_and_quotes(spark):
    line = '2026-01-01T00:00:01Z [warn] service=a user=u1 user=u2 zone="east 1" event="Reset by peer"'
    df = spark.createDataFrame([(line,)], "line string")
    row = parse.parse_kv_open(df).first()
    assert (row["severity"], row["user_name"], row["extras"], row["message"]) == (
        "WARN", "u2", {"zone": "east 1"}, "Reset by peer")
    assert parse.parse_kv_map(df).first()["pairs"]["user"] == "u2"


def test_mixed_lines(spark):
    lines = [
        "<34>Jan  5 10:00:01 host1 sshd[77]: failed", "Jan 5 10:00:01 host1 sshd: failed", "nothing here",
        "HIGH | SECURITY | breach", "BOGUS | SECURITY | breach", '{"a": 1}', "an Error happened", "",
    ]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "id int, line string")
    got = {r["id"]: r for r in parse.parse_any(df).collect()}
    assert [got[i]["line_format"] for i in range(len(lines))] == [
        "syslog", "syslog_nopri", "raw", "sev_pipe", "raw", "json", "sev_anywhere", "raw"]
    assert (got[0]["severity"], got[0]["process"], got[0]["host"]) == ("CRITICAL", "sshd", "host1")
    assert str(got[1]["ts_parsed"]) == "2024-01-05 10:00:01"
    assert got[6]["severity"] == "ERROR"


def test_aliases_prefer_the_first(spark):
    df = spark.createDataFrame([("t", "1.1.1.1", "2.2.2.2")], "`Event Time` string, src string, ip string")
    got = normalize.standardize(df)
    assert got.first()["source_ip"] == "1.1.1.1"
    assert normalize.find_column(["A", "Level"], ["severity", "level"]) == "Level"
    assert normalize.find_column(["A"], ["severity"]) is None


def test_write_all_formats_agree(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", all'), (2, None)], "id int, text string")
    paths = reports.write_all(df, str(tmp_path / "out"))
    assert set(paths) == {"json", "csv", "parquet"}
    back = spark.read.option("header", True).option("escape", '"').csv(paths["csv"])
    assert {r["text"] for r in back.collect()} == {'say "hi", all', None}
    assert spark.read.json(paths["json"]).count() == 2


def test_empty_text_input(spark):
    df = spark.createDataFrame([], "line string")
    assert parse.input_format(df).count() == 0
    assert parse.parse_any(df).count() == 0
    assert df.select(F.col("line")).count() == 0


def test_a_first_line_of_words_is_kept_where_files_have_no_header(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("alice,login,ok\nbob,logout,ok\n")
    assert files.read_any(spark, str(tmp_path / "in"), header=False).count() == 2
    assert files.read_any(spark, str(tmp_path / "in")).columns[:3] == ["alice", "login", "ok"]


def test_a_broken_array_is_a_reject(spark, tmp_path):
    good = '{"Event": {"System": {"Level": "4"}}}'
    (tmp_path / "good.json").write_text(f"[\n{good},\n{good}\n]")
    (tmp_path / "bad.json").write_text(f"[\n{good},\n{{broken\n]")
    records = files.winevent_records(spark, str(tmp_path))
    assert files.winevent_columns(records).count() == 2
    assert [r["value"] for r in files.winevent_rejects(records).collect()] == [(tmp_path / "bad.json").read_text()]
