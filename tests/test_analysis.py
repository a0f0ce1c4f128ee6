"""One analysis: counts that can be added up, and everything that follows from them, against the findings themselves."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from trailhound.operators import aggregates, analysis, detect, mitre, playbooks, reports, scoring
from trailhound.plans import q_core, q_outputs, q_scores
from trailhound.plans.fixtures import view

AS_OF = "2024-01-31 00:00:00"


def same(a, b):
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    key = lambda r: tuple(str(r[c]) for c in columns)
    assert sorted(map(key, a.collect())) == sorted(map(key, b.collect()))


@pytest.fixture(scope="module")
def events(spark, sf_dir):
    return view(spark, sf_dir, "log_events").cache()


@pytest.fixture(scope="module")
def found(events):
    return analysis.analyse(events)


@pytest.fixture(scope="module")
def findings(events):
    return detect.detect_all(events).cache()


def test_profile_equals_that_of_the_events(events, found):
    """All that is made of the profile; keyword findings stand beside the severities of the events, not under them."""
    for by in ((), ("host",)):
        mine, plain = found.profile(by), detect.severity_profile(events, by)
        same(scoring.detector_score(mine, AS_OF, by), scoring.detector_score(plain, AS_OF, by))
        same(detect.group_profile(mine, by), detect.group_profile(plain, by))
        counted = [*by, "severity", "n_events", "n_auth_fail", "n_off_hours", "n_timed", "latest_ts"]
        same(mine.filter("n_events > 0").select(counted), plain.select(counted))


@pytest.mark.parametrize("derive", [
    lambda f: scoring.finding_profile(f), lambda f: scoring.finding_profile(f, ("host",)),
    lambda f: scoring.overall_risk(f, AS_OF, ("host",)), lambda f: aggregates.finding_severity_counts(f, ("host",)),
    lambda f: aggregates.categories(f), lambda f: mitre.map_findings(f), lambda f: playbooks.response_plan(f),
    lambda f: playbooks.all_playbooks(f).select("playbook", "n_findings"), lambda f: playbooks.dashboard_playbooks(f),
    lambda f: reports.technical_counts(f), lambda f: scoring.report_confidence(f, ("host",))])
def test_what_follows_equals_what_follows_from_the_findings(found, findings, derive):
    same(derive(found.findings()), derive(findings))


def test_asset_risk_equals_that_of_the_findings(spark, sf_dir, found, findings):
    assets = view(spark, sf_dir, "assets")
    same(scoring.asset_risk(found.findings(), assets), scoring.asset_risk(findings, assets))


def test_counts_of_parts_add_up(events, found):
    parts = [analysis.partial_counts(events.filter(F.col("event_id") % 3 == k)) for k in range(3)]
    same(analysis.merged(*parts), found.counts)
    by_day = events.withColumn("day", F.to_date("ts"))
    same(analysis.merged(analysis.partial_counts(by_day, ("day", "host"))), found.counts)


def test_nulls_and_nothing(spark):
    schema = "event_id bigint, ts timestamp_ntz, severity string, user_name string, source_ip string, host string, raw_log string"
    empty = analysis.analyse(spark.createDataFrame([], schema))
    assert empty.findings().collect() == [] and empty.profile().collect() == []
    rows = [(1, None, None, None, None, None, None), (2, dt.datetime(2024, 1, 1, 23), None, None, None, None, "Brute Force"),
            (3, None, "HIGH", None, None, "h", "failed login"), (3, None, "HIGH", None, None, "h", "failed login")]
    events = spark.createDataFrame(rows, schema)
    one = analysis.analyse(events)
    same(scoring.detector_score(one.profile(("host",)), AS_OF, ("host",)),
         scoring.detector_score(detect.severity_profile(events, ("host",)), AS_OF, ("host",)))
    same(scoring.finding_profile(one.findings(), ("host",)), scoring.finding_profile(detect.detect_all(events), ("host",)))


def test_the_table_is_read_back_and_can_be_removed(spark, events):
    one = analysis.analyse(events)
    assert one.findings().count() > 0
    one.remove()
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FILE_NOT_EXIST|does not exist|NotFound"):
        spark.read.parquet(one.stored.path).count()


def scans(df):
    """Scans of the events: only they have the column ``raw_log``."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return sum("raw_log" in line for line in text.splitlines() if "FileScan" in line)


def test_events_are_scanned_once_for_counts_and_once_for_the_highest(spark, tmp_path, sf_dir, monkeypatch):
    """Counting and top-k read the events once each, all else reads the stored counts."""
    path = str(tmp_path / "events")
    view(spark, sf_dir, "log_events").write.parquet(path)
    events = spark.read.parquet(path)
    read = []
    monkeypatch.setattr(analysis, "store", lambda df, name, store=analysis.store: (read.append(scans(df)), store(df, name))[1])
    for module in (q_core, q_scores, q_outputs):
        monkeypatch.setattr(module, "events", lambda s, d: events)
    limits = {"scr_overall": 1, "scr_overall_by_host": 1, "scr_impact": 1, "scr_recommend": 2, "win_first_step": 1, "snk_report_tables": 1,
              "snk_markdown_report": 3, "mit_map": 1, "pb_plan": 1, "scr_asset": 1}
    from trailhound.plans.catalog import QUERIES

    for name, limit in limits.items():
        read.clear()
        df = QUERIES[name](spark, sf_dir)
        assert sum(read) == 1, name
        assert sum(read) + scans(df) == limit, name
