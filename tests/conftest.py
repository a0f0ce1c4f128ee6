import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tools"))

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from trailhound.session import build_session

    session = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "4g", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


INCIDENT = """2026-06-05T08:00:01.125Z INFO AUTH-SVC Service startup complete
2026-06-05T08:15:33.230Z HIGH SECURITY Excessive login failures user=admin source_ip=185.44.10.7 failures=25
2026-06-05T08:15:34.012Z HIGH SECURITY Account lockout triggered user=admin duration=30m
2026-06-05T08:40:55.920Z CRITICAL DB-PRIMARY Replication lag exceeded threshold lag_seconds=620
2026-06-05T08:41:10.102Z CRITICAL DB-PRIMARY Primary database unavailable node=db-prod-01
2026-06-05T08:43:41.788Z HIGH SECURITY Suspicious privilege escalation detected user=svc-reports
2026-06-05T08:43:42.101Z CRITICAL SECURITY Unauthorized admin role assignment user=svc-reports target_role=SUPER_ADMIN
2026-06-05T09:01:22.119Z EMERGENCY SECURITY Potential ransomware activity detected host=finance-server-02
2026-06-05T09:01:24.447Z EMERGENCY SECURITY File encryption spike detected affected_files=18423"""


@pytest.fixture(scope="session")
def incident(spark):
    """The nine-line sample as events, with the fields the text holds."""
    from pyspark.sql import functions as F

    from trailhound.functions.times import parse_time
    from trailhound.operators.normalize import backfill
    from trailhound.sources.files import split_incident

    lines = spark.createDataFrame(
        [(i, line) for i, line in enumerate(INCIDENT.split("\n"))], "event_id bigint, value string")
    parts = split_incident(lines.select("value"))
    numbered = parts.join(
        lines.select("event_id", F.regexp_extract("value", r"^(\S+)", 1).alias("timestamp")), "timestamp")
    none = F.lit(None).cast("string")
    filled = backfill(numbered.withColumns({"source_ip": none, "user_name": none}))
    return filled.select(
        "event_id", parse_time(F.col("timestamp")).alias("ts"), "severity", "source", "user_name", "source_ip",
        F.nullif(F.regexp_extract("raw_log", r"host=(\S+)", 1), F.lit("")).alias("host"), "raw_log").cache()
