"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Each figure is the median of the warm runs of a query whose rows are all computed (no-op sink). ``scaling`` repeats
detection and parsing on 1, 4 and 16 copies of the log table, where time should grow no faster than the rows.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import functions as F  # noqa: E402

from trailhound.operators import detect, parse  # noqa: E402
from trailhound.plans.catalog import QUERIES  # noqa: E402
from trailhound.plans.fixtures import view  # noqa: E402
from trailhound.session import build_session, scratch_path  # noqa: E402

HEADLINE = [
    "prs_kv8", "prs_cascade", "prs_any", "det_all", "det_patterns", "det_port_scan", "agg_connections", "pkt_susp_flags",
    "ioc_ip", "ioc_user", "ioc_ip_documents", "win_phase", "win_phase_global", "jn_sequence", "jn_ioc_semi",
    "agg_terms", "scr_detector", "scr_overall_by_host", "scr_asset", "mit_map", "pb_plan",
]
RUNS = int(os.environ.get("BENCH_RUNS", "2"))


def seconds(action) -> float:
    start = time.perf_counter()
    action()
    return time.perf_counter() - start


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "4g"),
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-")})
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        drain(QUERIES[name](spark, sf_dir))
        times[name] = round(statistics.median(
            seconds(lambda: drain(QUERIES[name](spark, sf_dir))) for _ in range(RUNS)), 3)
    scaling = {}
    events = view(spark, sf_dir, "log_events")
    for copies in (1, 4, 16):
        path = scratch_path(spark, "copies")
        events.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))).drop("_copy").repartition(
            4 * int(cpus)).write.parquet(path)
        rows = spark.read.parquet(path)
        for label, run in (("detect", detect.detect_all), ("parse", parse.parse_kv8)):
            drain(run(rows))
            scaling[f"{label}_x{copies}"] = round(seconds(lambda: drain(run(rows))), 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "scaling": scaling, "sf": Path(sf_dir).name.removeprefix("sf"), "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
