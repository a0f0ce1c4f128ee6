"""Queries: sinks, report tables, streaming. Sinks write to the shared folder and the result is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailhound import fixed_values as V
from trailhound.functions.text import holds_any
from trailhound.operators import aggregates as A
from trailhound.operators import analysis as Y
from trailhound.operators import detect as D
from trailhound.operators import iocs as I
from trailhound.operators import mitre as M
from trailhound.operators import playbooks as B
from trailhound.operators import reports as R
from trailhound.operators import scoring as S
from trailhound.operators import timeline as T
from trailhound.plans.fixtures import VIEW_SQL, table, view
from trailhound.plans.oracle_views import banded, word_test
from trailhound.plans.q_core import LE, analysis, events, findings
from trailhound.plans.q_scores import AS_OF, _MARK, _detector_sql, _overall_sql, mapped
from trailhound.plans.registry import query
from trailhound.session import scratch_path
from trailhound.streaming import detectors as ST

FIELDS = ["finding_type", "list_name", "severity", "event_id", "host", "details"]
FIELD_SQL = ", ".join(FIELDS)
SCHEMA = "finding_type string, list_name string, severity string, event_id bigint, host string, details string"


@query("snk_json", f"select {FIELD_SQL} from findings", ("findings",))
def snk_json(spark, d):
    path = R.write(findings(spark, d).select(*FIELDS), scratch_path(spark, "findings"), "json")
    return spark.read.schema(SCHEMA).json(path)


@query("snk_csv", f"select {FIELD_SQL} from findings", ("findings",))
def snk_csv(spark, d):
    path = R.write(findings(spark, d).select(*FIELDS), scratch_path(spark, "findings"), "csv")
    return spark.read.schema(SCHEMA).option("header", True).option("escape", '"').csv(path)


@query("snk_parquet", "select event_id, ts, severity, raw_log, cast(ts as date) as day from log_events", LE)
def snk_parquet(spark, d):
    rows = events(spark, d).select("event_id", "ts", "severity", "raw_log", F.to_date("ts").alias("day"))
    return spark.read.parquet(R.write(rows, scratch_path(spark, "events"), "parquet", ["day"]))


@query("snk_days", """
select event_id, ts, severity, cast(ts as date) as day from log_events where ts >= timestamp '2024-01-10 06:00:00' and ts < timestamp '2024-01-12 18:00:00'""", LE)
def snk_days(spark, d):
    """All days written, two of them again, and a span read back: one copy of each row, and other days untouched."""
    rows = events(spark, d).select("event_id", "ts", "severity")
    path = R.write_days(rows, scratch_path(spark, "days"))
    R.write_days(rows.filter(F.to_date("ts").isin(F.lit("2024-01-10").cast("date"), F.lit("2024-01-20").cast("date"))), path)
    at = lambda text: F.lit(text).cast("timestamp_ntz")
    return R.read_between(spark, path, at("2024-01-10 06:00:00"), at("2024-01-12 18:00:00"))


def _summary(found):
    return R.executive_summary(S.detector_score(found.profile(), AS_OF), found.findings())


@query("snk_report_tables", f"""
select s.risk_score, {banded("s.risk_score", V.DASHBOARD_BANDS)} as risk_level, s.total_events,
 count(*) filter (where severity = 'CRITICAL') as critical_count, count(*) filter (where severity = 'HIGH') as high_count,
 count(*) filter (where severity not in ('CRITICAL', 'HIGH') and (list_name = 'anomalies' or severity = 'MEDIUM')) as medium_count,
 count(*) filter (where severity not in ('CRITICAL', 'HIGH', 'MEDIUM') and list_name <> 'anomalies') as low_count, count(*) as total_findings
from findings cross join ({_detector_sql("")}) s group by 1, 2, 3""", ("findings",))
def snk_report_tables(spark, d):
    return _summary(analysis(spark, d))


@query("rpt_technical", "select list_name, count(*) as n from findings where list_name not in ('successful_logins', 'suspicious_processes') group by 1", ("findings",))
def rpt_technical(spark, d):
    return R.technical_counts(analysis(spark, d).findings())


@query("rpt_indicators", "select value, n_events from ip_iocs order by n_events desc, value limit 10", ("ip_iocs",))
def rpt_indicators(spark, d):
    return R.indicator_table(I.extract(events(spark, d), ["ip"]))


@query("snk_markdown", """
select string_agg(line, chr(10) order by part, pos) as markdown from (
 select 0 as part, 0 as pos, '## Technical Findings' as line
 union all select 1, row_number() over (order by list_name), '| ' || list_name || ' | ' || n || ' |' from (
  select list_name, count(*) as n from findings group by 1) t) x""", ("findings",))
def snk_markdown(spark, d):
    counts = A.value_counts(analysis(spark, d).findings(), "list_name")
    rows = counts.agg(F.array_sort(F.collect_list(F.concat(
        F.lit("| "), "list_name", F.lit(" | "), F.col("n").cast("string"), F.lit(" |")))).alias("_rows"))
    text = rows.select(F.concat_ws("\n", F.lit("## Technical Findings"), "_rows").alias("markdown"))
    path = R.write(text, scratch_path(spark, "report"), "text")
    return spark.read.text(path, wholetext=True).select(F.rtrim("value", F.lit("\n")).alias("markdown"))


def _report_advice_sql(n):
    """The first pieces of advice: by score, by the lists among the ten highest findings, and always."""
    rows = " union all ".join(
        f"select {k} as k, unnest(range({len(texts)})) as i, unnest({texts}) as t, '{need}' as need"
        for k, (need, texts) in enumerate(V.RECOMMENDATION_RULES.items()))
    return f"""
select row_number() over (order by k, i) as rank, t from ({rows}) r
where need = 'always' or (need = 'score' and (select overall_risk_score from ({_overall_sql("", False)}) o) >= 70)
 or need in (select list_name from scored_findings order by risk_score desc, ts, event_id, list_name, finding_type, details limit 10)
order by k, i limit {n}"""


@query("snk_markdown_report", f"""
select string_agg(line, chr(10) order by part, pos) as markdown from (
 select 0 as part, 0 as pos, '# Security Incident Report' || chr(10, 10) || '## Executive Summary' as line
 union all select 1, 0, '- **Risk Score:** ' || risk_score || '/100' || chr(10) || '- **Risk Level:** ' || {banded("risk_score", V.DASHBOARD_BANDS)}
  || chr(10) || '- **Total Events Analyzed:** ' || total_events from ({_detector_sql("")}) s
 union all select 2, 0, chr(10) || '## Technical Findings' || chr(10, 10) || '| Finding Type | Count |' || chr(10) || '|---|---|'
 union all select 3, row_number() over (order by list_name), '| ' || list_transform(string_split(list_name, '_'),
   lambda w: upper(w[1]) || w[2:]).array_to_string(' ') || ' | ' || n || ' |' from (
  select list_name, count(*) as n from findings where list_name not in ('successful_logins', 'suspicious_processes') group by 1) t
 union all select 4, 0, chr(10) || '## Indicators of Compromise'
 union all select 5, row_number() over (order by n_events desc, value), '- `' || value || '`' from (
  select value, n_events from ip_iocs order by n_events desc, value limit 10) i
 union all select 6, 0, chr(10) || '## Recommendations'
 union all select 7, rank, rank || '. ' || t from ({_report_advice_sql(5)}) a) x""".replace("chr(10, 10)", "chr(10) || chr(10)"),
       ("findings", "scored_findings", "row_findings", "ip_iocs"))
def snk_markdown_report(spark, d):
    """Reads the events three times: for all counts, for the highest findings and for the addresses."""
    found = analysis(spark, d)
    top = Y.top_findings(events(spark, d), 10).select("list_name", F.lit(1).alias("rank"))
    advice = S.recommendations(S.overall_risk(found.findings(), AS_OF), top, 5)
    return R.markdown_report(
        _summary(found), R.technical_counts(found.findings()), R.indicator_table(I.extract(events(spark, d), ["ip"])), advice)


@query("snk_mitre", "select mapped_as, '| ' || technique_id || ' | ' || technique_name || ' | ' || tactic || ' | ' || confidence || ' |' as line from mapped", ("mapped",))
def snk_mitre(spark, d):
    path = R.write(R.technique_markdown(mapped(spark, d)), scratch_path(spark, "techniques"), "csv")
    return spark.read.option("header", True).csv(path)


@query("snk_playbooks", """
select p.playbook, starts_with('# ' || p.title, '# ') as titled, (select count(*) from playbook_steps s where s.playbook = p.playbook) as n_steps
from playbooks p where p.playbook in (select playbook from finding_playbooks)""", ("playbooks", "playbook_steps", "finding_playbooks"))
def snk_playbooks(spark, d):
    books = B.all_playbooks(analysis(spark, d).findings()).filter("n_findings > 0")
    return B.markdown(books).select(
        "playbook", F.col("markdown").startswith("# ").alias("titled"),
        (F.size(F.split("markdown", "### Step ")) - 1).cast("bigint").alias("n_steps"))


@query("snk_all", "select f as format, count(*) as n from findings cross join (values ('csv'), ('json'), ('parquet')) v(f) group by 1", ("findings",))
def snk_all(spark, d):
    paths = R.write_all(findings(spark, d).select(*FIELDS), scratch_path(spark, "export"))
    parts = [
        spark.read.json(paths["json"]), spark.read.option("header", True).option("escape", '"').csv(paths["csv"]),
        spark.read.parquet(paths["parquet"])]
    counted = [p.select(F.lit(n).alias("format")) for n, p in zip(("json", "csv", "parquet"), parts)]
    return A.value_counts(counted[0].unionByName(counted[1]).unionByName(counted[2]), "format")


# --- streaming: each query drives the stream through all the given data and reads the result ------

def _stream(spark, d):
    """The events table as a stream, projected to the log view."""
    raw = ST.read_events(spark, d, table(spark, d, "events").schema, "events.parquet")
    text = VIEW_SQL["log_events"].replace("from events", "from {events}")
    return spark.sql(text, events=raw)


def _run(spark, stream):
    return ST.run_to_table(stream, spark, scratch_path(spark, "stream"))


def _run_to_end(spark, stream, transform):
    return ST.run_to_end(stream, transform, scratch_path(spark, "stream"))


def _ntz(df, *columns):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


@query("st_ingest", """
select event_id, severity, source, user_name, source_ip, status_code, event_type from log_events""", LE)
def st_ingest(spark, d):
    parsed = ST.ingest(_stream(spark, d).select("event_id", "line"))
    return _run(spark, parsed.select(
        "event_id", "severity", "source", "user_name", "source_ip", "status_code", "event_type"))


@query("st_brute", f"""
select source_ip, window_start, count(*) as failed_attempts from (
 select source_ip, unnest(range(time_bucket(interval '12 hours', ts, timestamp '2024-01-01') - interval '12 hours',
  time_bucket(interval '12 hours', ts, timestamp '2024-01-01') + interval '1 hour', interval '12 hours')) as window_start
 from log_events where {word_test("raw_log", V.AUTH_FAIL_WORDS)}) w
group by 1, 2 having count(*) > 1""", LE)
def st_brute(spark, d):
    found = _run_to_end(spark, _stream(spark, d), lambda s: ST.brute_force(s, "24 hours", "12 hours", 1))
    return _ntz(found, "window_start").select("source_ip", "window_start", "failed_attempts")


@query("st_hourly", "select date_trunc('hour', ts) as hour, count(*) as n from log_events group by 1", LE)
def st_hourly(spark, d):
    return _ntz(_run_to_end(spark, _stream(spark, d), ST.hourly), "hour")


@query("st_session", """
select user_name, min(ts) as session_start, max(ts) + interval '30 minutes' as session_end, count(*) as n_events from (
 select user_name, ts, sum(fresh) over (partition by user_name order by ts, event_id) as k from (
  select user_name, ts, event_id, case when lag(ts) over (partition by user_name order by ts, event_id) >= ts - interval '30 minutes' then 0 else 1 end as fresh
  from log_events) a) b
group by user_name, k""", LE)
def st_session(spark, d):
    return _ntz(_run_to_end(spark, _stream(spark, d), ST.sessions), "session_start", "session_end")


@query("st_phases", f"""
select event_id, ts, user_name, coalesce(last_value(mark ignore nulls) over (
 partition by user_name order by ts, event_id rows between unbounded preceding and current row), 'recon') as phase
from (select event_id, ts, user_name, {_MARK} as mark from log_events where ts is not null) m""", LE)
def st_phases(spark, d):
    return _ntz(_run_to_end(spark, _stream(spark, d), ST.phases), "ts")


@query("st_dedupe", f"""
select host, event_type from log_events where {word_test("raw_log", V.AUTH_FAIL_WORDS)} group by 1, 2""", LE)
def st_dedupe(spark, d):
    """All of the table arrives in one batch here, so each alert key is kept once."""
    alerts = _stream(spark, d).filter(holds_any(F.col("raw_log"), V.AUTH_FAIL_WORDS))
    return _run(spark, ST.first_alerts(alerts.select("ts", "host", "event_type"), ["host", "event_type"])).select(
        "host", "event_type")


@query("st_ioc", "select event_id, source_ip from log_events where source_ip in (select indicator from ioc_feed)", ("log_events", "ioc_feed"))
def st_ioc(spark, d):
    """The feed is read again for every batch of the stream."""
    stream = _stream(spark, d).select("event_id", "source_ip")
    found = ST.ioc_matches_to_table(stream, lambda: view(spark, d, "ioc_feed"), scratch_path(spark, "stream"))
    return found.select("event_id", "source_ip")
