"""Queries: detectors, indicators, windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailhound import fixed_values as V
from trailhound.operators import aggregates as A
from trailhound.operators import detect as D
from trailhound.operators import iocs as I
from trailhound.operators import mitre as M
from trailhound.operators import normalize as N
from trailhound.operators import packets as K
from trailhound.operators import parse as P
from trailhound.operators import playbooks as B
from trailhound.operators import timeline as T
from trailhound.plans.fixtures import table, view
from trailhound.plans.oracle_views import case_map, in_list, word_test
from trailhound.plans.q_core import LE, PK, events, findings, packets
from trailhound.plans.q_parse import WIN_IDS, _windows_ids
from trailhound.plans.registry import query
from trailhound.session import scratch_path
from trailhound.sources import files

FCOLS = "finding_type, list_name, severity, event_id, ts, user_name, source_ip, host, details, metric"


@query("det_high_sev", f"select {FCOLS} from anomaly_findings where starts_with(finding_type, 'high_severity_')", ("anomaly_findings",))
def det_high_sev(spark, d):
    return D.high_severity_anomalies(D.severity_profile(events(spark, d)))


@query("det_keywords", "select finding_type, list_name, severity, event_id, matched, details from keyword_findings", ("keyword_findings",))
def det_keywords(spark, d):
    return D.row_findings(events(spark, d), D.keyword_hits).select(
        "finding_type", "list_name", "severity", "event_id", "matched", "details")


@query("det_keywords_distinct", "select distinct finding_type, event_id from keyword_findings", ("keyword_findings",))
def det_keywords_distinct(spark, d):
    return D.row_findings(events(spark, d), D.keyword_hits, distinct_rows=True).select("finding_type", "event_id")


def _list_query(name, make_hits, list_name, kind=None):
    where = f"list_name = '{list_name}'" + (f" and finding_type = '{kind}'" if kind else "")

    @query(name, f"select finding_type, severity, event_id, ts, user_name, source_ip, host, details from row_findings where {where}",
           ("row_findings",))
    def run(spark, d):
        return D.row_findings(events(spark, d), make_hits).select(
            "finding_type", "severity", "event_id", "ts", "user_name", "source_ip", "host", "details")


_list_query("det_auth_fail", D.auth_fail_hits, "failed_logins")
_list_query("det_login_ok", D.login_ok_hits, "successful_logins")
_list_query("det_process", D.process_hits, "suspicious_processes")
_list_query("det_powershell", D.powershell_hits, "suspicious_powershell")
_list_query("det_cmd_persist", lambda t: D.command_hits(t, "persistence"), "persistence_attempts")
_list_query("det_cmd_lateral", lambda t: D.command_hits(t, "lateral_movement"), "lateral_movement")
_list_query("det_cmd_exfil", lambda t: D.command_hits(t, "exfiltration"), "high_risk_commands", "data_exfiltration")


@query("det_cmd_priv", """
select event_id, host, details from (select event_id, host, substr(raw_log, 1, 200) as details from log_events where regexp_matches(raw_log,
 '(?i)whoami /priv|net localgroup administrators|net group "domain admins"|secedit|auditpol')) x""", LE)
def det_cmd_priv(spark, d):
    return D.row_findings(events(spark, d), lambda t: D.command_hits(t, "privilege_escalation")).select(
        "event_id", "host", "details")


@query("det_auth_fail_report", f"""
select event_id, ts, user_name, source_ip, severity, substr(raw_log, 1, 200) as details from log_events
where {word_test("raw_log", V.AUTH_FAIL_WORDS)} order by ts, event_id limit 100""", LE)
def det_auth_fail_report(spark, d):
    return D.auth_fail_report(events(spark, d)).select("event_id", "ts", "user_name", "source_ip", "severity", "details")


@query("det_brute_force", "select details, metric from anomaly_findings where finding_type = 'brute_force_suspected'", ("anomaly_findings",))
def det_brute_force(spark, d):
    profile = D.severity_profile(events(spark, d))
    return D.brute_force_anomaly(D.group_profile(profile)).select("details", "metric")


@query("det_brute_by_ip", f"""
select source_ip, time_bucket(interval '1 day', ts, timestamp '2024-01-01') as window_start, count(*) as failed_attempts from log_events
where {word_test("raw_log", V.AUTH_FAIL_WORDS)} group by 1, 2 having count(*) > 1""", LE)
def det_brute_by_ip(spark, d):
    return D.brute_force_by_ip(events(spark, d), "1 day", 1)


@query("det_off_hours", "select details, metric from anomaly_findings where finding_type = 'off_hours_activity'", ("anomaly_findings",))
def det_off_hours(spark, d):
    profile = D.severity_profile(events(spark, d))
    return D.off_hours_anomaly(D.group_profile(profile)).select("details", "metric")


@query("det_night", """
select host, count(*) filter (where hour(ts) < 6) as night_events, count(*) as total_events,
 round(count(*) filter (where hour(ts) < 6) / cast(count(*) as double) * 100.0, 6) as percentage,
 count(*) filter (where hour(ts) < 6) > count(*) * 0.3 as is_anomaly from log_events group by host""", LE)
def det_night(spark, d):
    return D.night_activity(events(spark, d), ("host",))


_CATS = {str(i): V.WINDOWS_EVENT_CATEGORIES[n] for n, i in V.WINDOWS_EVENT_IDS}


@query("det_event_id", f"""
select row_id, {case_map("event_id", _CATS, "'other'")} as category
from (select event_id as row_id, split_part('{WIN_IDS}', '|', cast(event_id % 16 as int) + 1) as event_id from events) e""")
def det_event_id(spark, d):
    return D.event_id_categories(_windows_ids(spark, d), "event_id").select("row_id", "category")


@query("det_ioc", """
select event_id, source_ip as matched, substr(raw_log, 1, 200) as details from log_events
where source_ip in (select indicator from ioc_feed)""", ("log_events", "ioc_feed"))
def det_ioc(spark, d):
    return D.ioc_matches(events(spark, d), view(spark, d, "ioc_feed")).select("event_id", "matched", "details")


_URL_HOST = "lower(regexp_extract(url, '^https?://([^/]+)', 1))"


@query("det_ioc_domain", f"""
select page_id as event_id, {_URL_HOST} as matched from pages where {_URL_HOST} like '%.net'""")
def det_ioc_domain(spark, d):
    """Domain matches: page addresses against a feed of the domains under one top-level domain."""
    p = table(spark, d, "pages")
    host = F.lower(F.regexp_extract("url", r"^https?://([^/]+)", 1))
    feed = p.filter(host.endswith(".net")).select(host.alias("indicator"), F.lit("domain").alias("kind"))
    none = F.lit(None)
    rows = p.select(
        F.col("page_id").alias("event_id"), none.cast("timestamp_ntz").alias("ts"), none.cast("string").alias("user_name"),
        none.cast("string").alias("source_ip"), none.cast("string").alias("host"),
        F.concat(F.lit("GET "), host).alias("raw_log"))
    return D.ioc_matches(rows, feed).select("event_id", "matched")


@query("det_susp_port", f"select packet_id, dst_port from packets where dst_port in {in_list(V.SUSPICIOUS_PORTS)}", PK)
def det_susp_port(spark, d):
    return K.suspicious_ports(packets(spark, d)).select("packet_id", "dst_port")


_SCAN = """select 'port_scan' as finding_type, 'HIGH' as severity, src_ip as source_ip,
 'Potential port scan detected from ' || src_ip || ' with ' || count(*) || ' SYN packets' as details, cast(count(*) as double) as metric
from packets where tcp_flags_int & 2 > 0 group by src_ip having count(*) > {}"""


@query("det_port_scan", _SCAN.format(100), PK)
def det_port_scan(spark, d):
    return K.port_scans(packets(spark, d)).drop("list_name")


_FLOOD = """select 'ddos' as finding_type, 'CRITICAL' as severity, cast(null as varchar) as source_ip,
 'High packet rate detected: ' || cast(round(count(*) / (max(ts_s) - min(ts_s))) as bigint) || ' packets/sec' as details,
 round(count(*) / (max(ts_s) - min(ts_s)), 6) as metric from packets having count(*) > 1 and count(*) / (max(ts_s) - min(ts_s)) > {}"""


@query("det_ddos", _FLOOD.format(1), PK)
def det_ddos(spark, d):
    return K.flood(K.traffic_profile(packets(spark, d)), 1).drop("list_name")


@query("det_ddos_seconds", """
select cast(floor(ts_s) as bigint) as second, count(*) as packets from packets group by 1 having count(*) > 5""", PK)
def det_ddos_seconds(spark, d):
    return K.flood_seconds(packets(spark, d), 5)


@query("det_icmp", """
select 'icmp_storm' as finding_type, 'MEDIUM' as severity, cast(null as varchar) as source_ip,
 'Unusual ICMP activity: ' || count(*) filter (where protocol = 'ICMP') || ' packets' as details,
 cast(count(*) filter (where protocol = 'ICMP') as double) as metric
from packets having count(*) filter (where protocol = 'ICMP') > count(*) * 0.05""", PK)
def det_icmp(spark, d):
    return K.icmp_storm(K.traffic_profile(packets(spark, d)), 0.05).drop("list_name")


@query("det_exfil", """
select 'potential_exfiltration' as finding_type, 'HIGH' as severity, cast(null as varchar) as source_ip,
 'Many large packets detected - potential data exfiltration' as details,
 cast(count(*) filter (where length > 1400) as double) as metric
from packets having count(*) filter (where length > 1400) > count(*) * 0.01""", PK)
def det_exfil(spark, d):
    return K.large_packets(K.traffic_profile(packets(spark, d)), 0.01).drop("list_name")


_DNS = """select 'suspicious_dns' as finding_type, 'MEDIUM' as severity, cast(null as varchar) as source_ip,
 'DNS queries to suspicious TLDs detected: ' || array_to_string(list_sort(list(distinct dns_query))[1:5], ', ') as details,
 cast(count(*) as double) as metric
from packets where regexp_matches(dns_query, '\\.(xyz|top|tk|ml|ga|cf)') having count(*) > 0"""


@query("det_dns", _DNS, PK)
def det_dns(spark, d):
    return K.suspicious_dns(packets(spark, d)).drop("list_name")


@query("det_packets", f"""
{_SCAN.format(100)}
union all {_FLOOD.format(1000)}
union all {_DNS}""", PK)
def det_packets(spark, d):
    return K.detect_all(packets(spark, d)).drop("list_name")


_HOURLY = "(select date_trunc('hour', ts) as hour, count(*) as n from log_events group by 1)"


@query("det_spike", f"""
select hour, n from {_HOURLY} h where n > (select avg(n) + 2 * stddev_samp(n) from {_HOURLY} k)""", LE)
def det_spike(spark, d):
    return D.spikes(events(spark, d))


@query("det_patterns", "select pattern, n, significance from suspicious_patterns", ("suspicious_patterns",))
def det_patterns(spark, d):
    return D.suspicious_patterns(D.pattern_counts(events(spark, d)))


@query("det_all", f"select {FCOLS} from findings", ("findings",))
def det_all(spark, d):
    return findings(spark, d)


@query("pipe_findings", f"select {FCOLS} from findings", ("findings",))
def pipe_findings(spark, d):
    """From text files to findings: lines are read, parsed, made canonical and searched by all detectors."""
    e = events(spark, d)
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    line = F.to_json(F.struct("event_id", stamp.alias("timestamp"), "severity", "source", "source_ip", "user_name", "host",
                              F.col("raw_log").alias("message")))
    path = scratch_path(spark, "lines")
    e.select(line.alias("value")).write.text(path)
    parsed = P.parse_any(files.read_text(spark, path, numbered=False), "raw_log")
    rows = parsed.drop("raw_log").withColumn("event_id", parsed["extras"]["event_id"])
    return D.detect_all(N.canonical(rows)).select(*D.FINDING_COLUMNS)


@query("det_all_feed", """
select list_name, count(*) as n from (select list_name from findings union all
 select 'ioc_matches' from log_events where source_ip in (select indicator from ioc_feed)) x group by 1""", ("findings", "ioc_feed"))
def det_all_feed(spark, d):
    return A.value_counts(D.detect_all(events(spark, d), view(spark, d, "ioc_feed")), "list_name")


# --- indicators ---------------------------------------------------------------------------------

@query("ioc_ip", "select 'ip' as kind, value, n_events, first_ts, last_ts from ip_iocs", ("ip_iocs",))
def ioc_ip(spark, d):
    return I.extract(events(spark, d), ["ip"])


@query("ioc_ip_documents", r"""
select value, count(distinct doc_id) as n_events from (
 select doc_id, unnest(regexp_extract_all(text, '\b(?:\d{1,3}\.){3}\d{1,3}\b')) as value from documents) x
where not regexp_matches(value, '^(10\.|192\.168\.|172\.|127\.|0\.|169\.254\.|255\.)') group by value""")
def ioc_ip_documents(spark, d):
    return I.extract(table(spark, d, "documents"), ["ip"], "text", None).select("value", "n_events")


def _ioc_query(name, kind):
    @query(name, f"select value, n_events, first_ts, last_ts from {kind}_iocs", (f"{kind}_iocs",))
    def run(spark, d):
        return I.extract(events(spark, d), [kind]).drop("kind")


_ioc_query("ioc_user", "user")
_ioc_query("ioc_host", "host")
_ioc_query("ioc_service", "service")


@query("ioc_command", r"""
select substr(value, 1, 200) as value, count(distinct event_id) as n_events, min(ts) as first_ts, max(ts) as last_ts
from (select event_id, ts, unnest(flatten([
 regexp_extract_all(raw_log, '(?i)cmd(?:\.exe)?\s+/c\s+(\S+)', 1), regexp_extract_all(raw_log, '(?i)powershell(?:\.exe)?\s+(.+?)(?:\s|$)', 1),
 regexp_extract_all(raw_log, '(?i)wmic\s+(.+)', 1), regexp_extract_all(raw_log, '(?i)net\s+(?:user|localgroup)\s+(.+)', 1),
 regexp_extract_all(raw_log, '(?i)command[=:]\s*([^|&\s]+)', 1)])) as value from log_events) x where length(value) > 5 group by 1""", LE)
def ioc_command(spark, d):
    return I.extract(events(spark, d), ["command"]).drop("kind")


@query("ioc_domain", r"""
select value, count(distinct id) as n_events from (
 select id, lower(unnest(regexp_extract_all(t, '\b(?:[a-zA-Z0-9-]+\.)+[a-zA-Z]{2,}\b'))) as value from (
  select 'p' || page_id as id, url as t from pages union all select 'd' || doc_id, text from documents) s) x group by 1""")
def ioc_domain(spark, d):
    texts = table(spark, d, "pages").select(F.col("url").alias("t")).unionByName(
        table(spark, d, "documents").select(F.col("text").alias("t")))
    return I.extract(texts, ["domain"], "t", None).select("value", "n_events")


ALL_IOCS = ("ip_iocs", "user_iocs", "host_iocs", "service_iocs")


@query("ioc_summary", " union all ".join(
    f"select '{k}' as kind, count(*) as n_values from {k}_iocs" for k in ("ip", "user", "host", "service")), ALL_IOCS)
def ioc_summary(spark, d):
    return I.kind_counts(I.extract(events(spark, d), ["ip", "user", "host", "service"]))


_SUSPECT = f"({word_test('raw_log', V.ENTITY_WORDS)} or severity in {in_list(V.ENTITY_SEVERITIES)})"


@query("ent_suspicious", f"""
select 'ip' as kind, source_ip as value, min(ts) as first_ts from log_events where {_SUSPECT} group by 2
union all select 'user', user_name, min(ts) from log_events where {_SUSPECT} group by 2""", LE)
def ent_suspicious(spark, d):
    return I.suspicious_entities(events(spark, d))


@query("ent_suspicious_all", f"""
select kind, value, min(first_ts) as first_ts from (
 select 'ip' as kind, source_ip as value, min(ts) as first_ts from log_events where {_SUSPECT} group by 2
 union all select 'user', user_name, min(ts) from log_events where {_SUSPECT} group by 2
 union all select 'ip', value, first_ts from ip_iocs union all select 'user', value, first_ts from user_iocs) x group by 1, 2""",
       ("log_events", "ip_iocs", "user_iocs"))
def ent_suspicious_all(spark, d):
    return I.suspicious_entities(events(spark, d), observed_only=False)


def _dash(kind, column):
    return f"""select * from (select '{kind}' as kind, {column} as value, count(*) as n from log_events where {column} in (
 select {column} from log_events where severity in {in_list(V.DASHBOARD_HIGH_SEVERITIES)}) group by {column} order by n desc, value limit 20) {kind}s"""


@query("ent_dash", f"{_dash('ip', 'source_ip')} union all {_dash('user', 'user_name')}", LE)
def ent_dash(spark, d):
    return I.dashboard_entities(events(spark, d))


@query("ent_assets", """
select 'host' as kind, value, n_events, cast(null as varchar) as status from host_iocs
union all select 'service', value, n_events, case when value in ('DB-PRIMARY', 'SECURITY') then 'IMPACTED' else 'MONITORING' end from service_iocs
union all select 'ip', value, n_events, null from ip_iocs
union all select 'user', value, n_events, null from user_iocs""", ALL_IOCS)
def ent_assets(spark, d):
    return I.affected_assets(events(spark, d)).select("kind", "value", "n_events", "status")
