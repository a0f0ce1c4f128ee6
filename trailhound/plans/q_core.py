"""Queries: filters, joins, aggregations, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailhound import fixed_values as V
from trailhound.operators import aggregates as A
from trailhound.operators import analysis as Y
from trailhound.operators import chains as C
from trailhound.operators import detect as D
from trailhound.operators import filters as L
from trailhound.operators import iocs as I
from trailhound.operators import joins as J
from trailhound.operators import mitre as M
from trailhound.operators import packets as K
from trailhound.operators import playbooks as B
from trailhound.functions.text import holds_any
from trailhound.operators import timeline as T
from trailhound.plans.fixtures import table, view
from trailhound.plans.oracle_views import case_map, in_list, quoted, values, word_test
from trailhound.plans.registry import query

LE = ("log_events",)
SHOWN = ["event_id", "ts", "severity", "source_ip", "user_name"]
COLS = ", ".join(SHOWN)


def events(spark, d):
    return view(spark, d, "log_events")


def findings(spark, d):
    return D.detect_all(events(spark, d))


def analysis(spark, d):
    """The events counted once: what scores, mappings, plans and reports start from."""
    return Y.analyse(events(spark, d))


# --- filters ------------------------------------------------------------------------------------

@query("flt_high", f"select {COLS} from log_events where severity in {in_list(V.QUESTION_HIGH_SEVERITIES)}", LE)
def flt_high(spark, d):
    return L.high_severity(events(spark, d)).select(*SHOWN)


@query("flt_error", f"select {COLS} from log_events where severity in {in_list(V.QUESTION_ERROR_SEVERITIES)}", LE)
def flt_error(spark, d):
    return L.errors(events(spark, d)).select(*SHOWN)


@query("flt_error_text", """
select event_id, ts, 'INFO' as severity, source_ip, user_name from log_events
where regexp_matches(raw_log, '(?i)error|fail|exception')""", LE)
def flt_error_text(spark, d):
    """The fallback: an input without any error severity is searched by text."""
    quiet = events(spark, d).withColumn("severity", F.lit("INFO"))
    return L.errors(quiet).select(*SHOWN)


@query("flt_warn", f"select {COLS} from log_events where severity in ('WARN', 'WARNING')", LE)
def flt_warn(spark, d):
    return L.warnings(events(spark, d)).select(*SHOWN)


@query("flt_ip", f"select {COLS} from log_events where contains(source_ip, '192.168.2.')", LE)
def flt_ip(spark, d):
    return L.by_ip(events(spark, d), "192.168.2.").select(*SHOWN)


@query("flt_user", f"select {COLS} from log_events where user_name ilike '%user1%'", LE)
def flt_user(spark, d):
    return L.by_user(events(spark, d), "User1").select(*SHOWN)


@query("flt_head", f"select {COLS} from log_events order by ts, event_id limit 50", LE)
def flt_head(spark, d):
    return L.first_events(events(spark, d).select(*SHOWN))


@query("flt_dash_high", f"""
select event_id, ts, severity, source, source_ip, user_name from log_events
where severity in {in_list(V.DASHBOARD_HIGH_SEVERITIES)} order by ts, event_id limit 10""", LE)
def flt_dash_high(spark, d):
    return L.dashboard_high(events(spark, d))


@query("flt_insight", f"""
select count(*) as n_events, count(*) filter (where severity in {in_list(V.QUESTION_HIGH_SEVERITIES)}) as n_high,
 bool_or(regexp_matches(raw_log, '(?i)error|fail')) as has_errors from log_events""", LE)
def flt_insight(spark, d):
    return L.insight(events(spark, d))


_QUESTIONS = """
select 'c' || conv_id || '-' || turn as question_id, text from conversations where role = 'user'
union all select 'e' || event_id, event_type || ' for user: ' || user_name || ' at ' || source_ip from log_events where event_id % 3 = 0
union all select 'm' || event_id, event_type from log_events where event_id % 3 <> 0"""


def questions(spark, d):
    turns = table(spark, d, "conversations").filter("role = 'user'").select(
        F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("question_id"), "text")
    e = events(spark, d)
    asked = e.select(
        F.concat(F.when(F.col("event_id") % 3 == 0, "e").otherwise("m"), "event_id").alias("question_id"),
        F.when(F.col("event_id") % 3 == 0, F.concat(
            "event_type", F.lit(" for user: "), "user_name", F.lit(" at "), "source_ip"))
        .otherwise(F.col("event_type")).alias("text"))
    return turns.unionByName(asked)


def _chain_sql(rules, default):
    arms = []
    for name, words in rules:
        test = (r"regexp_matches(text, '\b(?:\d{1,3}\.){3}\d{1,3}\b')" if words is None else word_test("text", words))
        arms.append(f"when {test} then {quoted(name)}")
    return f"(case {' '.join(arms)} else {quoted(default)} end)"


@query("txt_intent_query", rf"""
select question_id, {_chain_sql(V.QUESTION_RULES, "default")} as intent,
 nullif(regexp_extract(text, '\b(?:\d{{1,3}}\.){{3}}\d{{1,3}}\b'), '') as asked_ip,
 nullif(regexp_extract(lower(text), 'user[:\s]+(\S+)', 1), '') as asked_user
from ({_QUESTIONS}) q""", LE)
def txt_intent_query(spark, d):
    return L.tag_question(questions(spark, d)).drop("text")


@query("txt_intent_agent", f"""
select question_id, {_chain_sql(V.AGENT_RULES, "summary")} as investigation from ({_QUESTIONS}) q""", LE)
def txt_intent_agent(spark, d):
    return L.tag_investigation(questions(spark, d)).drop("text")


# --- joins --------------------------------------------------------------------------------------

@query("jn_dim", f"""
select event_id, severity, cast({case_map("severity", V.SEVERITY_WEIGHTS, 20)} as bigint) as weight from log_events""", LE)
def jn_dim(spark, d):
    return J.severity_weights(events(spark, d).select("event_id", "severity"))


@query("jn_ioc_semi", f"select {COLS} from log_events where source_ip in (select indicator from ioc_feed where kind = 'ip')",
       ("log_events", "ioc_feed"))
def jn_ioc_semi(spark, d):
    return J.in_feed(events(spark, d).select(*SHOWN), view(spark, d, "ioc_feed"))


@query("jn_isin_counts", f"""
select source_ip as value, count(*) as n from log_events
where source_ip in (select source_ip from log_events where severity in {in_list(V.DASHBOARD_HIGH_SEVERITIES)}) group by source_ip""", LE)
def jn_isin_counts(spark, d):
    return I.counts_of_flagged(events(spark, d), "source_ip", F.col("severity").isin(V.DASHBOARD_HIGH_SEVERITIES))


@query("jn_substr_map", "select finding_type, playbook, cast(sum(n_findings) as bigint) as n_findings from finding_playbooks group by 1, 2",
       ("finding_playbooks",))
def jn_substr_map(spark, d):
    return findings(spark, d).groupBy("finding_type").agg(F.count(F.lit(1)).alias("n_findings")).withColumn(
        "playbook", B.playbook_key(F.col("finding_type")))


@query("jn_tid_contains", """
select m.technique_id, (select p.playbook from playbooks p where contains(p.mitre_technique, m.technique_id)
 order by p.playbook_rank limit 1) as playbook from (select distinct technique_id from mapped) m""", ("mapped", "playbooks"))
def jn_tid_contains(spark, d):
    return B.by_technique(M.map_findings(analysis(spark, d).findings()))


_STEPS = values([(i, *s) for i, s in enumerate(V.COVERAGE_STEPS, 1)], "step, tactic, technique_id, technique_name")
_FOUND = """select 'T1068' as t from suspicious_patterns where pattern = 'privilege_escalation'
 union all select 'T1547' from suspicious_patterns where pattern = 'privilege_escalation'
 union all select 'T1499' from suspicious_patterns where pattern = 'database_availability'
 union all select 'T1486' from suspicious_patterns where pattern = 'ransomware_indicators'"""


@query("jn_coverage", f"""
select cast(step as bigint) as step, tactic, technique_id, technique_name, technique_id in ({_FOUND}) as detected
from ({_STEPS}) s""", ("suspicious_patterns",))
def jn_coverage(spark, d):
    return C.coverage(D.pattern_counts(events(spark, d)))


@query("set_gap", f"""
select cast(step as bigint) as step, tactic, technique_id, technique_name from ({_STEPS}) s
where technique_id not in ({_FOUND})""", ("suspicious_patterns",))
def set_gap(spark, d):
    return C.coverage_gaps(D.pattern_counts(events(spark, d)))


@query("jn_before_after", """
select b.list_name, b.n as n_before, coalesce(a.n, 0) as n_after
from (select list_name, count(*) as n from row_findings where ts < timestamp '2024-01-16' group by 1) b
left join (select list_name, count(*) as n from row_findings where ts >= timestamp '2024-01-16' group by 1) a using (list_name)""",
       ("row_findings",))
def jn_before_after(spark, d):
    return A.before_after(findings(spark, d), F.lit("2024-01-16 00:00:00").cast("timestamp_ntz"))


@query("jn_asset", f"""
select asset_name, asset_type, cast({case_map("asset_type", V.ASSET_CRITICALITY, 40)} as bigint) as criticality,
 (select count(*) from findings f where f.host = a.asset_name) as n_findings from assets a""", ("findings", "assets"))
def jn_asset(spark, d):
    return J.asset_findings(findings(spark, d), view(spark, d, "assets"))


@query("jn_correlate", """
select 'authentication_failure_to_privilege_escalation' as correlation from pattern_counts
where authentication_failure_cluster > 5 and privilege_escalation > 0
union all select 'privilege_escalation_to_ransomware' from pattern_counts
where privilege_escalation > 0 and ransomware_indicators > 0""", ("pattern_counts",))
def jn_correlate(spark, d):
    return C.correlations(D.pattern_counts(events(spark, d)))


@query("jn_correlate_by_host", """
select host, 'authentication_failure_to_privilege_escalation' as correlation from pattern_counts_by_host
where authentication_failure_cluster > 5 and privilege_escalation > 0
union all select host, 'privilege_escalation_to_ransomware' from pattern_counts_by_host
where privilege_escalation > 0 and ransomware_indicators > 0""", ("pattern_counts_by_host",))
def jn_correlate_by_host(spark, d):
    return C.correlations(D.pattern_counts(events(spark, d), ("host",)), ("host",))


_CLUSTERS = {name: words for name, words, _ in V.PATTERN_CLUSTERS}


def _sequence_sql(first, then, hours):
    return f"""
select host, event_id, ts, first_event_id, first_ts from (
 select b.host, b.event_id, b.ts, a.event_id as first_event_id, a.ts as first_ts,
  row_number() over (partition by b.event_id order by a.ts desc, a.event_id desc) as k
 from log_events b join log_events a on a.host = b.host and (a.ts < b.ts or (a.ts = b.ts and a.event_id < b.event_id))
 where {word_test("b.raw_log", _CLUSTERS[then])} and {word_test("a.raw_log", _CLUSTERS[first])}) p
where k = 1 and date_diff('microsecond', first_ts, ts) <= {hours} * 3600000000"""


@query("jn_sequence", _sequence_sql("authentication_failure_cluster", "privilege_escalation", 12), LE)
def jn_sequence(spark, d):
    text = F.col("raw_log")
    return T.sequences(
        events(spark, d), holds_any(text, _CLUSTERS["authentication_failure_cluster"]),
        holds_any(text, _CLUSTERS["privilege_escalation"]), ("host",), 12)


@query("jn_sequence_ransomware", _sequence_sql("privilege_escalation", "ransomware_indicators", 6), LE)
def jn_sequence_ransomware(spark, d):
    text = F.col("raw_log")
    return T.sequences(
        events(spark, d), holds_any(text, _CLUSTERS["privilege_escalation"]),
        holds_any(text, _CLUSTERS["ransomware_indicators"]), ("host",), 6)


# --- aggregations -------------------------------------------------------------------------------

def _count_query(name, column):
    @query(name, f"select {column}, count(*) as n from log_events group by {column}", LE)
    def run(spark, d):
        return A.ranked_counts(events(spark, d), column)


for _name, _column in [("agg_severity", "severity"), ("agg_user", "user_name"), ("agg_source", "source"),
                       ("agg_status", "status_code")]:
    _count_query(_name, _column)

PK = ("packets",)


def packets(spark, d):
    return view(spark, d, "packets")


@query("agg_protocol", "select protocol, count(*) as packets from packets group by protocol", PK)
def agg_protocol(spark, d):
    return K.protocol_counts(packets(spark, d))


@query("agg_connections", "select src_ip, dst_ip, count(*) as packet_count from packets group by 1, 2", PK)
def agg_connections(spark, d):
    return K.connections(packets(spark, d))


@query("agg_talkers", """
select * from (select 'sent' as direction, src_ip as ip_address, count(*) as packets from packets group by src_ip order by 3 desc, 2 limit 10) s
union all
select * from (select 'received', dst_ip, count(*) from packets group by dst_ip order by 3 desc, 2 limit 10) r""", PK)
def agg_talkers(spark, d):
    return K.top_talkers(packets(spark, d))


@query("agg_pcap_summary", """
select count(*) as total_packets, count(distinct src_ip) as unique_src_ips, count(distinct dst_ip) as unique_dst_ips,
 count(distinct protocol) as n_protocols, min(ts_s) as first_s, max(ts_s) as last_s from packets""", PK)
def agg_pcap_summary(spark, d):
    return K.summary(packets(spark, d))


@query("agg_top_connections", """
select src_ip, dst_ip, count(*) as packet_count from packets group by 1, 2 order by 3 desc, 1, 2 limit 10""", PK)
def agg_top_connections(spark, d):
    return K.connections(packets(spark, d), 10)


@query("agg_hourly", "select date_trunc('hour', ts) as hour, count(*) as n from log_events group by 1", LE)
def agg_hourly(spark, d):
    return A.hourly(events(spark, d))


_HOURS = ", ".join(f"count(*) filter (where hour(ts) = {h}) as h{h:02d}" for h in range(24))


@query("agg_heatmap", f"select cast(ts as date) as day, {_HOURS} from log_events group by 1", LE)
def agg_heatmap(spark, d):
    return A.heatmap(events(spark, d))


@query("agg_top_ind", "select value, cast(n_events as bigint) as n from ip_iocs order by n_events desc, value limit 10", ("ip_iocs",))
def agg_top_ind(spark, d):
    return A.top_indicators(I.extract(events(spark, d), ["ip"]))


@query("agg_terms", rf"""
select term, count(*) as n from (select unnest(regexp_split_to_array(lower(text), '\W+')) as term from documents) w
where term <> '' and term not in {in_list(V.STOP_WORDS)} group by term order by n desc, term limit 50""")
def agg_terms(spark, d):
    return A.top_terms(table(spark, d, "documents"))


@query("agg_find_sev", """
select count(*) filter (where severity = 'CRITICAL') as critical_count, count(*) filter (where severity = 'HIGH') as high_count,
 count(*) filter (where severity not in ('CRITICAL', 'HIGH') and (list_name = 'anomalies' or severity = 'MEDIUM')) as medium_count,
 count(*) filter (where severity not in ('CRITICAL', 'HIGH', 'MEDIUM') and list_name <> 'anomalies') as low_count,
 count(*) as total_findings from findings""", ("findings",))
def agg_find_sev(spark, d):
    return A.finding_severity_counts(analysis(spark, d).findings())


@query("agg_categories", "select list_name, count(*) as n from findings group by list_name", ("findings",))
def agg_categories(spark, d):
    return A.categories(analysis(spark, d).findings())


@query("agg_dashboard", f"""
select count(*) as total_events, count(*) filter (where severity = 'CRITICAL') as critical_events,
 count(*) filter (where severity in ('HIGH', 'ERROR', 'ALERT')) as high_events,
 count(distinct source_ip) filter (where severity in {in_list(V.DASHBOARD_HIGH_SEVERITIES)}) as suspicious_ips,
 count(distinct user_name) filter (where severity in {in_list(V.DASHBOARD_HIGH_SEVERITIES)}) as suspicious_users
from log_events""", LE)
def agg_dashboard(spark, d):
    return A.dashboard(events(spark, d))


@query("agg_quick", """
select count(*) filter (where severity in ('CRITICAL', 'EMERGENCY')) as critical_events,
 count(*) filter (where severity in ('HIGH', 'ALERT')) as high_events, count(*) as total_events from log_events""", LE)
def agg_quick(spark, d):
    counts = D.severity_profile(events(spark, d))
    pick = lambda *s: F.coalesce(F.sum(F.when(F.col("severity").isin(*s), F.col("n_events"))), F.lit(0))
    return counts.agg(
        pick("CRITICAL", "EMERGENCY").alias("critical_events"), pick("HIGH", "ALERT").alias("high_events"),
        F.sum("n_events").alias("total_events"))


_MATRIX = values(list(enumerate(V.MATRIX_TACTICS, 1)), "rank, tactic")


@query("agg_matrix", f"""
select cast(t.rank as bigint) as rank, t.tactic, coalesce((select string_agg(n, ', ' order by n) from (select distinct m.technique_name as n from mapped m
 where m.tactic = t.tactic) x), '') as techniques from ({_MATRIX}) t""", ("mapped",))
def agg_matrix(spark, d):
    return A.technique_matrix(M.map_findings(analysis(spark, d).findings()))


@query("agg_tactics", "select tactic, cast(sum(n_findings) as bigint) as n_findings from mapped group by tactic", ("mapped",))
def agg_tactics(spark, d):
    return A.tactic_counts(M.map_findings(analysis(spark, d).findings()))


# --- set operations -----------------------------------------------------------------------------

@query("set_union_findings", "select list_name, finding_type, severity, count(*) as n from findings group by 1, 2, 3", ("findings",))
def set_union_findings(spark, d):
    return A.value_counts(findings(spark, d), "list_name", "finding_type", "severity")


@query("set_distinct_append", """
select distinct v as value from (select source_ip as v from log_events union select host from log_events union
 select user_name from log_events) u""", LE)
def set_distinct_append(spark, d):
    e = events(spark, d)
    return J.distinct_union(*[e.select(F.col(c).alias("value")) for c in ("source_ip", "host", "user_name")])


@query("set_dedupe_mitig", f"""
select technique, technique_id, mitigation, priority from (
 select technique_name as technique, technique_id, mitigation, case when confidence = 'HIGH' then 'HIGH' else 'MEDIUM' end as priority,
  row_number() over (partition by mitigation order by list_position({V.MITIGATION_LISTS}, mapped_as)) as k
 from mapped where not is_anomaly and mapped_as in {in_list(V.MITIGATION_LISTS)}) x where k = 1""", ("mapped",))
def set_dedupe_mitig(spark, d):
    return M.mitigations(M.map_findings(analysis(spark, d).findings()))


@query("set_ioc_seen", "select source_ip as indicator from log_events intersect select indicator from ioc_feed", ("log_events", "ioc_feed"))
def set_ioc_seen(spark, d):
    return J.seen_in_feed(events(spark, d), view(spark, d, "ioc_feed"))
