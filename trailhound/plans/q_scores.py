"""Queries: windows, scores, chains, technique mapping, playbooks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from trailhound import fixed_values as V
from trailhound.functions.lookup import banded as banded_column
from trailhound.operators import chains as C
from trailhound.operators import detect as D
from trailhound.operators import iocs as I
from trailhound.operators import mitre as M
from trailhound.operators import aggregates as A
from trailhound.operators import analysis as Y
from trailhound.operators import playbooks as B
from trailhound.operators import scoring as S
from trailhound.operators import timeline as T
from trailhound.plans.fixtures import view
from trailhound.plans.oracle_views import banded, case_map, in_list, word_test
from trailhound.plans.q_core import LE, analysis, events, findings
from trailhound.plans.registry import query

AS_OF = "2024-01-31 00:00:00"
AS_OF_SQL = f"timestamp '{AS_OF}'"
H, DAY, WEEK, MONTH = 3600, 86400, 604800, 2592000


# --- windows ------------------------------------------------------------------------------------

_MARK = "case " + " ".join(
    f"when {word_test('substr(raw_log, 1, 100)', words)} then '{phase}'" for phase, words in V.PHASE_RULES) + " end"


def _phase_sql(partition):
    return f"""
select event_id, ts{", host" if partition else ""}, coalesce(last_value(mark ignore nulls) over (
 {partition} order by ts, event_id rows between unbounded preceding and current row), 'recon') as phase
from (select event_id, ts, host, {_MARK} as mark from log_events where ts is not null) m"""


@query("win_phase", _phase_sql("partition by host"), LE)
def win_phase(spark, d):
    return T.attack_phases(events(spark, d), ("host",))


@query("win_phase_global", _phase_sql(""), LE)
def win_phase_global(spark, d):
    return T.attack_phases(events(spark, d))


@query("win_timeline", """
select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as timestamp, severity, source, substr(raw_log, 1, 150) as event,
 severity in ('EMERGENCY', 'CRITICAL', 'HIGH') as is_critical from log_events where ts is not null""", LE)
def win_timeline(spark, d):
    return T.timeline(events(spark, d))


@query("win_timeline_top", f"""
select event_id, ts, coalesce(last_value(mark ignore nulls) over (order by ts, event_id rows between unbounded preceding and current row), 'recon') as phase,
 severity, source, event, remaining
from (select event_id, ts, severity, source, substr(raw_log, 1, 100) as event, {_MARK} as mark,
 cast(greatest((select count(*) from log_events) - 30, 0) as bigint) as remaining from log_events order by ts, event_id limit 30) m""", LE)
def win_timeline_top(spark, d):
    return T.timeline_top(events(spark, d))


@query("win_sev_rank", "select event_id, severity, cast(case severity when 'CRITICAL' then 4 when 'HIGH' then 3 when 'MEDIUM' then 2 else 1 end as bigint) as y_pos from log_events", LE)
def win_sev_rank(spark, d):
    return T.severity_rank(events(spark, d)).select("event_id", "severity", "y_pos")


@query("win_trend", """
select host, day, score, previous_score, coalesce(round(score - previous_score, 2), 0.0) as change,
 case when score - previous_score > 10 then 'INCREASING' when score - previous_score < -10 then 'DECREASING' else 'STABLE' end as trend
from (select *, lag(score) over (partition by host order by day) as previous_score from (
 select host, cast(ts as date) as day, cast(least(100, 10 * count(*) filter (where severity = 'CRITICAL')
  + 5 * count(*) filter (where severity in ('HIGH', 'ERROR', 'ALERT'))) as double) as score from log_events group by 1, 2) h) p""", LE)
def win_trend(spark, d):
    s = F.col("severity")
    history = events(spark, d).groupBy("host", F.to_date("ts").alias("day")).agg(F.least(
        F.lit(100), S.count_where(s == "CRITICAL") * 10 + S.count_where(s.isin("HIGH", "ERROR", "ALERT")) * 5)
        .cast("double").alias("score"))
    return T.risk_trend(history, ("host",), "day", "score")


@query("win_prioritize", """
select finding_type, list_name, event_id, risk_score, risk_level from scored_findings
order by risk_score desc, ts, event_id, list_name, finding_type, details limit 20""", ("scored_findings",))
def win_prioritize(spark, d):
    return T.prioritize(findings(spark, d)).select("finding_type", "list_name", "event_id", "risk_score", "risk_level")


_PHASES = """select t.tactic, t.tactic_rank, cast(sum(m.n_findings) as bigint) as n_findings,
 row_number() over (order by t.tactic_rank) as phase from mapped m join tactics t using (tactic) group by 1, 2"""


@query("win_chain_phase", f"select tactic, n_findings, phase from ({_PHASES}) p", ("mapped",))
def win_chain_phase(spark, d):
    return M.attack_order(M.map_findings(analysis(spark, d).findings()))


@query("win_first_step", """
select f.playbook, s.action, s.command, cast(sum(f.n_findings) as bigint) as n_findings
from finding_playbooks f join playbook_steps s on s.playbook = f.playbook and s.step = 1 group by 1, 2, 3""",
       ("finding_playbooks", "playbook_steps"))
def win_first_step(spark, d):
    f = analysis(spark, d).findings()
    books = B.all_playbooks(f).filter("n_findings > 0")
    return B.first_steps(books).select("playbook", "action", "command").join(
        F.broadcast(books.select("playbook", "n_findings")), "playbook")


@query("win_top_k_each", """
select severity, source_ip, n, rank from (select severity, source_ip, count(*) as n,
 row_number() over (partition by severity order by count(*) desc, source_ip) as rank from log_events group by 1, 2) x where rank <= 5""", LE)
def win_top_k_each(spark, d):
    return A.top_per_group(events(spark, d), "severity", "source_ip", 5)


# --- detector score -----------------------------------------------------------------------------

def _recency_sql(latest, limits, older, missing):
    arms = " ".join(f"when date_diff('microsecond', {latest}, {AS_OF_SQL}) < {s * 1000000} then {v}" for s, v in limits)
    return f"(case when {latest} is null then {missing} {arms} else {older} end)"


def _detector_sql(by):
    """Score per group, written over the events and their findings; the anomalies are recomputed per group."""
    g = by or "'all'"
    out = f"{by}, " if by else ""
    return f"""
select {out}total_events, critical_count, high_count, round(sev, 6) as severity_score, det as detection_score, vol as volume_score, rec as recency_score,
 cast(least(floor(round(0.4 * sev + 0.3 * det + 0.15 * vol + 0.15 * rec, 9)), 100) as bigint) as risk_score
from (select g as {by or "_g"}, total_events, critical_count, high_count, sev,
  cast(least(critical_count * 20 + high_count * 10, 100) as double) as det,
  cast(case when total_events > 100 then least(70 + (total_events - 100) / 10.0, 100) when total_events > 50 then 50 when total_events > 20 then 30
   when total_events > 10 then 20 else 10 end as double) as vol,
  cast({_recency_sql("latest", [(H, 100), (DAY, 80), (WEEK, 50)], 30, 50)} as double) as rec
 from (select s.g, s.total_events, s.sev, s.latest,
   coalesce(f.crit, 0) + s.anom_crit as critical_count,
   coalesce(f.high, 0) + s.anom_high + case when coalesce(f.auth, 0) > 5 then 1 else 0 end as high_count
  from (select g, cast(sum(n) as bigint) as total_events, max(latest) as latest,
    least(cast(sum(least(w * least(n, 10) / 10.0, 100)) as double) / count(*), 100) as sev,
    count(*) filter (where severity in ('EMERGENCY', 'CRITICAL')) as anom_crit, count(*) filter (where severity in ('HIGH', 'ALERT')) as anom_high
   from (select {g} as g, severity, count(*) as n, max(ts) as latest, {case_map("severity", V.SEVERITY_WEIGHTS, 20)} as w
    from log_events group by 1, 2) a group by g) s
  left join (select {g} as g, count(*) filter (where severity = 'CRITICAL') as crit, count(*) filter (where severity = 'HIGH') as high,
    count(*) filter (where list_name = 'failed_logins') as auth
   from (select * exclude (matched) from keyword_findings union all select * from row_findings where list_name = 'failed_logins') r group by 1) f on f.g = s.g) x) y"""


@query("scr_detector", _detector_sql(""), ("row_findings",))
def scr_detector(spark, d):
    return S.detector_score(D.severity_profile(events(spark, d)), AS_OF)


@query("scr_detector_by_host", _detector_sql("host"), ("row_findings",))
def scr_detector_by_host(spark, d):
    return S.detector_score(D.severity_profile(events(spark, d), ("host",)), AS_OF, ("host",))


@query("scr_recency", f"""
select source_ip, latest_ts, cast({_recency_sql("latest_ts", [(H, 100), (DAY, 80), (WEEK, 50)], 30, 50)} as bigint) as recency_score
from (select source_ip, max(ts) as latest_ts from log_events group by 1) x""", LE)
def scr_recency(spark, d):
    return S.recency(events(spark, d), AS_OF, ("source_ip",))


# --- findings score -----------------------------------------------------------------------------

def _counts_sql(by):
    """Per group: counts by type and list, written as plain filters over the findings."""
    types = ", ".join(f"count(*) filter (where finding_type = '{t}') as t_{t}" for t in V.FINDING_BASE_SCORES)
    return f"""(select {by or "'all'"} as g, {types}, count(*) as total,
 count(*) filter (where list_name = 'anomalies') as anomalies,
 count(*) filter (where list_name = 'anomalies' and severity = 'CRITICAL') as a_critical,
 count(*) filter (where list_name = 'anomalies' and severity = 'HIGH') as a_high,
 count(*) filter (where list_name = 'anomalies' and severity = 'MEDIUM') as a_medium,
 count(*) filter (where list_name = 'anomalies' and contains(finding_type, 'exfiltration')) as a_exfil,
 count(*) filter (where list_name = 'anomalies' and contains(finding_type, 'ransomware')) as a_ransom,
 max(ts) filter (where list_name in {in_list(V.RECENCY_LISTS + ['anomalies'])}) as latest,
 max(ts) filter (where list_name in {in_list(V.RECENT_LISTS)}) as serious
 from findings group by 1)"""


_SEV = "least(greatest(0, " + ", ".join(
    f"case when t_{t} > 0 then {b} * least(t_{t} / 10.0, 1.5) else 0 end" for t, b in V.FINDING_BASE_SCORES.items()) + (
    ", case when a_critical > 0 then 90 else 0 end, case when a_high > 0 then 70 else 0 end, case when a_medium > 0 then 50 else 0 end), 100)")
_VOL = ("case when total = 0 then 0 when total <= 5 then 20 when total <= 20 then 40 when total <= 50 then 60 "
        "when total <= 100 then 80 else 100 end")
_REC = _recency_sql("latest", [(H, 100), (DAY, 85), (WEEK, 60), (MONTH, 40)], 20, 50)


def _flag(name, points):
    return f"case when t_{name} > 0 then {points} else 0 end"


def _impact(assets):
    parts = [_flag(n, p) for n, p in V.IMPACT_POINTS]
    return f"least({' + '.join(parts)} + 30 * a_exfil + 50 * a_ransom + {assets}, 100)"


_LIK = ("least(case when t_failed_logins > 50 then 30 when t_failed_logins > 20 then 20 when t_failed_logins > 5 then 10 else 0 end + "
        + " + ".join(_flag(n, p) for n, p in V.LIKELIHOOD_POINTS) + " + least(5 * anomalies, 25), 100)")


def _component_query(name, column, expression, score):
    @query(name, f"select g as host, round(cast({expression} as double), 2) as {column} from {_counts_sql('host')} c where g is not null",
           ("findings",))
    def run(spark, d):
        return S.component(analysis(spark, d).findings(), column, score(), ("host",)).filter("host is not null")


_component_query("scr_severity", "severity_score", _SEV, S.severity_score)
_component_query("scr_volume", "volume_score", _VOL, S.volume_score)
_component_query("scr_recency2", "recency_score", _REC, lambda: S.recency_score(AS_OF))
_component_query("scr_likelihood", "likelihood_score", _LIK, S.likelihood_score)

_POINTS = case_map("asset_type", V.ASSET_CRITICALITY, 40)


@query("scr_impact", f"""
select g as host, round(cast({_impact("coalesce(p, 0)")} as double), 2) as impact_score from {_counts_sql('host')} c
left join (select asset_name, {_POINTS} * 0.1 as p from assets) a on a.asset_name = c.g where g is not null""", ("findings", "assets"))
def scr_impact(spark, d):
    return S.overall_risk(analysis(spark, d).findings(), AS_OF, ("host",), view(spark, d, "assets")).filter(
        "host is not null").select("host", "impact_score")


def _factor(test, text):
    return f"case when {test} then {text} end"


_FACTORS = "concat_ws('; ', " + ", ".join([
    _factor("t_suspicious_powershell > 0", "'Suspicious PowerShell execution (' || t_suspicious_powershell || ' instances)'"),
    _factor("t_lateral_movement > 0", "'Lateral movement detected (' || t_lateral_movement || ' attempts)'"),
    _factor("t_privilege_escalation > 0", "'Privilege escalation attempts (' || t_privilege_escalation || ' events)'"),
    _factor("t_persistence_attempts > 0", "'Persistence mechanisms detected (' || t_persistence_attempts || ' attempts)'"),
    _factor("t_failed_logins > 20", "'High volume of failed logins (' || t_failed_logins || ' attempts)'"),
    _factor("anomalies > 5", "'Multiple anomalies detected (' || anomalies || ')'"),
    _factor(f"date_diff('microsecond', serious, {AS_OF_SQL}) < 3600000000", "'Recent activity detected - immediate attention required'"),
    _factor("total > 50", "'High volume of security events (' || total || ' total)'"),
]) + ")"


def _overall_sql(by, assets):
    join = {
        "host": f"left join (select asset_name, {_POINTS} * 0.1 as p from assets) a on a.asset_name = c.g",
        "": f"""left join (select 'all' as asset_name, sum({_POINTS} * 0.1) as p from assets where asset_name in (
 select host from findings where host is not null)) a on true""",
    }[by] if assets else "left join (select 0.0 as p) a on true"
    return f"""
select {"g as host, " if by else ""}round(o, 2) as overall_risk_score, {banded("o", V.RISK_BANDS)} as risk_level,
 round(sev, 2) as severity_score, round(vol, 2) as volume_score, round(rec, 2) as recency_score, round(imp, 2) as impact_score,
 round(lik, 2) as likelihood_score, {banded("o", V.RISK_BANDS, 2)} as recommended_action, {banded("o", V.RISK_BANDS, 3)} as response_timeframe,
 factors as contributing_factors
from (select *, round(0.35 * sev + 0.15 * vol + 0.15 * rec + 0.20 * imp + 0.15 * lik, 9) as o
 from (select g, cast({_SEV} as double) as sev, cast({_VOL} as double) as vol, cast({_REC} as double) as rec,
  cast({_impact("coalesce(p, 0)")} as double) as imp, cast({_LIK} as double) as lik, {_FACTORS} as factors
  from {_counts_sql(by)} c {join}) s) t"""


@query("scr_overall", _overall_sql("", True), ("findings", "assets"))
def scr_overall(spark, d):
    return S.overall_risk(analysis(spark, d).findings(), AS_OF, assets=view(spark, d, "assets"))


@query("scr_overall_by_host", _overall_sql("host", True), ("findings", "assets"))
def scr_overall_by_host(spark, d):
    return S.overall_risk(analysis(spark, d).findings(), AS_OF, ("host",), view(spark, d, "assets"))


def _bands_sql(column, field):
    return f"select host, day, score, {banded('score', V.RISK_BANDS, field)} as {column} from ({_DAILY}) d"


_DAILY = """select host, cast(ts as date) as day, least(100, 10 * count(*) filter (where severity = 'CRITICAL')
 + 5 * count(*) filter (where severity in ('HIGH', 'ERROR', 'ALERT', 'WARN'))) as score from log_events group by 1, 2"""


def _daily(spark, d):
    s = F.col("severity")
    return events(spark, d).groupBy("host", F.to_date("ts").alias("day")).agg(F.least(
        F.lit(100).cast("bigint"), S.count_where(s == "CRITICAL") * 10
        + S.count_where(s.isin("HIGH", "ERROR", "ALERT", "WARN")) * 5).alias("score"))


def _band_query(name, column, field):
    @query(name, _bands_sql(column, field), LE)
    def run(spark, d):
        return S.risk_bands(_daily(spark, d), "score").select("host", "day", "score", column)


_band_query("scr_level", "risk_level", 1)
_band_query("scr_action", "recommended_action", 2)
_band_query("scr_timeframe", "response_timeframe", 3)


@query("scr_factors", f"select g as host, {_FACTORS} as contributing_factors from {_counts_sql('host')} c", ("findings",))
def scr_factors(spark, d):
    counts = S.finding_profile(analysis(spark, d).findings(), ("host",))
    return counts.select("host", F.array_join(S.contributing_factors(AS_OF), "; ").alias("contributing_factors"))


@query("scr_finding", "select finding_type, event_id, user_name, source_ip, risk_score, risk_level from scored_findings", ("scored_findings",))
def scr_finding(spark, d):
    return T.score_findings(findings(spark, d)).select(
        "finding_type", "event_id", "user_name", "source_ip", "risk_score", "risk_level")


_ASSET_TEXT = ("case when r >= 80 then 'IMMEDIATE: Isolate ' || asset_type || ' and conduct forensic analysis' "
               "when r >= 60 then 'HIGH PRIORITY: Escalate investigation for ' || asset_type "
               "when r >= 40 then 'REVIEW: Conduct vulnerability scan on ' || asset_type "
               "else 'MONITOR: Continue standard monitoring for ' || asset_type end")


@query("scr_asset", f"""
select asset_name, asset_type, c as asset_criticality, n as finding_count, round(r, 2) as risk_score, {banded("r", V.RISK_BANDS)} as risk_level,
 {_ASSET_TEXT} as recommendation
from (select asset_name, asset_type, cast(c as bigint) as c, n, round(0.6 * c + 0.4 * coalesce(m, 0.0), 9) as r from (
 select asset_name, asset_type, {_POINTS} as c, count(f.finding_type) as n,
  avg(cast({case_map("f.finding_type", V.FINDING_BASE_SCORES, 50)} as double)) filter (where f.finding_type is not null) as m
 from assets a left join findings f on f.host = a.asset_name group by 1, 2, 3) x) y""", ("findings", "assets"))
def scr_asset(spark, d):
    return S.asset_risk(analysis(spark, d).findings(), view(spark, d, "assets"))


@query("scr_metrics", """
select count(*) as total_findings, count(*) filter (where risk_level = 'CRITICAL') as critical_findings,
 count(*) filter (where risk_level = 'HIGH') as high_findings, round(avg(risk_score), 6) as average_risk_score from scored_findings""",
       ("scored_findings",))
def scr_metrics(spark, d):
    return S.risk_metrics(findings(spark, d))


@query("scr_recommend", f"""
select row_number() over (order by k) as rank, t as recommendation from (
 select k, t from (
  select 0 as k, unnest({V.RECOMMENDATION_RULES["score"]}) as t, 'score' as need union all
  select 1, unnest({V.RECOMMENDATION_RULES["suspicious_powershell"]}), 'suspicious_powershell' union all
  select 2, unnest({V.RECOMMENDATION_RULES["lateral_movement"]}), 'lateral_movement' union all
  select 3, unnest({V.RECOMMENDATION_RULES["privilege_escalation"]}), 'privilege_escalation' union all
  select 4, unnest({V.RECOMMENDATION_RULES["failed_logins"]}), 'failed_logins' union all
  select 5, unnest({V.RECOMMENDATION_RULES["always"]}), 'always') r
 where need = 'always' or (need = 'score' and (select overall_risk_score from ({_overall_sql("", False)}) o) >= 70)
  or need in (select list_name from (select list_name, row_number() over (order by risk_score desc, ts, event_id, list_name, finding_type, details) as p
    from scored_findings) q where p <= case when need = 'failed_logins' then 10 else 5 end)) z limit 8""", ("findings", "scored_findings"))
def scr_recommend(spark, d):
    order = W.orderBy(F.desc("risk_score"), "ts", "event_id", "list_name", "finding_type", "details")
    ranked = Y.top_findings(events(spark, d), 10).select("list_name", F.row_number().over(order).alias("rank"))
    return S.recommendations(S.overall_risk(analysis(spark, d).findings(), AS_OF), ranked)


@query("scr_decay", f"""
select list_name, count(*) as n, round(sum(risk_score * case when age < 3600 then 1.0 when age < 86400 then 0.9 when age < 604800 then 0.7
 when age < 2592000 then 0.5 else 0.3 end), 2) as decayed_sum
from (select *, date_diff('microsecond', ts, {AS_OF_SQL}) / 1000000.0 as age from scored_findings) s group by 1""".replace(
    "round(sum(risk_score *", "round(cast(sum(risk_score *").replace("0.3 end), 2)", "0.3 end) as double), 2)"), ("scored_findings",))
def scr_decay(spark, d):
    return S.decayed_findings(findings(spark, d), AS_OF).groupBy("list_name").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("decayed_score"), 2).alias("decayed_sum"))


@query("scr_dashboard", f"""
select s as risk_score, {banded("s", V.DASHBOARD_BANDS)} as risk_level from (
 select cast(least(100, 10 * count(*) filter (where severity = 'CRITICAL') + 5 * count(*) filter (where severity in ('HIGH', 'ERROR', 'ALERT'))
  + count(distinct source_ip) filter (where severity in {in_list(V.DASHBOARD_HIGH_SEVERITIES)})) as bigint) as s from log_events) x""", LE)
def scr_dashboard(spark, d):
    return S.dashboard_score(A.dashboard(events(spark, d)))


# the chain of a host: patterns over their thresholds
_FLAGS = """(select *, authentication_failure_cluster > 5 as auth, privilege_escalation > 0 as priv, database_availability > 0 as db,
 ransomware_indicators > 0 as ransom, off_hours_activity > total_events * 0.3 as night,
 case when ransomware_indicators > 0 then 95 when database_availability > 0 then 75
  when authentication_failure_cluster > 5 or privilege_escalation > 0 then 50 end as conf from pattern_counts_by_host) f"""
HOSTS = ("pattern_counts_by_host",)


def _host_counts(spark, d):
    return D.pattern_counts(events(spark, d), ("host",))


@query("scr_agent", f"""
select host, r as overall_risk, {banded("r", V.AGENT_BANDS)} as risk_level, {banded("r", V.AGENT_BANDS, 2)} as action, chain_confidence
from (select host, cast(coalesce(conf, 20) as bigint) as chain_confidence, cast(floor(round((coalesce(list_avg([
 case when auth then case when authentication_failure_cluster > 20 then 75 else 50 end end, case when priv then 75 end, case when db then 75 end,
 case when ransom then 95 end, case when night then 50 end]), 20) + coalesce(conf, 20)) / 2.0, 9)) as bigint) as r from {_FLAGS}) y""", HOSTS)
def scr_agent(spark, d):
    return S.agent_score(_host_counts(spark, d), ("host",))


def _pick(none, ransom, strong, partial, weak):
    return f"cast(case when conf is null then {none} when ransom then {ransom} when conf >= 70 then {strong} when conf >= 50 then {partial} else {weak} end as bigint)"


@query("scr_confidence", f"""
select host, {_pick(20, 85, 70, 55, 35)} as overall_confidence, cast(coalesce(conf, 0) as bigint) as attack_chain_confidence,
 {_pick(0, 80, 65, 50, 0)} as ioc_confidence, {_pick(0, 85, 70, 50, 0)} as root_cause_confidence from {_FLAGS}""", HOSTS)
def scr_confidence(spark, d):
    return S.confidence_scores(_host_counts(spark, d), ("host",))


@query("scr_evidence", f"""
select host, cast(list_count(w) as bigint) as evidence_kinds, cast(floor(m) as bigint) as confidence, {banded("m", V.EVIDENCE_BANDS)} as confidence_level
from (select host, w, round(coalesce(list_avg(w), 20), 9) as m from (select f.host, [case when ransom then 95.0::double end, case when priv then 85.0::double end,
 case when auth then least(50 + authentication_failure_cluster / 10.0, 85)::double end, case when x.host is not null then 60.0::double end,
 case when (auth and priv) or (priv and ransom) then 70.0::double end] as w
 from {_FLAGS} left join (select distinct host from log_events where source_ip like '185.%') x on x.host = f.host) y) z""",
       ("pattern_counts_by_host", "log_events"))
def scr_evidence(spark, d):
    return S.evidence_score(S.evidence_counts(events(spark, d), ("host",)), ("host",))


@query("scr_report_conf", f"""
select host, c as confidence, least(85, c + 10) as evidence_quality, least(70, c) as correlation_confidence from (
 select g as host, cast(least(95, 20 + {_flag("suspicious_powershell", 30)} + {_flag("lateral_movement", 25)} + {_flag("privilege_escalation", 20)}
  + case when t_failed_logins > 10 then 15 else 0 end) as bigint) as c from {_counts_sql("host")} c) x""", ("findings",))
def scr_report_conf(spark, d):
    return S.report_confidence(findings(spark, d), ("host",))


_REPORT_NAMES = ["severity_level", "likelihood", "impact", "sophistication", "priority", "incident_category"]


@query("scr_report_bands", f"""
select host, day, score, {", ".join(f"{banded('score', V.REPORT_BANDS, i)} as {n}" for i, n in enumerate(_REPORT_NAMES, 1))},
 case when score >= 70 then 'Active compromise confirmed. Immediate containment required.'
  when score >= 40 then 'Strong evidence of suspicious activity. Urgent investigation recommended.'
  when score >= 10 then 'Anomalous behavior detected. Further investigation warranted.'
  else 'No immediate threats identified. Continue standard monitoring.' end as conclusion from ({_DAILY}) d""", LE)
def scr_report_bands(spark, d):
    return S.report_bands(_daily(spark, d), "score", F.col("score") >= 10)


# --- chains -------------------------------------------------------------------------------------

@query("chn_build", f"""
select host, 'CHAIN-001' as chain_id, cast(conf as bigint) as confidence,
 concat_ws(',', case when auth then 'Initial Access' end, case when priv then 'Privilege Escalation' end, case when priv then 'Persistence' end,
  case when db then 'Impact' end, case when ransom then 'Impact' end) as phases,
 concat_ws(',', case when priv then 'T1068' end, case when priv then 'T1547' end, case when db then 'T1499' end, case when ransom then 'T1486' end) as techniques
from {_FLAGS} where conf is not null""", HOSTS)
def chn_build(spark, d):
    chain = C.attack_chain(_host_counts(spark, d), ("host",))
    return chain.withColumns({c: F.array_join(c, ",") for c in ("phases", "techniques")})


def _first_five(kind):
    return f"""select '{kind}' as kind, row_number() over (order by first_ts, value) as rank, value from (
 select value, first_ts from {kind}_iocs order by first_ts, value limit 5) {kind}s"""


@query("chn_assets", " union all ".join(_first_five(k) for k in ("host", "service", "ip", "user")),
       ("ip_iocs", "user_iocs", "host_iocs", "service_iocs"))
def chn_assets(spark, d):
    return C.chain_assets(I.extract(events(spark, d), ["user", "host", "service", "ip"]))


@query("chn_class", f"""
select host, case when ransom then 'RANSOMWARE ATTACK' when priv and auth then 'CREDENTIAL COMPROMISE' when priv then 'PRIVILEGE ESCALATION'
  when db then 'DATABASE AVAILABILITY' else 'SUSPICIOUS ACTIVITY' end as incident_type,
 case when ransom then 'CRITICAL' when priv and db then 'HIGH' when priv then 'MEDIUM-HIGH' else 'MEDIUM' end as incident_severity,
 case when ransom then 'IMMEDIATE RESPONSE REQUIRED' when priv and db then 'URGENT INVESTIGATION REQUIRED' when priv then 'PRIORITY INVESTIGATION'
  else 'INVESTIGATE WITHIN 24 HOURS' end as urgency,
 case when ransom then 'credential_compromise_to_ransomware' when priv and auth then 'credential_compromise_with_privilege_escalation'
  when priv then 'insider_or_malicious_privilege_escalation' else 'undetermined' end as root_cause,
 cast(case when ransom then 85 when priv and auth then 70 when priv then 50 else 30 end as bigint) as root_cause_confidence,
 case when conf is null then 'LOW' when conf >= 80 then 'CRITICAL' when conf >= 60 then 'HIGH' when conf >= 40 then 'MEDIUM' else 'LOW-MEDIUM' end as final_risk
from {_FLAGS}""", HOSTS)
def chn_class(spark, d):
    return C.classify(_host_counts(spark, d), ("host",))


# --- technique mapping --------------------------------------------------------------------------

def mapped(spark, d):
    return M.map_findings(analysis(spark, d).findings())


@query("mit_map", """
select mapped_as, is_anomaly, n_findings, technique_id, technique_name, tactic, tactic_id, confidence, technique_description, detection, mitigation
from mapped""", ("mapped",))
def mit_map(spark, d):
    return mapped(spark, d)


@query("mit_map_alias", """
select mapped_as, case when contains(mapped_as, 'brute_force') then 'T1110' else technique_id end as technique_id from mapped""", ("mapped",))
def mit_map_alias(spark, d):
    return M.map_findings(analysis(spark, d).findings(), alias=True).select("mapped_as", "technique_id")


@query("mit_all", """
select cast(sum(n_findings) as bigint) as total_mapped_findings,
 cast(count(*) filter (where not is_anomaly) + coalesce(sum(n_findings) filter (where is_anomaly), 0) as bigint) as techniques_used from mapped""", ("mapped",))
def mit_all(spark, d):
    return M.mapping_totals(mapped(spark, d))


@query("mit_flow", f"""
select string_agg(case when phase = 1 then 'Starts with ' else '' end || tactic || case when n_findings > 1 then ' (' || n_findings || ' techniques)' else '' end,
 ' → ' order by phase) as attack_flow, count(*) as n_tactics from ({_PHASES}) p""", ("mapped",))
def mit_flow(spark, d):
    return M.attack_flow(mapped(spark, d))


@query("mit_mitig", f"""
select m.technique_name as technique, m.technique_id, m.mitigation, case when m.confidence = 'HIGH' then 'HIGH' else 'MEDIUM' end as priority
from mapped m where not is_anomaly and mapped_as in {in_list(V.MITIGATION_LISTS)} and exists (select 1 from techniques t where t.technique_id = m.technique_id)""",
       ("mapped", "techniques"))
def mit_mitig(spark, d):
    return M.mitigations(mapped(spark, d))


@query("mit_details", """
select t.technique_id, t.name as technique_name, t.tactic_id, c.tactic as tactic_name, t.description, t.detection, t.mitigation, '' as subtechniques
from techniques t join tactics c using (tactic_id) where t.technique_id in (select technique_id from mapped)""", ("mapped", "techniques", "tactics"))
def mit_details(spark, d):
    return M.technique_details(mapped(spark, d))


@query("mit_agent", f"""
select host, t as technique_id, n as technique_name, c as tactic, cast(conf as bigint) as confidence from {_FLAGS} join (values
 ('T1068', 'Exploitation for Privilege Escalation', 'Privilege Escalation', 'p'), ('T1547', 'Boot or Logon Autostart Execution', 'Persistence', 'p'),
 ('T1499', 'Endpoint Denial of Service', 'Impact', 'd'), ('T1486', 'Data Encrypted for Impact', 'Impact', 'r')) v(t, n, c, k)
 on (k = 'p' and priv) or (k = 'd' and db) or (k = 'r' and ransom)""", HOSTS)
def mit_agent(spark, d):
    return C.chain_techniques(_host_counts(spark, d), ("host",))


# --- playbooks ----------------------------------------------------------------------------------

_BOOK_N = "(select playbook, cast(sum(n_findings) as bigint) as n_findings from finding_playbooks group by 1)"
_MINUTES = "(select playbook, count(*) as n_steps, cast(sum(cast(regexp_extract(estimated_time, '\\d+') as bigint)) as bigint) as minutes from playbook_steps group by 1)"
_DURATION = "case when minutes < 60 then minutes || ' minutes' else (minutes // 60) || ' hours ' || (minutes % 60) || ' minutes' end"


@query("pb_lookup", """
select p.playbook, p.playbook_id, p.title, n_findings from playbooks p join (
 select finding_type as playbook, count(*) as n_findings from findings group by 1) f using (playbook)""", ("playbooks", "findings"))
def pb_lookup(spark, d):
    return B.look_up_playbooks(analysis(spark, d).findings()).select("playbook", "playbook_id", "title", "n_findings")


@query("pb_by_severity", f"""
select p.playbook, p.title, coalesce(n_findings, 0) as n_findings from playbooks p left join {_BOOK_N} b using (playbook)
where playbook_severity = 'CRITICAL'""", ("playbooks", "finding_playbooks"))
def pb_by_severity(spark, d):
    return B.by_severity(analysis(spark, d).findings(), "CRITICAL").select("playbook", "title", "n_findings")


@query("pb_by_technique", """
select m.technique_id, min_by(p.playbook, p.playbook_rank) as playbook from (select distinct technique_id from mapped) m
left join playbooks p on contains(p.mitre_technique, m.technique_id) group by 1""", ("mapped", "playbooks"))
def pb_by_technique(spark, d):
    return B.by_technique(mapped(spark, d))


@query("pb_all", f"""
select p.playbook, p.playbook_id, p.title, p.playbook_severity, p.mitre_tactic, p.mitre_technique, p.detection_method, p.verification,
 coalesce(n_findings, 0) as n_findings from playbooks p left join {_BOOK_N} b using (playbook)""", ("playbooks", "finding_playbooks"))
def pb_all(spark, d):
    return B.all_playbooks(analysis(spark, d).findings()).select(
        "playbook", "playbook_id", "title", "playbook_severity", "mitre_tactic", "mitre_technique", "detection_method",
        "verification", "n_findings")


@query("pb_summary", f"""
select playbook, playbook_id, title, playbook_severity as severity, mitre_tactic, mitre_technique, n_steps as total_containment_steps,
 minutes as response_minutes, {_DURATION} as estimated_response_time from playbooks join {_MINUTES} m using (playbook) join {_BOOK_N} b using (playbook)""",
       ("playbooks", "playbook_steps", "finding_playbooks"))
def pb_summary(spark, d):
    return B.summaries(B.all_playbooks(analysis(spark, d).findings()).filter("n_findings > 0"))


@query("pb_steps", f"""
select playbook, part, cast(step as bigint) as step, action, command, platform, estimated_time, alternative
from playbook_all_steps join {_BOOK_N} b using (playbook)""",
       ("playbook_all_steps", "finding_playbooks"))
def pb_steps(spark, d):
    return B.steps(B.all_playbooks(analysis(spark, d).findings()).filter("n_findings > 0"))


@query("pb_plan", f"""
select cast({case_map("f.severity", V.PLAN_SEVERITY_ORDER, 5)} as bigint) as priority, f.finding_type, f.severity, f.n_findings, p.playbook_id,
 p.title as playbook_title, case when p.playbook_severity in ('CRITICAL', 'HIGH') then s.action end as critical_action,
 case when p.playbook_severity in ('CRITICAL', 'HIGH') then s.command end as critical_command, minutes as response_minutes
from finding_playbooks f join playbooks p using (playbook) join playbook_steps s on s.playbook = f.playbook and s.step = 1
join {_MINUTES} m on m.playbook = f.playbook""", ("finding_playbooks", "playbooks", "playbook_steps"))
def pb_plan(spark, d):
    return B.response_plan(analysis(spark, d).findings())


@query("pb_plan_time", f"""
select minutes as total_minutes, {_DURATION} as estimated_total_time from (
 select cast(sum(minutes) as bigint) as minutes from {_MINUTES} m join {_BOOK_N} b using (playbook)) x""", ("finding_playbooks", "playbook_steps"))
def pb_plan_time(spark, d):
    return B.plan_time(B.response_plan(analysis(spark, d).findings()))


@query("pb_select", """
select playbook, list_name, n as n_findings from (values (1, 'suspicious_powershell', 0, 'suspicious_powershell'), (2, 'lateral_movement', 0, 'lateral_movement'),
 (3, 'privilege_escalation', 0, 'privilege_escalation'), (4, 'failed_logins', 10, 'brute_force_attack')) r(k, list_name, above, playbook)
join (select list_name, count(*) as n from findings group by 1) c using (list_name) where n > above order by k limit 2""", ("findings",))
def pb_select(spark, d):
    return B.dashboard_playbooks(analysis(spark, d).findings())


@query("rpt_block_list", "select value, first_ts from ip_iocs order by first_ts, value limit 5", ("ip_iocs",))
def rpt_block_list(spark, d):
    return I.block_list(I.extract(events(spark, d), ["ip"]))
