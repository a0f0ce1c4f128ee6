"""Views that only the check SQL uses: findings and counts computed the plain way, with joins and unions."""

from __future__ import annotations

from trailhound import fixed_values as V
from trailhound import playbook_values as P


def quoted(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def values(rows, columns: str) -> str:
    body = ",\n ".join("(" + ", ".join(quoted(v) for v in r) + ")" for r in rows)
    return f"select * from (values\n {body}) as t({columns})"


def word_test(text: str, words) -> str:
    return "(" + " or ".join(f"contains(lower({text}), {quoted(w.lower())})" for w in words) + ")"


def case_map(column: str, mapping: dict, default) -> str:
    arms = " ".join(f"when {quoted(k)} then {quoted(v)}" for k, v in mapping.items())
    return f"(case {column} {arms} else {default} end)"


def in_list(items) -> str:
    return "(" + ", ".join(quoted(i) for i in items) + ")"


def banded(score: str, bands, field: int = 1) -> str:
    arms = " ".join(f"when {score} >= {b[0]} then {quoted(b[field])}" for b in bands[:-1])
    return f"(case {arms} else {quoted(bands[-1][field])} end)"


def _command_test(category: str) -> str:
    tests = []
    for p in V.COMMAND_PATTERNS[category]:
        tests.append(
            f"regexp_matches(raw_log, {quoted('(?i)' + p)})" if ".*" in p
            else f"contains(lower(raw_log), {quoted(p)})")
    return "(" + " or ".join(tests) + ")"


_BASE = ("event_id, ts, user_name, source_ip, host, substr(raw_log, 1, 200) as details, "
         "cast(null as double) as metric")


def _simple(kind: str, list_name: str, severity: str, test: str) -> str:
    return (f"select {quoted(kind)} as finding_type, {quoted(list_name)} as list_name, {severity} as severity, "
            f"{_BASE} from log_events where {test}")


def _ioc_view(parts, where: str) -> str:
    return f"""
select value, count(distinct event_id) as n_events, min(ts) as first_ts, max(ts) as last_ts
from (select event_id, ts, unnest(flatten([{", ".join(parts)}])) as value from log_events) x where {where} group by value"""


ORACLE_VIEWS = {
    "user_iocs": _ioc_view([
        r"regexp_extract_all(raw_log, '(?i)user[=:]\s*([\w-]+)', 1)",
        r"regexp_extract_all(raw_log, '(?i)username[=:]\s*(\w+)', 1)",
        r"regexp_extract_all(raw_log, '(?i)account[=:]\s*(\w+)', 1)",
        r"regexp_extract_all(raw_log, '(?i)user\s+(\w+)', 1)",
        r"regexp_extract_all(raw_log, '(?i)user_id[=:]\s*(\w+)', 1)",
        r"regexp_extract_all(raw_log, '(?i)u(\d+)', 1)", "[user_name]"],
        f"value is not null and lower(value) not in {in_list(V.USER_STOP)}"),
    "host_iocs": _ioc_view([
        r"regexp_extract_all(raw_log, '(?i)(?:host|server|node|computer|hostname)[=:]\s*(\w+(?:[-\w]+)*)', 1)", "[host]"],
        "value is not null and lower(value) not in ('null', 'none', 'unknown')"),
    "service_iocs": _ioc_view([
        r"regexp_extract_all(raw_log, '(?i)service[=:]\s*(\w+(?:[-\w]+)*)', 1)", "[source]"], "value is not null"),
    "keyword_rules": values(
        [(k, s, n, w) for k, s, n, words in V.KEYWORD_RULES for w in words],
        "finding_type, severity, list_name, word"),
    "keyword_findings": """
select k.finding_type, k.list_name, k.severity, e.event_id, e.ts, e.user_name, e.source_ip, e.host,
 substr(e.raw_log, 1, 200) as details, cast(null as double) as metric, k.word as matched
from log_events e join keyword_rules k on contains(lower(e.raw_log), k.word)""",
    "row_findings": "\nunion all\n".join([
        "select * exclude (matched) from keyword_findings",
        _simple("failed_logins", "failed_logins", "severity", word_test("raw_log", V.AUTH_FAIL_WORDS)),
        _simple("successful_logins", "successful_logins", "'INFO'", word_test("raw_log", V.LOGIN_OK_WORDS)),
        *[_simple("suspicious_process", "suspicious_processes", "'MEDIUM'", f"contains(lower(raw_log), {quoted(p)})")
          for p in V.SUSPICIOUS_PROCESSES],
        _simple("suspicious_powershell", "suspicious_powershell", "'HIGH'",
                "contains(lower(raw_log), 'powershell') and " + word_test("raw_log", V.POWERSHELL_ARGS)),
        _simple("privilege_escalation", "privilege_escalation", "'CRITICAL'", _command_test("privilege_escalation")),
        _simple("persistence_attempts", "persistence_attempts", "'HIGH'", _command_test("persistence")),
        _simple("lateral_movement", "lateral_movement", "'HIGH'", _command_test("lateral_movement")),
        _simple("data_exfiltration", "high_risk_commands", "'HIGH'", _command_test("exfiltration")),
    ]),
    "anomaly_findings": f"""
select 'high_severity_' || lower(severity) || '_events' as finding_type, 'anomalies' as list_name,
 case when severity in ('EMERGENCY','CRITICAL') then 'CRITICAL' else 'HIGH' end as severity,
 cast(null as bigint) as event_id, cast(null as timestamp) as ts, cast(null as varchar) as user_name,
 cast(null as varchar) as source_ip, cast(null as varchar) as host,
 cast(count(*) as varchar) || ' ' || severity || ' severity events detected' as details,
 cast(count(*) as double) as metric
from log_events where severity in ('EMERGENCY','CRITICAL','HIGH','ALERT') group by severity
union all
select 'brute_force_suspected', 'anomalies', 'HIGH', null, null, null, null, null,
 cast(count(*) as varchar) || ' authentication failure events detected', cast(count(*) as double)
from log_events where {word_test("raw_log", V.AUTH_FAIL_WORDS)} having count(*) > 5
union all
select 'off_hours_activity', 'anomalies', 'MEDIUM', null, null, null, null, null,
 cast(count(*) filter (where hour(ts) in (22,23,0,1,2,3,4,5,6)) as varchar) || ' events occurred during off-hours',
 round(count(*) filter (where hour(ts) in (22,23,0,1,2,3,4,5,6)) / cast(count(ts) as double) * 100.0, 6)
from log_events having count(*) filter (where hour(ts) in (22,23,0,1,2,3,4,5,6)) > count(ts) * 0.3""",
    "findings": "select * from row_findings union all select * from anomaly_findings",
    "pattern_counts": f"""
select {", ".join(f"count(*) filter (where {word_test('raw_log', words)}) as {name}" for name, words, _ in V.PATTERN_CLUSTERS)},
 count(*) filter (where hour(ts) between 0 and 5) as off_hours_activity, count(*) as total_events
from log_events""",
    "pattern_counts_by_host": f"""
select host, {", ".join(f"count(*) filter (where {word_test('raw_log', words)}) as {name}" for name, words, _ in V.PATTERN_CLUSTERS)},
 count(*) filter (where hour(ts) between 0 and 5) as off_hours_activity, count(*) as total_events
from log_events group by host""",
    "suspicious_patterns": """
select 'authentication_failure_cluster' as pattern, authentication_failure_cluster as n,
 case when authentication_failure_cluster > 20 then 'HIGH' else 'MEDIUM' end as significance
from pattern_counts where authentication_failure_cluster > 5
union all select 'privilege_escalation', privilege_escalation, 'HIGH' from pattern_counts where privilege_escalation > 0
union all select 'database_availability', database_availability, 'HIGH' from pattern_counts where database_availability > 0
union all select 'ransomware_indicators', ransomware_indicators, 'CRITICAL' from pattern_counts where ransomware_indicators > 0
union all select 'off_hours_activity', off_hours_activity, 'MEDIUM' from pattern_counts where off_hours_activity > total_events * 0.3""",
    "finding_techniques": values(V.FINDING_TECHNIQUES, "finding_type, technique_id, technique_name, confidence, tactic"),
    "techniques": values(V.TECHNIQUES, "technique_id, name, tactic_id, description, detection, mitigation"),
    "tactics": values([(i, *t) for i, t in enumerate(V.TACTICS, 1)], "tactic_rank, tactic_id, tactic, tactic_description"),
    "mapped": f"""
select c.mapped_as, c.is_anomaly, c.n_findings, coalesce(f.technique_id, 'Unknown') as technique_id,
 coalesce(f.technique_name, 'Unknown') as technique_name, coalesce(f.tactic, 'Unknown') as tactic,
 coalesce(t.tactic_id, 'Unknown') as tactic_id, coalesce(f.confidence, 'LOW') as confidence,
 case when f.technique_id is not null then coalesce(q.description, '') end as technique_description,
 case when f.technique_id is not null then coalesce(q.detection, 'Monitor relevant logs') end as detection,
 case when f.technique_id is not null then coalesce(q.mitigation, 'Implement security controls') end as mitigation
from (
 select finding_type as mapped_as, true as is_anomaly, count(*) as n_findings from findings
 where list_name = 'anomalies' group by finding_type
 union all
 select list_name, false, count(*) from findings where list_name in {in_list(V.PRIORITIZED_LISTS)} group by list_name) c
left join finding_techniques f on f.finding_type = c.mapped_as
left join techniques q on q.technique_id = f.technique_id
left join tactics t on t.tactic = f.tactic""",
    "playbooks": values(
        [(i, *b) for i, b in enumerate(P.PLAYBOOKS, 1)],
        "playbook_rank, playbook, playbook_id, title, playbook_severity, mitre_tactic, mitre_technique, "
        "detection_method, verification"),
    "playbook_steps": values(P.CONTAINMENT_STEPS, "playbook, step, action, command, platform, estimated_time"),
    "playbook_all_steps": values(
        [(key, "containment", *rest, P.STEP_ALTERNATIVES.get((key, rest[0]))) for key, *rest in P.CONTAINMENT_STEPS]
        + [(key, part, i, action, None, None, None, None) for key, *lists in P.FOLLOW_UP_STEPS
           for part, actions in zip(("eradication", "recovery"), lists) for i, action in enumerate(actions, 1)],
        "playbook, part, step, action, command, platform, estimated_time, alternative"),
    "playbook_substrings": values(
        [(i, *r) for i, r in enumerate(V.PLAYBOOK_SUBSTRINGS)], "rank, part, playbook"),
    "finding_playbooks": """
select k.finding_type, k.severity, k.n_findings, coalesce((
 select s.playbook from playbook_substrings s where contains(k.finding_type, s.part) order by s.rank limit 1),
 'generic_compromise') as playbook
from (select finding_type, severity, count(*) as n_findings from findings group by finding_type, severity) k""",
    "scored_findings": f"""
select *, case when risk_score >= 90 then 'CRITICAL' when risk_score >= 70 then 'HIGH' when risk_score >= 40 then 'MEDIUM'
 when risk_score >= 20 then 'LOW' else 'INFO' end as risk_level
from (
 select *, cast(least(100, {case_map("list_name", V.FINDING_BASE_SCORES, 50)}
  + case when lower(user_name) in ('admin','administrator','root','system') then 15 else 0 end
  + case when source_ip is null or source_ip = '' or regexp_matches(source_ip, '^(192\\.168\\.|10\\.|172\\.)') then 0 else 10 end) as bigint) as risk_score
 from findings where list_name in {in_list(V.PRIORITIZED_LISTS)}) s""",
    "ip_iocs": """
select value, count(distinct event_id) as n_events, min(ts) as first_ts, max(ts) as last_ts from (
 select event_id, ts, unnest(list_concat(regexp_extract_all(raw_log, '\\b(?:\\d{1,3}\\.){3}\\d{1,3}\\b'), [source_ip])) as value
 from log_events) x
where not regexp_matches(value, '^(10\\.|192\\.168\\.|172\\.|127\\.|0\\.|169\\.254\\.|255\\.)') group by value""",
}

# reading order: a view may use the ones before it
ORDER = [
    "log_events", "log_lines", "packets", "assets", "ioc_feed", "keyword_rules", "keyword_findings", "row_findings",
    "anomaly_findings", "findings", "pattern_counts", "pattern_counts_by_host", "suspicious_patterns",
    "finding_techniques", "techniques", "tactics", "mapped", "playbooks", "playbook_steps", "playbook_all_steps",
    "playbook_substrings",
    "finding_playbooks", "scored_findings", "ip_iocs", "user_iocs", "host_iocs", "service_iocs",
]
NEEDS = {
    "keyword_findings": ["log_events", "keyword_rules"], "row_findings": ["log_events", "keyword_findings"],
    "anomaly_findings": ["log_events"], "findings": ["row_findings", "anomaly_findings"],
    "pattern_counts": ["log_events"], "pattern_counts_by_host": ["log_events"],
    "suspicious_patterns": ["pattern_counts"], "mapped": ["findings", "finding_techniques", "techniques", "tactics"],
    "finding_playbooks": ["findings", "playbook_substrings"], "scored_findings": ["findings"],
    "ip_iocs": ["log_events"], "user_iocs": ["log_events"], "host_iocs": ["log_events"],
    "service_iocs": ["log_events"],
}


def closure(names) -> set[str]:
    """The named views and all they read."""
    seen: set[str] = set()
    todo = list(names)
    while todo:
        name = todo.pop()
        if name not in seen:
            seen.add(name)
            todo.extend(NEEDS.get(name, []))
    return seen
