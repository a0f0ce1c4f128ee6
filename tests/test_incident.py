"""The nine-line incident, with results worked out by hand from the formulas."""

from trailhound.operators import aggregates, chains, detect, iocs, mitre, normalize, playbooks, scoring, timeline


def rows(df, *columns):
    return {tuple(r[c] for c in columns) for r in df.collect()}


def test_severity_counts(incident):
    assert rows(aggregates.ranked_counts(incident, "severity"), "severity", "n") == {
        ("EMERGENCY", 2), ("CRITICAL", 3), ("HIGH", 3), ("INFO", 1)}


def test_high_severity_anomalies(incident):
    found = detect.high_severity_anomalies(detect.severity_profile(incident))
    assert rows(found, "finding_type", "severity") == {
        ("high_severity_emergency_events", "CRITICAL"), ("high_severity_critical_events", "CRITICAL"),
        ("high_severity_high_events", "HIGH")}


def test_keywords(incident):
    counts = detect.row_findings(incident, detect.keyword_hits).groupBy("finding_type").count()
    assert rows(counts, "finding_type", "count") == {
        ("excessive_login_failures", 1), ("account_lockout", 1), ("privilege_escalation", 2), ("ransomware", 3),
        ("unauthorized_access", 1), ("suspicious_activity", 1)}


def test_authentication_failures(incident):
    assert detect.row_findings(incident, detect.auth_fail_hits).count() == 2
    groups = detect.group_profile(detect.severity_profile(incident))
    assert detect.brute_force_anomaly(groups).count() == 0
    assert detect.off_hours_anomaly(groups).count() == 0


def test_finding_severities(incident):
    got = aggregates.finding_severity_counts(detect.detect_all(incident)).first().asDict()
    assert got == {
        "critical_count": 7, "high_count": 7, "medium_count": 0, "low_count": 0, "total_findings": 14}


def test_detector_score_by_age(incident):
    profile = detect.severity_profile(incident)
    for as_of, score in [
        ("2026-06-05 09:30:00", 53), ("2026-06-05 20:00:00", 50), ("2026-06-08 00:00:00", 46),
        ("2026-07-05 00:00:00", 43),
    ]:
        row = scoring.detector_score(profile, as_of).first()
        assert (row["severity_score"], row["risk_score"]) == (17.625, score)


def test_patterns_and_chain(incident):
    counts = detect.pattern_counts(incident)
    assert rows(detect.suspicious_patterns(counts), "pattern", "n", "significance") == {
        ("privilege_escalation", 2, "HIGH"), ("database_availability", 2, "HIGH"),
        ("ransomware_indicators", 2, "CRITICAL")}
    assert rows(chains.correlations(counts), "correlation") == {("privilege_escalation_to_ransomware",)}
    chain = chains.attack_chain(counts).first()
    assert chain["confidence"] == 95
    assert chain["techniques"] == ["T1068", "T1547", "T1499", "T1486"]
    assert chains.classify(counts).first()["incident_type"] == "RANSOMWARE ATTACK"


def test_investigation_scores(incident):
    counts = scoring.evidence_counts(incident)
    agent = scoring.agent_score(counts).first()
    assert (agent["overall_risk"], agent["risk_level"]) == (88, "CRITICAL")
    confidence = scoring.confidence_scores(counts).first()
    assert (confidence["overall_confidence"], confidence["ioc_confidence"], confidence["root_cause_confidence"]) == (
        85, 80, 85)
    evidence = scoring.evidence_score(counts).first()
    assert (evidence["confidence"], evidence["confidence_level"]) == (77, "MEDIUM-HIGH")


def test_phases(incident):
    for ranges in (1, 3, 9):
        got = timeline.attack_phases(incident, ranges=ranges).orderBy("ts").collect()
        assert [r["phase"] for r in got] == [
            "recon", "privilege_escalation", "privilege_escalation", "privilege_escalation", "impact",
            "privilege_escalation", "privilege_escalation", "impact", "impact"]


def test_indicators(incident):
    found = iocs.extract(incident, ["ip", "host", "user"])
    assert rows(found, "kind", "value") == {
        ("ip", "185.44.10.7"), ("host", "db-prod-01"), ("host", "finance-server-02"), ("user", "admin"),
        ("user", "svc-reports")}


def test_mapping_and_plan(incident):
    findings = detect.detect_all(incident)
    mapped = mitre.map_findings(findings)
    assert ("privilege_escalation", "T1068") in rows(mapped, "mapped_as", "technique_id")
    assert ("high_risk_commands", "Unknown") in rows(mapped, "mapped_as", "technique_id")
    plan = playbooks.response_plan(findings).collect()
    assert plan[0]["severity"] == "CRITICAL"
    assert {r["playbook_id"] for r in plan if r["finding_type"] == "ransomware"} == {"SOC-IR-006"}
    assert {r["response_minutes"] for r in plan if r["playbook_id"] == "SOC-IR-006"} == {10}


def test_profile(incident):
    got = normalize.profile(incident, ["severity", "source"]).first()
    assert (got["total_rows"], got["unique_severity"], got["unique_source"]) == (9, 4, 3)
