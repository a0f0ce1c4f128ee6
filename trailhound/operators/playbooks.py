"""Response playbooks: look-ups, summaries and response plans for findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from trailhound import fixed_values as V
from trailhound import playbook_values as P
from trailhound.functions.lookup import look_up, rows_where
from trailhound.session import constant_table


def playbook_table(spark: SparkSession) -> DataFrame:
    """Playbooks with nested steps: a fixed table of this package, small enough to broadcast by construction."""
    steps: dict[str, list[dict]] = {}
    for key, step, action, command, platform, time in P.CONTAINMENT_STEPS:
        steps.setdefault(key, []).append({
            "step": step, "action": action, "command": command, "platform": platform, "estimated_time": time,
            "alternative": P.STEP_ALTERNATIVES.get((key, step))})
    follow = {key: rest for key, *rest in P.FOLLOW_UP_STEPS}
    rows = [
        (rank, *book, steps[book[0]], *follow[book[0]]) for rank, book in enumerate(P.PLAYBOOKS, 1)]
    return constant_table(
        spark, ["playbook_rank", "playbook", "playbook_id", "title", "playbook_severity", "mitre_tactic",
                "mitre_technique", "detection_method", "verification", "containment_steps", "eradication_steps",
                "recovery_steps", "post_incident_actions"], rows)


def playbook_key(finding_type: Column) -> Column:
    """Playbook of a finding type: the first listed substring it holds, else the generic one."""
    lowered = F.lower(finding_type)
    result = None
    for part, book in V.PLAYBOOK_SUBSTRINGS:
        test = lowered.contains(part)
        result = F.when(test, F.lit(book)) if result is None else result.when(test, F.lit(book))
    return result.otherwise(F.lit(V.DEFAULT_PLAYBOOK))


def findings_by_playbook(findings: DataFrame) -> DataFrame:
    return findings.groupBy(playbook_key(F.col("finding_type")).alias("playbook")).agg(
        rows_where(findings).alias("n_findings"))


def look_up_playbooks(findings: DataFrame) -> DataFrame:
    """Playbook of every finding type that is itself a playbook name."""
    books = playbook_table(findings.sparkSession)
    kinds = findings.groupBy(F.col("finding_type").alias("playbook")).agg(rows_where(findings).alias("n_findings"))
    return kinds.join(F.broadcast(books), "playbook")


def all_playbooks(findings: DataFrame) -> DataFrame:
    """Every playbook with the number of findings that lead to it."""
    books = playbook_table(findings.sparkSession)
    return books.join(F.broadcast(findings_by_playbook(findings)), "playbook", "left").withColumn(
        "n_findings", F.coalesce("n_findings", F.lit(0)))


def by_severity(findings: DataFrame, severity: str) -> DataFrame:
    return all_playbooks(findings).filter(F.col("playbook_severity") == severity)


def by_technique(ids: DataFrame) -> DataFrame:
    """First playbook whose technique text contains a technique id, for each id of a frame.

    The few playbooks are an array literal searched inside the projection, so no theta join is planned.
    """
    books = F.array(*[F.struct(F.lit(b[5]).alias("text"), F.lit(b[0]).alias("playbook")) for b in P.PLAYBOOKS])
    hits = F.filter(books, lambda b: b["text"].contains(F.col("technique_id")))
    return ids.select("technique_id").distinct().withColumn("playbook", F.get(hits, 0)["playbook"])


def minutes(steps: Column) -> Column:
    """Sum over the steps of the first number in their estimated time."""
    each = F.transform(steps, lambda s: F.coalesce(
        F.nullif(F.regexp_extract(s["estimated_time"], r"\d+", 0), F.lit("")).cast("int"), F.lit(0)))
    return F.aggregate(each, F.lit(0), lambda a, b: a + b)


def duration_text(total: Column) -> Column:
    hours = F.floor(total / 60).cast("string")
    return F.when(total < 60, F.concat(total.cast("string"), F.lit(" minutes"))).otherwise(
        F.concat(hours, F.lit(" hours "), (total % 60).cast("string"), F.lit(" minutes")))


def summaries(books: DataFrame) -> DataFrame:
    total = minutes(F.col("containment_steps"))
    return books.select(
        "playbook", "playbook_id", "title", F.col("playbook_severity").alias("severity"), "mitre_tactic",
        "mitre_technique", F.size("containment_steps").cast("bigint").alias("total_containment_steps"),
        total.cast("bigint").alias("response_minutes"), duration_text(total).alias("estimated_response_time"))


def steps(books: DataFrame) -> DataFrame:
    """Containment, eradication and recovery steps as rows; only containment steps have more than an action."""
    details = ["action", "command", "platform", "estimated_time", "alternative"]

    def entry(part: str, step: Column, texts: dict[str, Column]) -> Column:
        none = F.lit(None).cast("string")
        return F.struct(F.lit(part).alias("part"), step.cast("bigint").alias("step"),
                        *[texts.get(c, none).cast("string").alias(c) for c in details])

    rows = [F.transform("containment_steps", lambda s: entry("containment", s["step"], {c: s[c] for c in details}))]
    for part in ("eradication", "recovery"):
        rows.append(F.transform(f"{part}_steps", lambda a, i: entry(part, i + 1, {"action": a})))  # noqa: B023
    return books.select("playbook", F.explode(F.concat(*rows)).alias("_s")).select("playbook", "_s.*")


def first_steps(books: DataFrame) -> DataFrame:
    first = F.element_at("containment_steps", 1)
    return books.select(
        "playbook", "title", "playbook_severity", first["action"].alias("action"),
        first["command"].alias("command"))


def response_plan(findings: DataFrame) -> DataFrame:
    """Findings by severity (unknown ones last) with playbook, first critical action and response time.

    Findings of one type and severity share a plan entry, so the plan has a few rows for any input size.
    """
    rank = look_up(F.coalesce("severity", F.lit("LOW")), V.PLAN_SEVERITY_ORDER, 5)
    kinds = findings.groupBy("finding_type", "severity").agg(rows_where(findings).alias("n_findings"))
    books = playbook_table(findings.sparkSession)
    first = F.element_at("containment_steps", 1)
    urgent = F.col("playbook_severity").isin(V.CRITICAL_PLAYBOOK_SEVERITIES)
    plan = kinds.withColumn("playbook", playbook_key(F.col("finding_type"))).join(F.broadcast(books), "playbook")
    return plan.select(
        rank.cast("bigint").alias("priority"), "finding_type",
        F.coalesce("severity", F.lit("MEDIUM")).alias("severity"), "n_findings", "playbook_id",
        F.col("title").alias("playbook_title"), F.when(urgent, first["action"]).alias("critical_action"),
        F.when(urgent, first["command"]).alias("critical_command"),
        minutes(F.col("containment_steps")).cast("bigint").alias("response_minutes"),
    ).orderBy("priority", "finding_type")


def plan_time(plan: DataFrame) -> DataFrame:
    """Total response time of a plan, each playbook run once."""
    once = plan.select("playbook_id", "response_minutes").distinct()
    total = F.coalesce(F.sum("response_minutes"), F.lit(0))
    return once.agg(total.alias("total_minutes")).withColumn("estimated_total_time", duration_text(F.col("total_minutes")))


def dashboard_playbooks(findings: DataFrame, n: int = 2) -> DataFrame:
    """Playbooks the dashboard shows: the first ones whose list is long enough."""
    counts = findings.groupBy("list_name").agg(rows_where(findings).alias("n"))
    rules = constant_table(
        findings.sparkSession, ["list_name", "above", "playbook", "rank"],
        [(*r, i) for i, r in enumerate(V.DASHBOARD_PLAYBOOKS, 1)])
    return rules.join(F.broadcast(counts), "list_name").filter("n > above").orderBy("rank").limit(n).select(
        "playbook", "list_name", F.col("n").alias("n_findings"))


def markdown(books: DataFrame) -> DataFrame:
    """Each playbook as one Markdown text."""
    def bullets(name: str) -> Column:
        return F.array_join(F.transform(F.col(name), lambda s: F.concat(F.lit("- "), s)), "\n")

    actions = F.array_join(F.transform("containment_steps", lambda s: F.concat(
        F.lit("\n### Step "), s["step"].cast("string"), F.lit(": "), s["action"], F.lit("\n- **Command:** `"),
        s["command"], F.lit("`\n- **Platform:** "), s["platform"], F.lit("\n- **Estimated Time:** "),
        s["estimated_time"])), "\n")
    text = F.concat_ws(
        "\n", F.concat(F.lit("# "), "title"), F.lit(""), F.lit("## Incident Response Playbook"),
        F.concat(F.lit("- **ID:** "), "playbook_id"), F.concat(F.lit("- **Severity:** "), "playbook_severity"),
        F.concat(F.lit("- **MITRE Tactic:** "), "mitre_tactic"),
        F.concat(F.lit("- **MITRE Technique:** "), "mitre_technique"),
        F.concat(F.lit("- **Detection Method:** "), "detection_method"),
        F.lit("\n## Containment Steps"), actions, F.lit("\n## Eradication Steps"), bullets("eradication_steps"),
        F.lit("\n## Recovery Steps"), bullets("recovery_steps"), F.lit("\n## Verification"), "verification")
    return books.select("playbook", text.alias("markdown"))
