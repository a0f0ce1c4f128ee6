"""User rules as a table: ``rule_id``, ``category``, ``pattern``, ``severity``.

A pattern is plain text that the lower-cased message must hold, or, with ``.*`` in it, a regular expression without regard to case, as in the built-in
lists. Rules are not tried on every row: each has an anchor, three characters that every hit must hold, and rows
meet only the rules whose anchor they hold, by an equi-join. Before the join a bit map of all anchors, of fixed size whatever
the number of rules, drops the rows' other characters inside the scan stage. Rules without three plain
characters in a row have the empty anchor, which every row holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailhound.functions.bits import bit_map, may_hold
from trailhound.session import store

GRAM = 3
#: Bits of the map of anchors.
SLOTS = 1 << 16
#: What is not plain text in a regular expression; runs of anything else may hold an anchor.
NOT_PLAIN = r"(?:\\.|\[[^\]]*\]|.)(?:[*?+]|\{[^}]*\})[?+]?|\\.|\[[^\]]*\]|[.^$]"


def _grams(text: Column) -> Column:
    """All strings of ``GRAM`` characters, overlaps included, in one pass."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))


def _usable(rules: DataFrame) -> DataFrame:
    return rules.filter(F.col("pattern").isNotNull() & (F.col("pattern") != "")).select(
        "rule_id", "category", "severity", "pattern").distinct()


def anchored(rules: DataFrame) -> DataFrame:
    """The rules with the lower-cased pattern, whether it is an expression, and its anchor: the one fewest rules hold."""
    lowered = F.lower("pattern")
    expression = F.col("pattern").contains(".*")
    # in a group or an alternative no part of an expression is certain
    plain = F.when(~expression, F.array(lowered)).when(lowered.rlike("[|(]"), F.array(F.lit(""))).otherwise(
        F.split(F.regexp_replace(lowered, NOT_PLAIN, "\x00"), "\x00"))
    known = _usable(rules).select(
        "rule_id", "category", "severity", "pattern", expression.alias("is_expression"),
        F.flatten(F.transform(plain, _grams)).alias("_grams"))
    each = known.select("rule_id", "pattern", F.explode(F.array_distinct("_grams")).alias("anchor"))
    common = each.groupBy("anchor").agg(F.count(F.lit(1)).alias("_n"))
    best = each.join(common, "anchor").groupBy("rule_id", "pattern").agg(F.min(F.struct("_n", "anchor"))["anchor"].alias("anchor"))
    return known.drop("_grams").join(best, ["rule_id", "pattern"], "left").withColumn("anchor", F.coalesce("anchor", F.lit("")))


def rule_findings(df: DataFrame, rules: DataFrame, text: str = "raw_log") -> DataFrame:
    """A finding for each row and rule that hits, in the shape of the built-in findings, with ``matched`` the rule's id.

    The category is finding type and list. Rules with a null or empty pattern never hit; repeated rules count once.
    The rules and their anchors are written to the shared folder first: whatever makes the rules runs once, and the plan of the
    findings starts from a table of known size. That table stays until the run's folder is removed.
    """
    listed = store(_usable(rules), "rules")
    known = store(anchored(listed.rows), "anchors").rows
    listed.remove()
    bits, lowered = bit_map(known, "anchor", SLOTS), F.lower(F.col(text))
    columns = ["event_id", "ts", "user_name", "source_ip", "host"]
    rows = df.select(*columns, F.col(text).alias("_text"), lowered.alias("_lower"))
    grams = F.concat(F.array(F.lit("")), F.filter(_grams(F.col("_lower")), lambda g: may_hold(bits, g, SLOTS)))
    near = rows.select("*", F.explode(grams).alias("anchor")).join(known, "anchor")
    hit = F.when(F.col("is_expression"), F.expr("rlike(_text, concat('(?i)', pattern))")).otherwise(
        F.contains(F.col("_lower"), F.lower("pattern")))
    return near.filter(hit).select(
        F.col("category").alias("finding_type"), F.col("category").alias("list_name"), "severity", *columns,
        F.substr("_text", F.lit(1), F.lit(200)).alias("details"), F.lit(None).cast("double").alias("metric"),
        F.col("rule_id").alias("matched"))
