"""Queries: user rules, mergeable distinct counts, exact top-k by candidates, partitioned stores that can be run again."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailhound import fixed_values as V
from trailhound.operators import aggregates as A
from trailhound.operators import detect as D
from trailhound.operators import distinct as X
from trailhound.operators import joins as J
from trailhound.operators import registry as R
from trailhound.plans.fixtures import table, view
from trailhound.plans.oracle_views import in_list
from trailhound.plans.q_core import COLS, LE, SHOWN, events
from trailhound.plans.registry import query
from trailhound.session import store

# a thousand rules made from the data's own numbers: users, hosts, addresses, and messages
RULES_SQL = """
select 'user-' || lpad(cast(i as string), 4, '0') as rule_id, 'watched_user' as category, 'User=user' || cast(i as string) || ' ' as pattern, 'HIGH' as severity
from (select distinct user_id as i from events where user_id < 700) u
union all select 'addr-' || cast(i as string), 'watched_network', '=185.' || cast(44 + i % 5 as string) || '.' || cast(i as string) || '.', 'MEDIUM'
from (select distinct user_id % 200 as i from events) a
union all select 'pair-' || cast(i as string), 'watched_pair', 'lockout.*host=srv-' || cast(i as string), 'CRITICAL'
from (select distinct user_id % 12 as i from events) h
union all select 'type-' || event_type, 'watched_type', event_type, 'LOW' from (select distinct event_type from events) t
union all select 'short', 'watched_short', '-1', 'LOW' from (select distinct 1 as i from events) s
union all select 'none', 'watched_none', cast(null as string), 'LOW' from (select distinct 1 as i from events) s"""


def rules(spark, d):
    return spark.sql(RULES_SQL.replace("from events", "from {events}"), events=table(spark, d, "events"))


@query("det_rules", f"""
select r.rule_id as matched, r.category as finding_type, r.severity, e.event_id, e.host, substr(e.raw_log, 1, 200) as details
from log_events e join ({RULES_SQL}) r on case when contains(r.pattern, '.*') then regexp_matches(e.raw_log, '(?i)' || r.pattern)
 else contains(lower(e.raw_log), lower(r.pattern)) end""", LE)
def det_rules(spark, d):
    return R.rule_findings(events(spark, d), rules(spark, d)).select("matched", "finding_type", "severity", "event_id", "host", "details")


@query("det_ioc_large_feed", """
select event_id, source_ip as matched, substr(raw_log, 1, 200) as details from log_events
where source_ip in (select indicator from ioc_feed)""", ("log_events", "ioc_feed"))
def det_ioc_large_feed(spark, d):
    found = D.ioc_matches(events(spark, d), view(spark, d, "ioc_feed"), slots=J.FEED_SLOTS)
    return found.select("event_id", "matched", "details")


@query("jn_ioc_large_feed", f"select {COLS} from log_events where source_ip in (select indicator from ioc_feed where kind = 'ip')",
       ("log_events", "ioc_feed"))
def jn_ioc_large_feed(spark, d):
    return J.in_large_feed(events(spark, d).select(*SHOWN), view(spark, d, "ioc_feed"))


# --- distinct counts and top-k ------------------------------------------------------------------

def _high():
    return F.col("severity").isin(V.DASHBOARD_HIGH_SEVERITIES)


@query("agg_distinct_days", f"""
select d as day, count(distinct source_ip) as ips, count(distinct user_name) as users, count(*) as rows,
 count(distinct source_ip) filter (where severity in {in_list(V.DASHBOARD_HIGH_SEVERITIES)}) as high_ips
from (select *, cast(ts as date) as d from log_events union all select *, null from log_events) e group by 1""", LE)
def agg_distinct_days(spark, d):
    """A table of entries by day, stored, and both each day's counts and those of all days from it."""
    e = events(spark, d).withColumn("day", F.to_date("ts"))
    high = F.when(_high(), F.col("source_ip"))
    by_day = store(X.value_table(e, {"ips": F.col("source_ip"), "users": F.col("user_name"), "high_ips": high}, keys=("day",)), "values").rows
    each = X.exact_counts(by_day, ["ips", "users", "high_ips"], ["rows"], ("day",))
    every = X.exact_counts(X.merged_values(by_day), ["ips", "users", "high_ips"], ["rows"])
    return each.unionByName(every.withColumn("day", F.lit(None).cast("date")))


@query("agg_distinct_sketch", """
select kind, n, true as within_3_percent from (
 select 'ips' as kind, count(distinct source_ip) as n from log_events union all select 'users', count(distinct user_name) from log_events
 union all select 'events', count(distinct event_id) from log_events) x""", LE)
def agg_distinct_sketch(spark, d):
    """Sketches by day merged into one for the whole span, against the exact counts."""
    e = events(spark, d).withColumn("day", F.to_date("ts"))
    values = {"ips": F.col("source_ip"), "users": F.col("user_name"), "events": F.col("event_id")}
    by_day = store(X.sketches(e, values, ("day",)), "sketches").rows
    near = X.estimates(by_day, list(values))
    exact = X.exact_counts(X.value_table(e, values), list(values))
    parts = [F.struct(F.lit(k).alias("kind"), F.col(k).alias("n"), near.select(k).scalar().alias("near")) for k in values]
    return exact.select(F.explode(F.array(*parts)).alias("x")).select(
        "x.kind", "x.n", (F.abs(F.col("x.near") - F.col("x.n")) <= 0.03 * F.col("x.n")).alias("within_3_percent"))


@query("agg_terms_by_candidates", rf"""
select term, count(*) as n from (select unnest(regexp_split_to_array(lower(text), '\W+')) as term from documents) w
where term <> '' and term not in {in_list(V.STOP_WORDS)} group by term order by n desc, term limit 50""")
def agg_terms_by_candidates(spark, d):
    return X.exact_top(A.terms(table(spark, d, "documents")), "term", 50).rows


@query("agg_talkers_by_candidates", """
select * from (select 'sent' as direction, src_ip as ip_address, count(*) as packets from packets group by src_ip order by 3 desc, 2 limit 10) s
union all
select * from (select 'received', dst_ip, count(*) from packets group by dst_ip order by 3 desc, 2 limit 10) r""", ("packets",))
def agg_talkers_by_candidates(spark, d):
    packets = view(spark, d, "packets")
    top = lambda column, name: X.exact_top(packets, column, 10).rows.select(
        F.lit(name).alias("direction"), F.col(column).alias("ip_address"), F.col("n").alias("packets"))
    return top("src_ip", "sent").unionByName(top("dst_ip", "received"))
