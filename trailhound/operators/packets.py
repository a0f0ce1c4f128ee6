"""Packet features, detectors and traffic summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailhound import fixed_values as V
from trailhound.functions.lookup import count_where
from trailhound.functions.text import contains_any
from trailhound.operators.distinct import ROWS, exact_counts, value_table
from trailhound.operators.aggregates import ranked_counts

SYN = 2
ACK = 16
RST = 4


def has_bit(flags: Column, bit: int) -> Column:
    return F.coalesce(flags.bitwiseAND(F.lit(bit)) > 0, F.lit(False))


def tcp_flags(flags: Column) -> Column:
    """Flag letters in bit order; no bits give ``None`` as text, no TCP gives null."""
    letters = F.concat(*[F.when(has_bit(flags, b), F.lit(c)).otherwise(F.lit("")) for b, c in V.TCP_FLAG_BITS])
    return F.when(flags.isNotNull(), F.coalesce(F.nullif(letters, F.lit("")), F.lit("None")))


def with_tcp_flags(df: DataFrame) -> DataFrame:
    return df.withColumn("tcp_flags", tcp_flags(F.col("tcp_flags_int")))


def payload_preview(payload: Column) -> Column:
    """The first 100 bytes as lower-case hex."""
    return F.lower(F.hex(F.substring(payload.cast("binary"), 1, 100)))


def suspicious_flags(payload: str | None = None) -> Column:
    """Tags of a packet as an array. Query names lose the trailing dot before the suffix test."""
    flags, port = F.col("tcp_flags_int"), F.col("dst_port")
    name = F.rtrim(F.col("dns_query"), F.lit("."))
    agent = F.lower("http_user_agent")
    tags = [
        F.when(has_bit(flags, SYN) & ~has_bit(flags, ACK), F.lit("syn_scan")),
        F.when(has_bit(flags, RST), F.lit("rst_packet")),
        F.when(F.col("icmp_type").isin(V.SUSPICIOUS_ICMP_TYPES), F.lit("suspicious_icmp")),
        *[F.when(name.endswith(t), F.lit(f"dns_suspicious_tld_{t}")) for t in V.SUSPICIOUS_TLDS],
        *[F.when(agent.contains(a), F.lit(f"suspicious_ua_{a}")) for a in V.SUSPICIOUS_AGENTS],
    ]
    if payload is not None:
        text = F.lower(F.col(payload))
        tags.append(F.when(contains_any(text, ["base64", "powershell"]), F.lit("encoded_payload")))
        tags.append(F.when(contains_any(text, ["eval(", "exec("]), F.lit("code_execution")))
    tags.append(F.when(port.isin(V.SUSPICIOUS_PORTS), F.concat(F.lit("suspicious_port_"), port.cast("string"))))
    joined = F.concat_ws("|", *tags)
    return F.when(joined != "", F.split(joined, r"\|")).otherwise(F.array().cast("array<string>"))


def with_suspicious_flags(df: DataFrame, payload: str | None = None) -> DataFrame:
    return df.withColumn("suspicious_flags", suspicious_flags(payload))


def protocol_counts(df: DataFrame) -> DataFrame:
    return ranked_counts(df, "protocol", name="packets")


def connections(df: DataFrame, limit: int | None = None) -> DataFrame:
    return ranked_counts(df, "src_ip", "dst_ip", name="packet_count", limit=limit)


def top_talkers(df: DataFrame, n: int = 10) -> DataFrame:
    """Top senders and top receivers."""
    sent = ranked_counts(df, "src_ip", name="packets", limit=n).select(
        F.lit("sent").alias("direction"), F.col("src_ip").alias("ip_address"), "packets")
    received = ranked_counts(df, "dst_ip", name="packets", limit=n).select(
        F.lit("received").alias("direction"), F.col("dst_ip").alias("ip_address"), "packets")
    return sent.unionByName(received)


def summary(df: DataFrame) -> DataFrame:
    kinds = {"unique_src_ips": F.col("src_ip"), "unique_dst_ips": F.col("dst_ip"), "n_protocols": F.col("protocol")}
    counts = exact_counts(value_table(df, kinds), list(kinds), [ROWS]).withColumnRenamed(ROWS, "total_packets")
    span = df.agg(F.min("ts_s").alias("first_s"), F.max("ts_s").alias("last_s"))
    return counts.withColumns({c: span.select(c).scalar() for c in ("first_s", "last_s")})


def suspicious_ports(df: DataFrame) -> DataFrame:
    return df.filter(F.col("dst_port").isin(V.SUSPICIOUS_PORTS))


def _anomaly(df: DataFrame, kind: str, severity: str, metric: Column, details: Column, **extra: Column) -> DataFrame:
    return df.select(
        F.lit(kind).alias("finding_type"), F.lit("anomalies").alias("list_name"),
        F.lit(severity).alias("severity"), extra.get("source_ip", F.lit(None).cast("string")).alias("source_ip"),
        details.alias("details"), metric.cast("double").alias("metric"))


def port_scans(df: DataFrame, minimum: int = V.PORT_SCAN_MIN) -> DataFrame:
    """Sources with more SYN-bearing packets than the threshold."""
    counts = (
        df.filter(has_bit(F.col("tcp_flags_int"), SYN) & F.col("src_ip").isNotNull())
        .groupBy("src_ip").agg(F.count(F.lit(1)).alias("syn_packets")).filter(F.col("syn_packets") > minimum))
    text = F.concat(
        F.lit("Potential port scan detected from "), F.col("src_ip"), F.lit(" with "),
        F.col("syn_packets").cast("string"), F.lit(" SYN packets"))
    return _anomaly(counts, "port_scan", "HIGH", F.col("syn_packets"), text, source_ip=F.col("src_ip"))


def traffic_profile(df: DataFrame) -> DataFrame:
    """Everything the whole-capture detectors need, in one aggregate of one row."""
    name = F.lower("dns_query")
    tld = contains_any(name, V.SUSPICIOUS_TLDS)
    return df.agg(
        F.count(F.lit(1)).alias("n"), F.count("ts_s").alias("n_timed"),
        (F.max("ts_s") - F.min("ts_s")).alias("span"),
        count_where(F.col("protocol") == "ICMP").alias("n_icmp"),
        count_where(F.col("length") > V.LARGE_PACKET).alias("n_large"), count_where(tld).alias("n_dns"))


def flood(profile: DataFrame, rate: float = V.DDOS_RATE) -> DataFrame:
    per_second = F.col("n_timed") / F.col("span")
    hits = profile.filter((F.col("n_timed") > 1) & (F.col("span") > 0)).withColumn("rate", per_second)
    text = F.concat(F.lit("High packet rate detected: "), F.round("rate", 0).cast("bigint").cast("string"),
                    F.lit(" packets/sec"))
    return _anomaly(hits.filter(F.col("rate") > rate), "ddos", "CRITICAL", F.round("rate", 6), text)


def flood_seconds(df: DataFrame, rate: int = V.DDOS_RATE) -> DataFrame:
    """Variant: one-second windows with more packets than the rate."""
    return (
        df.filter(F.col("ts_s").isNotNull()).groupBy(F.floor("ts_s").cast("bigint").alias("second"))
        .agg(F.count(F.lit(1)).alias("packets")).filter(F.col("packets") > rate))


def icmp_storm(profile: DataFrame, share: float = V.ICMP_SHARE) -> DataFrame:
    n = F.col("n_icmp")
    return _anomaly(profile.filter(n > F.col("n") * F.lit(share)), "icmp_storm", "MEDIUM", n,
                    F.concat(F.lit("Unusual ICMP activity: "), n.cast("string"), F.lit(" packets")))


def large_packets(profile: DataFrame, share: float = V.LARGE_SHARE) -> DataFrame:
    n = F.col("n_large")
    return _anomaly(profile.filter(n > F.col("n") * F.lit(share)), "potential_exfiltration", "HIGH", n,
                    F.lit("Many large packets detected - potential data exfiltration"))


def suspicious_dns(df: DataFrame, examples: int = 5) -> DataFrame:
    """Queries that hold a suspicious top-level domain, with example names.

    Names are counted first, so the example list is cut from one row per name rather than from all packets.
    """
    name = F.lower("dns_query")
    names = (
        df.filter(contains_any(name, V.SUSPICIOUS_TLDS)).groupBy("dns_query")
        .agg(F.count(F.lit(1)).alias("n")))
    first = names.orderBy("dns_query").limit(examples).select(
        F.lit(0).cast("bigint").alias("n"), F.col("dns_query").alias("example"))
    together = names.select("n", F.lit(None).cast("string").alias("example")).unionByName(first)
    folded = together.agg(F.sum("n").alias("n"), F.array_sort(F.collect_list("example")).alias("ex"))
    text = F.concat(F.lit("DNS queries to suspicious TLDs detected: "), F.array_join("ex", ", "))
    return _anomaly(folded.filter("n > 0"), "suspicious_dns", "MEDIUM", F.col("n"), text)


def detect_all(df: DataFrame) -> DataFrame:
    profile = traffic_profile(df)
    return (
        port_scans(df).unionByName(flood(profile)).unionByName(icmp_storm(profile))
        .unionByName(large_packets(profile)).unionByName(suspicious_dns(df)))
