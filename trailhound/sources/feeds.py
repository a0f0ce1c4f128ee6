"""Indicator feeds and packet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKET_SCHEMA = (
    "packet_id bigint, ts_s double, src_ip string, dst_ip string, protocol string, src_port int, dst_port int, "
    "tcp_flags_int int, icmp_type int, dns_query string, http_user_agent string, length int")


def read_feed(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """One indicator per non-blank line."""
    return spark.read.text(path).select(F.trim("value").alias("indicator"), F.lit(kind).alias("kind")).filter(
        "indicator <> ''")


def read_packets(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Decoded packet rows from Parquet or CSV."""
    reader = spark.read.schema(PACKET_SCHEMA)
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.parquet(path)
