"""Sharding by a two-pass external shuffle, in DataFrame functions only.

Pass one scatters whole rows into buckets of bounded size by seeded draws, so that also rows that are all alike spread over all
buckets of their shard; pass two gathers each bucket, permutes it with ``shuffle`` (Spark's seeded Fisher-Yates over an array) and writes it
to its shard's folder. A row's shard follows from its key and the shard count alone: of all shards, the one whose seeded hash with
the key is largest. With one more shard, a row either stays or moves to the new one. A row's slot is its place in its
bucket and the rows in the buckets before, counted in what was written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from trailhound.llm.common import table
from trailhound.session import scratch_path

SEED = 20_731
#: Bytes of rows that one bucket holds on average; a bucket is gathered in one task.
BUCKET_BYTES = 8 << 20


def shard_of(key: str, shards: int, seed: int = SEED) -> Column:
    """The shard whose seeded hash with the key is the largest. A null key is a key like any other."""
    draws = [F.struct(F.xxhash64(F.lit(seed), F.col(key), F.lit(k)).alias("draw"), F.lit(k).alias("shard"))
             for k in range(shards)]
    return F.array_max(F.array(*draws))["shard"]


def shuffled(df: DataFrame, key: str, size: Column, shards: int = 16, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``shard``, ``grown_shard``, ``bucket``, ``place`` (in the bucket, after its permutation) and ``row`` (all columns of ``df``).

    ``size`` gives a row's bytes, from which the number of buckets follows. Draws and permutations are seeded and go by the
    rows' places in the input's partitions: the same input, read the same way, gives the same order, another partitioning another.
    """
    total = df.agg(F.sum(size).alias("n")).first()["n"] or 0
    buckets = max(1, -(-int(total) // (bucket_bytes * shards)))
    scattered = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{key}`").alias("key")).select(
        "row", shard_of("key", shards, seed).alias("shard"), shard_of("key", shards + 1, seed).alias("grown_shard"),
        F.floor(F.rand(seed) * buckets).cast("int").alias("bucket"), F.monotonically_increasing_id().alias("mark"))
    gathered = scattered.groupBy("shard", "bucket").agg(F.collect_list(F.struct("mark", "grown_shard", "row")).alias("rows"))
    # from one order, whatever the order of arrival, so that a bucket that is gathered again is permuted alike
    settled = F.array_sort("rows", lambda a, b: F.when(a["mark"] < b["mark"], -1).when(a["mark"] > b["mark"], 1).otherwise(0))
    permuted = gathered.select("shard", "bucket", F.shuffle(settled, F.lit(seed + 2)).alias("rows"))
    return permuted.select("shard", "bucket", F.posexplode("rows").alias("place", "entry")).select(
        "shard", "entry.grown_shard", "bucket", "place", "entry.row")


def write_shards(df: DataFrame, path: str, key: str, size: Column, **settings) -> None:
    """Shuffle the whole rows and write them as one folder per shard; within a file rows stand in slot order."""
    out = shuffled(df, key, size, **settings)
    out.sortWithinPartitions("shard", "bucket", "place").write.partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str, row: StructType) -> DataFrame:
    """What :func:`write_shards` wrote, with ``slot`` (gapless from 0 in each shard); ``row``: the schema of the rows."""
    schema = StructType([StructField("grown_shard", IntegerType()), StructField("bucket", IntegerType()), StructField("place", IntegerType()),
                         StructField("row", row), StructField("shard", IntegerType())])
    rows = spark.read.schema(schema).parquet(path)
    within = Window.partitionBy("shard").orderBy("bucket")
    before = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n")).select(
        "shard", "bucket", (F.sum("n").over(within) - F.col("n")).alias("before"))
    # a row for each bucket of some megabytes: broadcast, so that the written rows don't move again
    return rows.join(F.broadcast(before), ["shard", "bucket"]).select(
        "row", "shard", "bucket", (F.col("before") + F.col("place")).alias("slot"), "grown_shard")


def shuffle_into_shards(df: DataFrame, key: str, size: Column, **settings) -> DataFrame:
    """``row`` (all columns of ``df``, whatever their names), ``shard``, ``bucket``, ``slot`` and ``grown_shard``, by way of written shards.

    A null key is a key like any other. Repeated rows keep a slot each; an empty table gives an empty table.
    """
    path = scratch_path(df.sparkSession, "shards")
    write_shards(df, path, key, size, **settings)
    return read_shards(df.sparkSession, path, df.schema)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``, whole rows, in 16 shards under the ``key`` law; null text has no bytes. Figures are those of the written texts."""
    def data(text: str) -> Column:
        return F.coalesce(F.col(text), F.lit("")).cast("binary")

    out = shuffle_into_shards(table(spark, sf_dir, "documents"), "doc_id", F.octet_length(data("text")) + F.lit(1))
    return out.select("row.doc_id", (F.octet_length(data("row.text")) + F.lit(1)).cast("long").alias("size"),
                      F.crc32(data("row.text")).alias("text_crc32"), F.lit("key").alias("law"), "shard",
                      F.col("slot").cast("long").alias("slot"), "grown_shard")
