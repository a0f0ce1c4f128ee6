"""Session set-up, the shared scratch folder, and small constant tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "trailhound", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume; ``conf`` entries win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # sessions of a busy key are merged within each task first, so that not all of its rows move
        "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a session whose driver and executors are one process may go without and gets a temporary folder; on a cluster
    each machine would write to its own disk, so a missing setting is an error there.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="trailhound-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for a table or files a job hands on to a later step."""
    return f"{checkpoint_dir(spark).rstrip('/')}/trailhound/{name}-{uuid.uuid4().hex}"


@dataclass(frozen=True)
class Stored:
    """A table written to the shared folder, with the handle that removes it once nothing reads it any more."""

    rows: DataFrame
    path: str

    def remove(self) -> None:
        context = self.rows.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def store(df: DataFrame, name: str) -> Stored:
    """``df`` computed once, into a new table that later plans start from."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return Stored(df.sparkSession.read.schema(df.schema).parquet(path), path)


def constant_table(spark: SparkSession, columns: list[str], rows: list[tuple]) -> DataFrame:
    """A fixed-size table of literals. Its size is known when the code is written, so it may be broadcast."""
    return spark.createDataFrame(pa.table({c: [r[i] for r in rows] for i, c in enumerate(columns)}))
