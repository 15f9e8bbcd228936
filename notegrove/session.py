"""Session factory and table loading."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def session(app: str = "notegrove", **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; on a cluster pass its own settings."""
    builder = SparkSession.builder.appName(app)
    for key, value in ({"spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true"} | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Only a session of one machine that names none, as
    in tests, gets one of its own; on a cluster that would lose data, so it is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = f"file://{tempfile.gettempdir()}/notegrove-{os.getpid()}"
    return where.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """The frame, written to the shared folder and read again: it is computed once, and its lineage ends at files that outlive
    any executor."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
