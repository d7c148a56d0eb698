"""Session defaults for local use and tests; on a cluster the submitter's settings win."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with UTC time and AQE on. Extra settings are passed through."""
    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("corvane")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", conf.pop("driver_memory", "6g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only where that setting is absent on a local master (tests, a single machine) a folder
    under the temp directory is chosen; without it a cluster has no place that all executors see.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = getattr(spark.sparkContext, "_corvane_dir", None)
        if not d:
            d = "file://" + tempfile.mkdtemp(prefix="corvane-")
            spark.sparkContext._corvane_dir = d
    return d.rstrip("/")


def materialized(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read back: computed once, whatever happens to executors. The table stays."""
    path = f"{shared_dir(df.sparkSession)}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
