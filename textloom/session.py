"""Spark sessions for this engine."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; sizes are the cluster's own unless given."""
    b = SparkSession.builder.appName("textloom")
    if master:
        b = b.master(master)
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the folder that driver and executors share (spark.checkpoint.dir; a local run without one uses its own)
    and read again, so that later work neither repeats nor loses it."""
    spark = df.sparkSession
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        context = spark.sparkContext
        if not context._jsc.sc().getCheckpointDir().isDefined():
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile

            context.setCheckpointDir(tempfile.mkdtemp(prefix="textloom-"))
        where = context._jsc.sc().getCheckpointDir().get()
    path = f"{where.rstrip('/')}/textloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
