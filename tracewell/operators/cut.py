"""Cutting plans in iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's folder below spark.checkpoint.dir, which driver and executors share; one of our own where that is unset and
    all run on one machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        found = spark.conf.get("spark.checkpoint.dir", "")
        if not found and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: the executors need a folder that they share with the driver")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="tracewell-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder, so that plans stay short and a lost executor costs nothing that was done before."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """A compressed Parquet table in the shared folder, for large rows; what was shuffled to make it is deleted at once."""
    spark, free = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(free, None)
    spark.conf.set(free, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(free)
        else:
            spark.conf.set(free, before)
    return spark.read.schema(df.schema).parquet(path)
