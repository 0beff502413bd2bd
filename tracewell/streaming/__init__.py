"""Lineage of scripts as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..engine import LineageEngine
from ..sources.scripts import local_name


def follow_scripts(spark: SparkSession, folder: str, output: str, checkpoint: str, catalog: DataFrame | None = None, once: bool = True) -> StreamingQuery:
    """Extracts each new .sql file of a folder; a batch's records are a folder of Parquet files under output.

    A batch that is run again overwrites its own folder, so every file's records are there once.
    """
    lines = spark.readStream.option("wholetext", "true").option("pathGlobFilter", "*.sql").text(folder)
    scripts = lines.select(local_name(F.col("_metadata.file_path")).alias("file"), F.col("value").alias("text"))
    engine = LineageEngine(spark, catalog)

    def batch(df: DataFrame, number: int) -> None:
        engine.extract(df).write.mode("overwrite").parquet(f"{output}/batch={number}")

    writer = scripts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
