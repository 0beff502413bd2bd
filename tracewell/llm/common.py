"""What the corpus operators share: reading tables, shared staging, word rules and Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: The characters that separate words, as bytes.
BLANKS = b" \t\n\x0b\x0c\r"
#: Up to this many rows of 64-byte keys a side is broadcast; beyond it Spark shuffles.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and all run on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", "")
    if not found:
        found = spark.conf.get("tracewell.staging.dir", "")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: the executors need a folder that they share with the driver")
    if not found:
        found = tempfile.mkdtemp(prefix="tracewell-")
        spark.conf.set("tracewell.staging.dir", found)
    return found.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it again.

    This cuts the lineage without tying it to an executor: a lost executor costs no more
    than the tasks it was running. ``drop_staged`` removes the tables of a session.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _paths(spark).append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._in_shared_folder = True
    return out


_STAGED: dict[str, list[str]] = {}


def _paths(spark: SparkSession) -> list[str]:
    return _STAGED.setdefault(spark.sparkContext.applicationId, [])


def drop_staged(spark: SparkSession) -> int:
    """Deletes the tables that this session staged; call it once their results are written."""
    paths, jvm = _paths(spark), spark._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    done = len(paths)
    paths.clear()
    return done


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold(doc_id: Column, of: int) -> Column:
    """crc32 of the identifier's decimal text, modulo ``of``; null identifiers fold as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % of


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True if df, a staged table, has at most so many rows; its files' footers tell."""
    return df.count() <= rows


def hinted(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is checked to be small, else as it is; it is staged for that, so that its plan runs once."""
    if not getattr(df, "_in_shared_folder", False):
        df = staged(df, "checked")
    return F.broadcast(df) if small(df, rows) else df


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Adds a global 0-based rank without sorting in one task: range partitions, their counts, local ranks."""
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = staged(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranked")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.withColumn("_own", own).join(starts, "_part").withColumn(name, F.col("_start") + F.col("_own") - 1).drop("_part", "_own", "_start")
