"""Chains of scripts as they arrive: stored steps that follow every batch.

A folder holds, by number of the batch, the records of its scripts, the steps it made and the pairs of ends (ultimate source,
ultimate target) whose earlier steps it took back. A batch only follows chains by way of columns that its scripts touch: all
chains between the heads above and the outputs below those columns are made anew, others stay as they are.
A batch that is run again reads what lies before it and overwrites its own part, so it gives the same once more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..engine import FINAL, LineageEngine
from ..operators import chains
from ..operators.cut import checkpointed
from ..sources.scripts import local_name

_STEPS = "source_table string, source_column string, target_table string, target_column string, ultimate_source_table string, ultimate_source_column string, ultimate_target_table string, ultimate_target_column string, level_top_to_bottom int, level_bottom_to_top int"
ENDS = chains.STEP[4:8]
_TABLES = {"records": f"{FINAL}, engine string, batch int", "files": "file string, batch int", "steps": f"{_STEPS}, batch int", "taken": f"{', '.join(f'{c} string' for c in ENDS)}, batch int"}


class ChainStore:
    def __init__(self, spark: SparkSession, folder: str, engine: LineageEngine | None = None):
        self.spark, self.folder, self.engine = spark, folder.rstrip("/"), engine or LineageEngine(spark)

    def _read(self, name: str, before: int | None) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], _TABLES[name])
        rows = self.spark.read.schema(_TABLES[name]).parquet(f"{self.folder}/{name}")
        return rows if before is None else rows.filter(F.col("batch") < before)

    def records(self, before: int | None = None) -> DataFrame:
        """The records of each file as its last batch had them, of all batches or of those before one."""
        last = self._read("files", before).groupBy("file").agg(F.max("batch").alias("batch"))
        return self._read("records", before).join(last, ["file", "batch"], "left_semi").drop("batch")

    def steps(self, before: int | None = None) -> DataFrame:
        """The steps of all chains so far: those that no later batch took back."""
        rows, taken = self._read("steps", before), self._read("taken", before).groupBy(*ENDS).agg(F.max("batch").alias("until"))
        return rows.join(taken, ENDS, "left").filter(F.col("until").isNull() | (F.col("until") <= F.col("batch"))).select(*chains.STEP)

    def _write(self, rows: DataFrame, name: str, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={number}")

    def apply(self, scripts: DataFrame, number: int) -> None:
        """Takes in a batch of scripts (file, text); a file that came before is replaced."""
        files = checkpointed(scripts.select("file").distinct())
        new = checkpointed(self.engine.extract(scripts))
        before = self.records(number)
        old = before.join(files, "file", "left_semi")
        after = checkpointed(before.join(files, "file", "left_anti").select(*new.columns).unionByName(new))
        both = chains.Graph(before.select(*new.columns).unionByName(new))
        # touched: what the scripts say or said, and every column of a table that is created now or was before, and not both
        changed = chains.cleaned(old.select(*new.columns).unionByName(new)).filter("target_column <> ''")
        ends = lambda df: df.select(chains.node("source_table", "source_column").alias("node")).union(df.select(chains.node("target_table", "target_column")))
        made, was = chains.created_tables(after), chains.created_tables(before)
        turned = made.exceptAll(was).union(was.exceptAll(made))
        nodes = both.all.select(F.col("source").alias("node")).union(both.all.select("target")).distinct()
        touched = ends(changed).union(nodes.join(turned, F.col("node.table") == F.col("table_name"), "left_semi")).distinct()
        up, down = both.links.select("source", "target"), both.links.select(F.col("target").alias("source"), F.col("source").alias("target"))
        touched = checkpointed(touched)
        above, below = chains.closed(up, touched, both.cut), chains.closed(down, touched, both.cut)
        steps = checkpointed(chains.chain_steps(after, within=(above, below)))
        side = lambda df, k: df.select(F.col("node.table").alias(ENDS[k]), F.col("node.column").alias(ENDS[k + 1]))
        taken = self.steps(number).select(*ENDS).distinct().join(side(above, 0), ENDS[:2], "left_semi").join(side(below, 2), ENDS[2:], "left_semi")
        taken = checkpointed(taken)
        self._write(new, "records", number)
        self._write(files, "files", number)
        self._write(taken, "taken", number)
        self._write(steps, "steps", number)


def follow_chains(spark: SparkSession, folder: str, output: str, checkpoint: str, catalog: DataFrame | None = None, once: bool = True) -> StreamingQuery:
    """Keeps the chains of all .sql files of a folder as they come; ``ChainStore(spark, output).steps()`` are those so far."""
    lines = spark.readStream.option("wholetext", "true").option("pathGlobFilter", "*.sql").text(folder)
    scripts = lines.select(local_name(F.col("_metadata.file_path")).alias("file"), F.col("value").alias("text"))
    store = ChainStore(spark, output, LineageEngine(spark, catalog))
    writer = scripts.writeStream.foreachBatch(store.apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
