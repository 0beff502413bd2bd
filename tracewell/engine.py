"""Extraction: SQL scripts and a catalog in, lineage records out."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import records, resolve
from .operators.cut import checkpointed, shared_folder
from .plans.walk import PLACES, SCHEMAS, Walker
from .sources.catalog import SCHEMA as CATALOG
from .sources.catalog import rooted
from .sources.scripts import read_scripts, split_statements

FINAL = "file string, stmt int, seq int, source_table string, source_column string, expression string, target_column string, target_table string"
#: So many rows of parsed statements are held on the driver before they go to the shared folder.
HELD = 100_000


def _split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, text) -> file, stmt, sql."""
    for batch in batches:
        rows = [(file, stmt, sql.strip()) for file, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for stmt, sql in enumerate(split_statements(text or ""))]
        cols = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string())], names=["file", "stmt", "sql"])


def _wave(relations: dict[str, DataFrame], catalog: DataFrame, cut, mode: str) -> DataFrame:
    """Records of statements that are known by (file, stmt), with the catalog of each under the same ``file``."""
    statements = relations["statements"].filter(F.col("error").isNull())
    kinds = {r["kind"] for r in statements.select("kind").distinct().collect()}
    refs = relations["refs"] if mode == "compat" else relations["refs"].filter("not inner")
    outputs = resolve.resolve(relations | {"refs": refs}, catalog, cut)
    rows = records.elements(statements, outputs, relations["branches"])
    keep = ["file", "stmt", "idx", "origin_ord", "expression", "target_column", "target_table", "origin_table", "origin_column"]
    plain, tidy = [], []
    if kinds & {"update", "merge"}:
        plain.append(records.assigned(statements, relations["assignments"], relations["assigned"], catalog, outputs, relations["branches"], mode).select(*keep))
    if "ctas" in kinds:
        plain.append(records.created(rows, mode).select(*keep))
    if "insert" in kinds:
        tidy.append(records.inserted(rows, catalog, mode).select(*keep))
    if "select" in kinds:
        tidy.append(records.selected(rows).select(*keep))
    parts = []
    if plain:
        at = F.struct("idx", "origin_ord")
        parts.append(reduce(DataFrame.unionByName, plain).select(*keep, at.alias("a"), at.alias("b")))
    if tidy:
        parts.append(records.tidied(reduce(DataFrame.unionByName, tidy)).select(*keep, F.col("target_seq").alias("a"), F.col("seq").alias("b")))
    if not parts:
        return catalog.sparkSession.createDataFrame([], FINAL)
    order = F.row_number().over(resolve.Window.partitionBy("file", "stmt").orderBy("a", "b"))
    both = reduce(DataFrame.unionByName, parts)
    return both.select("file", "stmt", (order - 1).alias("seq"), F.col("origin_table").alias("source_table"), F.col("origin_column").alias("source_column"), "expression", "target_column", "target_table")


class LineageEngine:
    """engine.extract(scripts) -> records; catalog rows without a file hold for every script, a script's own go before them.

    mode: ``compat`` or ``resolved``, see ``records.MODES``; they differ in MERGE, UPDATE ... FROM, INSERT,
    column lists of views, WITH inside a derived table, and in columns of nested SELECTs, which compat asks of the outer one too.
    ``store`` is a folder, shared with the executors, that keeps what statements parse to: a text that it has is not parsed again.
    """

    def __init__(self, spark: SparkSession, catalog: DataFrame | None = None, engine: str = "spark", mode: str = "compat", store: str | None = None, held: int = HELD):
        if mode not in records.MODES:
            raise ValueError(f"mode is one of {', '.join(records.MODES)}")
        self.spark, self.engine, self.mode, self.store, self.held = spark, engine.lower(), mode, store, held
        self.catalog = rooted(catalog if catalog is not None else spark.createDataFrame([], CATALOG))

    _cut = staticmethod(checkpointed)

    def _effective(self, mentioned: DataFrame, created: DataFrame | None) -> DataFrame:
        """file, stmt, table_name, column_name, ordinal for what statements mention (file, stmt, table_name): the columns that the last
        statement before made, else those of the script's own schema, else the general ones, but for names whose
        first key the script's schema has.
        """
        key, pick = ["file", "stmt", "table_name"], ["file", "stmt", "table_name", "column_name", "ordinal"]
        parts = []
        if created is not None:
            made = mentioned.join(created, ["file", "table_name"]).filter("made < stmt")
            last = F.max("made").over(resolve.Window.partitionBy(*key))
            made = made.withColumn("last", last).filter("made = last").select(*pick)
            parts.append(made)
            mentioned = mentioned.join(made.select(*key).distinct(), key, "left_anti")
        own = self.catalog.filter("file is not null")
        parts.append(mentioned.join(own.select("file", "table_name", "column_name", "ordinal"), ["file", "table_name"]).select(*pick))
        general = mentioned.join(self.catalog.filter("file is null").select("table_name", "column_name", "ordinal", "root"), "table_name")
        parts.append(general.join(own.select("file", "root").distinct(), ["file", "root"], "left_anti").select(*pick))
        return reduce(DataFrame.unionByName, parts)

    def _parsed(self, texts: DataFrame) -> tuple[dict[str, DataFrame], bool]:
        """The relations of texts (key, sql), and whether they lie in a folder. Texts come to the driver one by one: its parser
        reads them; what they give does not stay there."""
        folder, stored = self.store, None
        if folder:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/texts")
            if path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
                stored = self.spark.read.schema("key string").parquet(f"{folder}/texts")
                texts = texts.join(stored, "key", "left_anti")
        walker, keys, written = Walker(self.spark, self.mode), [], stored is not None
        self.parsed = 0

        def flush() -> None:
            for name, rows in walker.take().items():
                rows.write.mode("append").parquet(f"{folder}/{name}")
            self.spark.createDataFrame([(k,) for k in keys], "key string").write.mode("append").parquet(f"{folder}/texts")
            keys.clear()

        for row in texts.toLocalIterator(prefetchPartitions=True):
            walker.statement(row["key"], row["sql"])
            keys.append(row["key"])
            self.parsed += 1
            if walker.held() > self.held:
                folder = folder or f"{shared_folder(self.spark)}/parsed-{uuid.uuid4().hex}"
                flush()
                written = True
        if self.store and keys:
            flush()
            written = True
        here = walker.take()
        if not written:
            return here, False
        return {name: self.spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}").unionByName(rows) for name, rows in here.items()}, True

    def statements(self, scripts: DataFrame) -> dict[str, DataFrame]:
        """The flat relations of scripts (file, text), with file and stmt. Each different statement is parsed once."""
        key = F.sha2(F.concat(F.lit(f"{self.mode}:"), "sql"), 256)
        split = self._cut(scripts.select("file", "text").mapInArrow(_split, "file string, stmt int, sql string").withColumn("key", key))
        parsed, large = self._parsed(split.groupBy("key").agg(F.min("sql").alias("sql")))
        places = split.select("key", "file", "stmt")
        full = lambda c: F.concat_ws("#", "file", "stmt", c).alias(c)
        out = {}
        for name, rows in parsed.items():
            here = rows.join(places, "key").select("file", "stmt", *[F.when(F.col(c).isNotNull(), full(c)).alias(c) if c in PLACES else c for c in rows.columns if c != "key"])
            out[name] = self._cut(here) if large else here
        return out

    def _levels(self, statements: DataFrame, mentioned: DataFrame) -> DataFrame | None:
        """file, stmt, wave: above all statements that make a table which the statement mentions; None if no statement needs another."""
        makes = statements.filter("kind = 'ctas' and target_table is not null").select("file", F.col("stmt").alias("made"), F.col("target_table").alias("table_name"))
        needs = self._cut(mentioned.join(makes, ["file", "table_name"]).filter("made < stmt").select("file", "stmt", "made").distinct())
        if needs.isEmpty():
            return None
        level = self._cut(statements.select("file", "stmt", F.lit(0).alias("wave")))
        while True:
            above = needs.join(level.select("file", F.col("stmt").alias("made"), "wave"), ["file", "made"]).groupBy("file", "stmt").agg((F.max("wave") + 1).alias("above"))
            both = self._cut(level.join(above, ["file", "stmt"], "left").select("file", "stmt", "wave", F.greatest("wave", F.coalesce("above", F.lit(0))).alias("now")))
            level = both.select("file", "stmt", F.col("now").alias("wave"))
            if both.filter("now <> wave").isEmpty():
                return level

    def extract(self, scripts: DataFrame, relations: dict[str, DataFrame] | None = None) -> DataFrame:
        """Records in order of file, stmt, seq: source_table, source_column, expression, target_column, target_table, engine.

        A statement that mentions a table which its script made before sees the columns it then had; it waits for that
        one alone, so statements that need nothing of each other are resolved together, whatever they create.
        Statements the parser rejects and those without lineage give no records; see ``status``.
        """
        relations = relations or self.statements(scripts)
        statements, place = relations["statements"], ["file", "stmt"]
        mentioned = relations["sources"].filter("table_name is not null").select(*place, "table_name")
        mentioned = mentioned.union(statements.filter("target_table is not null").select(*place, "target_table"))
        mentioned = self._cut(mentioned.union(relations["assignments"].filter("from_table is not null").select(*place, "from_table")).distinct())
        level = self._levels(statements, mentioned)
        waves = [None] if level is None else [r["wave"] for r in level.select("wave").distinct().orderBy("wave").collect()]
        found, created = None, None
        skey = F.concat_ws("#", "file", "stmt").alias("file")
        for wave in waves:
            part, asked = relations, mentioned
            if wave is not None:
                now = level.filter(F.col("wave") == wave).select(*place)
                part = {name: rows.join(now, place, "left_semi") for name, rows in relations.items()}
                asked = mentioned.join(now, place, "left_semi")
            # each statement has a catalog of its own, by a name of its own
            part = {name: rows.select(skey, *rows.columns[2 if name == "sources" else 1 :]) if name in ("statements", "sources", "assignments", "assigned") else rows.drop(*place) for name, rows in part.items()}
            catalog = self._cut(self._effective(asked, created).select(skey, "table_name", "column_name", "ordinal"))
            rows = _wave(part, catalog, self._cut, self.mode)
            own = F.substring("file", F.lit(1), F.length("file") - F.length(F.col("stmt").cast("string")) - 1)
            rows = self._cut(rows.withColumn("file", own))
            found = rows if found is None else found.unionByName(rows)
            if wave != waves[-1]:
                made = statements.filter("kind = 'ctas'").select(*place)
                new = rows.join(made, place).filter("target_column is not null and target_table is not null")
                new = new.groupBy("file", F.col("stmt").alias("made"), F.col("target_table").alias("table_name"), F.col("target_column").alias("column_name")).agg(F.min("seq").cast("int").alias("ordinal"))
                created = self._cut(new) if created is None else created.unionByName(self._cut(new))
        if found is None:
            found = self.spark.createDataFrame([], FINAL)
        return found.withColumn("engine", F.lit(self.engine)).orderBy("file", "stmt", "seq")

    def status(self, relations: dict[str, DataFrame]) -> DataFrame:
        return relations["statements"].select("file", "stmt", "kind", F.coalesce("error", F.lit("ok")).alias("status"))

    def extract_folder(self, folder: str) -> DataFrame:
        return self.extract(read_scripts(self.spark, folder))
