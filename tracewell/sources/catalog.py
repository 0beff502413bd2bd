"""Table schemas as one relation: file (null: global), table_name, column_name, data_type, ordinal, root (the first key of the
document that the table stands below)."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import normalized

SCHEMA = "file string, table_name string, column_name string, data_type string, ordinal int, root string"


def flatten(raw: dict, file: str | None = None) -> Iterator[tuple]:
    """Rows of a schema document: lists of columns, or maps of columns to types, below any depth of names."""

    def walk(name: str, node) -> Iterator[tuple]:
        if isinstance(node, list):
            yield from ((file, normalized(name), normalized(str(c)), "unknown", i) for i, c in enumerate(node))
        elif isinstance(node, dict) and node and not any(isinstance(v, (dict, list)) for v in node.values()):
            yield from ((file, normalized(name), normalized(c), str(v).lower(), i) for i, (c, v) in enumerate(node.items()))
        elif isinstance(node, dict):
            for key, below in node.items():
                yield from walk(f"{name}.{key}" if name else key, below)

    for key, node in raw.items():
        yield from ((*row, key) for row in walk(key, node) if row[1])


def catalog_from_json(spark: SparkSession, raw: dict, file: str | None = None) -> DataFrame:
    return spark.createDataFrame(list(flatten(raw, file)), SCHEMA)


def catalog_from_csv(spark: SparkSession, path: str) -> DataFrame:
    """database, table, column, data_type by position; a header line is skipped, rows without table or column are dropped."""
    cells = [F.trim(F.coalesce(F.col(c), F.lit(""))) for c in ("a", "b", "c", "d")]
    lines = spark.read.csv(path, header=True, schema="a string, b string, c string, d string", mode="PERMISSIVE", enforceSchema=True)
    rows = lines.select(*[c.alias(n) for c, n in zip(cells, ("db", "tbl", "col", "kind"), strict=True)], F.monotonically_increasing_id().alias("at"))
    rows = rows.filter((F.col("tbl") != "") & (F.col("col") != ""))
    name = F.lower(F.when(F.col("db") != "", F.concat_ws(".", "db", "tbl")).otherwise(F.col("tbl")))
    rows = rows.groupBy(name.alias("table_name"), F.lower("col").alias("column_name")).agg(F.min("at").alias("at"), F.max_by("kind", "at").alias("kind"))
    order = F.row_number().over(Window.partitionBy("table_name").orderBy("at")) - 1
    kind = F.when(F.col("kind") == "", "unknown").otherwise(F.lower("kind"))
    return rows.select(F.lit(None).cast("string").alias("file"), "table_name", "column_name", kind.alias("data_type"), order.cast("int").alias("ordinal"), F.col("table_name").alias("root"))


def catalog_of(tables: dict[str, DataFrame]) -> DataFrame:
    """The schemas of DataFrames."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(None, normalized(t), normalized(c), kind, i, t) for t, df in tables.items() for i, (c, kind) in enumerate(df.dtypes)]
    return spark.createDataFrame(rows, SCHEMA)


def rooted(catalog: DataFrame) -> DataFrame:
    """The catalog with a root for every row: where none is known, the table stands for itself."""
    root = F.col("root") if "root" in catalog.columns else F.lit(None).cast("string")
    return catalog.withColumn("root", F.coalesce(root, F.col("table_name")))


def overlaid(base: DataFrame, local: DataFrame) -> DataFrame:
    """local's rows over base's: a first key that local has hides all that base has below it."""
    return rooted(local).unionByName(rooted(base).join(rooted(local).select("root").distinct(), "root", "left_anti"))


def read_json(path: str) -> dict:
    with open(path, encoding="utf-8") as file:
        return json.load(file)
