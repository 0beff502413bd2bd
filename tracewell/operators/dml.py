"""INSERT, UPDATE and MERGE on plain tables: each returns what the target would hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert(target: DataFrame, rows: DataFrame) -> DataFrame:
    """target and rows by name; columns that rows lack are null."""
    return target.unionByName(rows.select(*[c for c in target.columns if c in rows.columns]), allowMissingColumns=True)


def update(target: DataFrame, condition: Column, assignments: dict[str, Column]) -> DataFrame:
    hit = F.coalesce(condition, F.lit(False))
    return target.select(*[F.when(hit, assignments[c]).otherwise(F.col(c)).alias(c) if c in assignments else F.col(c) for c in target.columns])


def merge(target: DataFrame, source: DataFrame, keys: list[str], matched: dict[str, Column] | None = None, insert_missing: bool = True) -> DataFrame:
    """Rows of target with matched's columns set from t.* and s.*; source rows without a partner come in by name."""
    t = target.withColumn("_t", F.lit(True)).alias("t")
    s = source.withColumn("_s", F.lit(True)).alias("s")
    on = [F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys]
    both = t.join(s, on, "full" if insert_missing else "left")
    matched = matched or {}

    def value(c: str) -> Column:
        own = F.col(f"t.{c}")
        new = F.col(f"s.{c}") if c in source.columns else F.lit(None)
        return F.when(F.col("_t").isNull(), new).when(F.col("_s").isNotNull(), matched.get(c, own)).otherwise(own).alias(c)

    return both.select(*[value(c) for c in target.columns])
