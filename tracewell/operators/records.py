"""Lineage records of statements: target mapping, and the passes that drop placeholders and repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .resolve import _concrete, query_index

RECORD = ["source_table", "source_column", "expression", "target_column", "target_table", "file"]


def elements(statements: DataFrame, outputs: DataFrame, branches: DataFrame) -> DataFrame:
    """The projected elements of each statement's query in order: idx counts them, origins keep theirs."""
    rows = statements.join(branches.select(F.col("query").alias("root"), "branch", "scope"), "root").join(outputs, "scope")
    stmt = ["file", "stmt"]
    idx = F.dense_rank().over(Window.partitionBy(*stmt).orderBy("branch", "proj", "el")) - 1
    first = F.first("origin_column").over(Window.partitionBy(*stmt, "branch", "proj", "el").orderBy("origin_ord"))
    return rows.withColumns({"idx": idx, "first_column": first})


#: ``compat`` keeps the rules that existing records were made by, ``resolved`` follows SQL where the two differ.
MODES = ("compat", "resolved")


def created(rows: DataFrame, mode: str = "compat") -> DataFrame:
    """CREATE ... AS SELECT: every origin of every element; unnamed elements are named by their first origin.

    With a list of columns the element at a column's place is that column (resolved); in compat the list takes the
    target's name away.
    """
    rows, listed = rows.filter("kind = 'ctas'"), F.size("target_cols") > 0
    name = F.coalesce("output_column", "first_column")
    if mode == "resolved":
        return rows.withColumn("target_column", F.when(listed, F.get("target_cols", F.col("idx"))).otherwise(name))
    return rows.withColumns({"target_column": name, "target_table": F.when(~listed, F.col("target_table"))})


def inserted(rows: DataFrame, catalog: DataFrame, mode: str = "compat") -> DataFrame:
    """INSERT: elements map to the target's columns by name at their place.

    Without a column list the produced names that the target has, in produced order, are the list. In resolved
    mode the place alone decides, among the listed columns or those of the target's schema; without either
    an element keeps its name. A further branch starts at the first column again.
    """
    rows = rows.filter("kind = 'insert'")
    if mode == "resolved":
        schema = catalog.groupBy("file", F.col("table_name").alias("target_table")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "column_name"))), lambda x: x["column_name"]).alias("schema_cols"))
        rows = rows.join(schema, ["file", "target_table"], "left").withColumn("cols", F.when(F.size("target_cols") > 0, F.col("target_cols")).otherwise(F.col("schema_cols")))
        place = F.col("idx") - F.min("idx").over(Window.partitionBy("file", "stmt", "branch"))
        named = F.coalesce("output_column", "first_column")
        return rows.withColumn("target_column", F.when(F.size("cols") > 0, F.get("cols", place)).otherwise(named)).filter("target_column is not null").drop("cols", "schema_cols")
    stmt = ["file", "stmt"]
    has = catalog.select("file", F.col("table_name").alias("target_table"), F.col("column_name").alias("produced"), F.lit(True).alias("in_target"))
    produced = rows.filter("origin_ord = 0").withColumn("produced", F.coalesce("output_column", "first_column"))
    produced = produced.join(has, ["file", "target_table", "produced"]).groupBy(*stmt).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "produced"))), lambda x: x["produced"]).alias("inferred"))
    rows = rows.join(produced, stmt, "left").withColumn("cols", F.when(F.size("target_cols") > 0, F.col("target_cols")).otherwise(F.coalesce("inferred", F.array().cast("array<string>"))))
    at = F.get("cols", F.col("idx"))
    placed = F.when((at == F.col("first_column")) | (at == F.col("output_column")), at)
    target = F.when(F.col("idx") < F.size("cols"), placed).otherwise(F.col("output_column"))
    target = F.coalesce(target, F.when(F.array_contains("cols", F.col("output_column")), F.col("output_column")))
    return rows.withColumn("target_column", target).filter("target_column is not null").drop("cols", "inferred")


def selected(rows: DataFrame) -> DataFrame:
    return rows.filter("kind = 'select'").withColumn("target_column", F.col("output_column"))


def assigned(statements: DataFrame, assignments: DataFrame, refs: DataFrame, catalog: DataFrame, outputs: DataFrame | None = None, branches: DataFrame | None = None, mode: str = "compat") -> DataFrame:
    """UPDATE and MERGE: the columns of each assigned expression.

    In an UPDATE a qualifier is matched against the names of the target and the FROM table, then the first of
    them whose schema has the column counts; in a MERGE the target if its schema has it. In resolved mode
    a qualifier is an alias or name of the target or the source, which may be a query; a name without
    one is the source's if that is known to have it, else the target's, else the source's if its columns are unknown.
    """
    if mode == "resolved":
        return _assigned_by_source(statements, assignments, refs, catalog, query_index(outputs, branches))
    rows = statements.join(assignments, ["file", "stmt"]).join(refs, ["file", "stmt", "n"], "left")
    tables = F.array(F.struct(F.lit(0).alias("o"), F.col("target_table").alias("t")), F.struct(F.lit(1).alias("o"), F.col("from_table").alias("t")))
    asked = rows.select("file", "stmt", "n", "ref_ord", "kind", "qualifier", "name", F.explode(F.when(F.col("kind") == "update", tables).otherwise(F.slice(tables, 1, 1))).alias("x"))
    asked = asked.select("file", "stmt", "n", "ref_ord", "kind", "qualifier", "name", "x.o", "x.t").filter("t is not null and name is not null")
    has = catalog.select("file", F.col("table_name").alias("t"), F.col("column_name").alias("name"), F.lit(True).alias("has"))
    asked = asked.join(has, ["file", "t", "name"], "left")
    called = (F.col("kind") == "update") & ((F.col("t") == F.col("qualifier")) | (F.element_at(F.split("t", r"\."), -1) == F.col("qualifier")))
    best = asked.withColumn("p", F.when(called, 0).when(F.col("has"), 1)).filter("p is not null")
    best = best.groupBy("file", "stmt", "n", "ref_ord").agg(F.min(F.struct("p", "o", "t")).alias("m")).select("file", "stmt", "n", "ref_ord", F.col("m.t").alias("origin_table"))
    rows = rows.withColumn("ref_ord", F.coalesce("ref_ord", F.lit(0))).join(best, ["file", "stmt", "n", "ref_ord"], "left")
    return rows.select("file", "stmt", F.col("n").alias("idx"), F.col("ref_ord").alias("origin_ord"), "kind", "expression", "target_column", "target_table", "origin_table", F.col("name").alias("origin_column"))


def _assigned_by_source(statements: DataFrame, assignments: DataFrame, refs: DataFrame, catalog: DataFrame, index: DataFrame) -> DataFrame:
    key = ["file", "stmt", "n", "ref_ord"]
    rows = statements.join(assignments, ["file", "stmt"]).join(refs, ["file", "stmt", "n"], "left").withColumn("ref_ord", F.coalesce("ref_ord", F.lit(0)))
    side = lambda o, alias, t, q: F.struct(F.lit(o).alias("o"), F.col(alias).alias("alias"), F.col(t).alias("t"), q.alias("q"))
    sides = F.array(side(0, "from_alias", "from_table", F.col("from_query")), side(1, "target_alias", "target_table", F.lit(None).cast("string")))
    asked = rows.filter("name is not null").select(*key, "qualifier", "name", F.explode(sides).alias("x")).select(*key, "qualifier", "name", "x.*").filter("t is not null or q is not null")
    has = catalog.select("file", F.col("table_name").alias("t"), F.col("column_name").alias("name"), F.lit(True).alias("has"))
    known = catalog.select("file", F.col("table_name").alias("t"), F.lit(True).alias("known")).distinct()
    shown = index.select(F.col("query").alias("q"), "name", F.lit(True).alias("shown")).distinct()
    asked = asked.join(has, ["file", "t", "name"], "left").join(known, ["file", "t"], "left").join(shown, ["q", "name"], "left")
    called = F.coalesce((F.col("qualifier") == F.col("t")) | (F.element_at(F.split("t", r"\."), -1) == F.col("qualifier")), F.lit(False))
    bare, there = F.col("qualifier").isNull(), F.coalesce("has", F.lit(False)) | F.coalesce("shown", F.lit(False))
    by_alias = F.coalesce(F.col("qualifier") == F.col("alias"), F.lit(False))
    best = asked.withColumn("p", F.when(by_alias, 0).when(called, 1).when(bare & there, 2).when(bare & F.col("q").isNull() & F.col("known").isNull(), 3)).filter("p is not null")
    best = best.groupBy(*key).agg(F.min(F.struct("p", "o", "t", "q")).alias("m")).select(*key, "m.t", "m.q")
    rows = rows.join(best, key, "left")
    through = index.select(F.col("query").alias("q"), "name", F.col("origin_ord").alias("k"), "origin_table", F.col("origin_column").alias("c"))
    rows = rows.join(through, ["q", "name"], "left")
    number = F.row_number().over(Window.partitionBy("file", "stmt", "n").orderBy("ref_ord", "k")) - 1
    from_query = F.col("q").isNotNull() & F.col("k").isNotNull()
    return rows.select("file", "stmt", F.col("n").alias("idx"), number.alias("origin_ord"), "kind", "expression", "target_column", "target_table", F.when(from_query, F.col("origin_table")).otherwise(F.col("t")).alias("origin_table"), F.when(from_query, F.col("c")).otherwise(F.col("name")).alias("origin_column"))


def tidied(rows: DataFrame) -> DataFrame:
    """Passes over SELECT and INSERT rows: exact repeats, placeholders beside concrete rows of the same expression
    and of the same target, repeats of the same pair; the order is that of targets' first appearance."""
    stmt = ["file", "stmt"]
    rows = rows.withColumns({"real": _concrete(F.col("origin_table"), F.col("origin_column")), "seq": F.struct("idx", "origin_ord")})
    once = lambda keys: F.row_number().over(Window.partitionBy(*stmt, *keys).orderBy("seq"))
    any_real = lambda keys: F.max(F.col("real").cast("int")).over(Window.partitionBy(*stmt, *keys))
    pair = ["origin_table", "origin_column", "target_table", "target_column"]
    rows = rows.withColumn("_k", once([*pair, "expression"])).filter("_k = 1")
    rows = rows.withColumn("_k", any_real(["target_table", "target_column", "expression"])).filter("real or _k = 0")
    rows = rows.withColumn("_k", any_real(["target_column"])).filter("real or _k = 0")
    rows = rows.withColumn("_k", once(pair)).filter("_k = 1 or coalesce(target_column, '') = ''")
    return rows.withColumn("target_seq", F.min("seq").over(Window.partitionBy(*stmt, "target_column"))).drop("_k", "real")
