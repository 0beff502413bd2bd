"""Registered queries of the lineage engine, each over the given tables, with their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import chains, dml, records, resolve
from .operators.cut import checkpointed

Query = Callable[[SparkSession, str], DataFrame]
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _key(c: str):
    return F.col(c).cast("string")


def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineage records of rows: region > nation > customer > orders > the priority an order is reported under."""
    t = lambda name: _table(spark, sf_dir, name)
    edge = lambda df, a, x, b, y: df.select(F.lit(a).alias("source_table"), x.alias("source_column"), F.lit(b).alias("target_table"), y.alias("target_column"))
    out = edge(t("nation"), "region", _key("n_regionkey"), "nation", _key("n_nationkey"))
    out = out.unionByName(edge(t("customer"), "nation", _key("c_nationkey"), "customer", _key("c_custkey")))
    orders = t("orders")
    out = out.unionByName(edge(orders, "customer", _key("o_custkey"), "orders", _key("o_orderkey")))
    return out.unionByName(edge(orders, "orders", _key("o_orderkey"), "", F.col("o_orderpriority")))


def circular(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations lead to their customers, every fifth customer leads back to its nation."""
    c = _table(spark, sf_dir, "customer")
    edge = lambda df, a, x, b, y: df.select(F.lit(a).alias("source_table"), x.alias("source_column"), F.lit(b).alias("target_table"), y.alias("target_column"))
    there = edge(c, "nation", _key("c_nationkey"), "customer", _key("c_custkey"))
    return there.unionByName(edge(c.filter("c_custkey % 5 = 0"), "customer", _key("c_custkey"), "nation", _key("c_nationkey")))


def _edge(df: DataFrame, a, x, b, y) -> DataFrame:
    as_col = lambda v: F.lit(v) if isinstance(v, str) else v
    return df.select(as_col(a).alias("source_table"), as_col(x).alias("source_column"), as_col(b).alias("target_table"), as_col(y).alias("target_column"))


def circuits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings of five suppliers, every second ring led to the next by a column that is on no cycle; single ones lead to themselves."""
    s = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    ring = s.withColumn("next", F.coalesce(F.lead("k").over(resolve.Window.partitionBy(F.expr("k div 5")).orderBy("k")), F.min("k").over(resolve.Window.partitionBy(F.expr("k div 5")))))
    rings = _edge(ring, "supplier", _key("k"), "supplier", _key("next"))
    ends = s.filter("k % 10 = 4")
    bridge = _edge(ends, "supplier", _key("k"), "bridge", _key("k")).unionByName(_edge(ends, "bridge", _key("k"), "supplier", (F.col("k") + 1).cast("string")))
    return circular(spark, sf_dir).unionByName(rings).unionByName(bridge)


def tangled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations lead into rings of five suppliers, each of which leads to its nation's output; dead ends lead in as well."""
    s = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n"))
    ring = s.withColumn("next", F.coalesce(F.lead("k").over(resolve.Window.partitionBy(F.expr("k div 5")).orderBy("k")), F.min("k").over(resolve.Window.partitionBy(F.expr("k div 5")))))
    parts = [
        _edge(s.filter("k % 5 = 1"), "nation", _key("n"), "supplier", _key("k")),
        _edge(ring, "supplier", _key("k"), "supplier", _key("next")),
        _edge(s, "supplier", _key("k"), "", _key("n")),
        _edge(s.filter("k % 7 = 0"), "nation", _key("n"), "ghost", F.concat(F.lit("g"), _key("k"))),
        _edge(s.filter("k % 3 = 0"), "ghost", F.concat(F.lit("h"), _key("k")), "supplier", _key("k")),
        _edge(s.filter("k % 4 = 0"), "nation", _key("n"), "", _key("n")),
    ]
    return reduce(DataFrame.unionByName, parts)


_TANGLED = """s AS (SELECT s_suppkey AS k, s_nationkey AS n, coalesce(lead(s_suppkey) OVER w, first(s_suppkey) OVER w) AS next FROM supplier WINDOW w AS (PARTITION BY s_suppkey // 5 ORDER BY s_suppkey)),
r AS (SELECT DISTINCT * FROM (
  SELECT 'nation' AS st, CAST(n AS VARCHAR) AS sc, 'supplier' AS tt, CAST(k AS VARCHAR) AS tc FROM s WHERE k % 5 = 1
  UNION ALL SELECT 'supplier', CAST(k AS VARCHAR), 'supplier', CAST(next AS VARCHAR) FROM s UNION ALL SELECT 'supplier', CAST(k AS VARCHAR), '', CAST(n AS VARCHAR) FROM s
  UNION ALL SELECT 'nation', CAST(n AS VARCHAR), 'ghost', 'g' || k FROM s WHERE k % 7 = 0 UNION ALL SELECT 'ghost', 'h' || k, 'supplier', CAST(k AS VARCHAR) FROM s WHERE k % 3 = 0
  UNION ALL SELECT 'nation', CAST(n AS VARCHAR), '', CAST(n AS VARCHAR) FROM s WHERE k % 4 = 0) x),
f AS (SELECT DISTINCT tt, tc FROM r WHERE tt IN ('', 'ghost')),
p(head, path) AS (SELECT r.st || '.' || r.sc, [r.st || '.' || r.sc, r.tt || '.' || r.tc] FROM f JOIN r USING (tt, tc)
  UNION ALL SELECT r.st || '.' || r.sc, list_prepend(r.st || '.' || r.sc, path) FROM p JOIN r ON r.tt || '.' || r.tc = head WHERE NOT list_contains(path, r.st || '.' || r.sc)),
d AS (SELECT path FROM p WHERE head LIKE 'nation.%')"""
_TANGLED_STEPS = f"""WITH RECURSIVE {_TANGLED}, e AS (SELECT path, unnest(range(1, len(path))) AS i FROM d)
SELECT DISTINCT split_part(path[i], '.', 1) AS source_table, split_part(path[i], '.', 2) AS source_column, split_part(path[i + 1], '.', 1) AS target_table, split_part(path[i + 1], '.', 2) AS target_column,
  split_part(path[1], '.', 1) AS ultimate_source_table, split_part(path[1], '.', 2) AS ultimate_source_column, split_part(path[-1], '.', 1) AS ultimate_target_table, split_part(path[-1], '.', 2) AS ultimate_target_column,
  CAST(i AS INTEGER) AS level_top_to_bottom, CAST(len(path) - i AS INTEGER) AS level_bottom_to_top FROM e"""
_TANGLED_FANOUT = f"WITH RECURSIVE {_TANGLED} SELECT 'nation' AS ultimate_source_table, split_part(path[1], '.', 2) AS ultimate_source_column, count(DISTINCT path[-1]) AS targets FROM d GROUP BY path[1]"


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as tables: the columns of each go to the table of half its number, every third to the output of a SELECT."""
    p = _table(spark, sf_dir, "part")
    table = lambda k: F.concat(F.lit("t"), k.cast("string"))
    target = F.when(F.col("p_partkey") % 3 > 0, table(F.expr("p_partkey div 2"))).otherwise("")
    return provenance(spark, sf_dir).unionByName(_edge(p, table(F.col("p_partkey")), F.col("p_brand"), target, F.col("p_type")))


_NAMED = """n AS (SELECT 't' || p_partkey AS st, p_brand AS sc, CASE WHEN p_partkey % 3 > 0 THEN 't' || (p_partkey // 2) ELSE '' END AS tt, p_type AS tc FROM part),
made AS (SELECT DISTINCT tt FROM n WHERE tt <> '')"""


def traced_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of every tenth customer, of finished orders, of a base column, and of columns that nobody has."""
    ask = lambda df, t, c: df.select(F.lit(t).alias("table_name"), c.alias("column_name"))
    targets = ask(_table(spark, sf_dir, "customer").filter("c_custkey % 10 = 0"), "customer", _key("c_custkey"))
    targets = targets.unionByName(ask(_table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'"), "orders", _key("o_orderkey")))
    targets = targets.unionByName(ask(_table(spark, sf_dir, "region"), "region", _key("r_regionkey"))).unionByName(ask(_table(spark, sf_dir, "supplier"), "customer", F.concat(F.lit("none"), _key("s_suppkey"))))
    return _paths_as_text(chains.trace(provenance(spark, sf_dir), targets))


_TRACED_SQL = """SELECT 'region.' || n_regionkey || '>nation.' || n_nationkey || '>customer.' || c_custkey AS path FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 10 = 0
UNION ALL SELECT 'region.' || n_regionkey || '>nation.' || n_nationkey || '>customer.' || c_custkey || '>orders.' || o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F'
UNION ALL SELECT 'region.' || r_regionkey FROM region"""


_FULL = """
  SELECT CAST(n_regionkey AS VARCHAR) AS r, CAST(n_nationkey AS VARCHAR) AS n, CAST(c_custkey AS VARCHAR) AS c, CAST(o_orderkey AS VARCHAR) AS o, o_orderpriority AS p
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""


def _paths_as_text(paths: DataFrame) -> DataFrame:
    return paths.select(F.array_join(F.transform("path", lambda n: F.concat(n["table"], F.lit("."), n["column"])), ">").alias("path"))


# ---- name resolution over relations made from rows: an order is a scope over orders and customer,
# ---- its line items are the references


def _scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = F.array(F.struct(F.lit(0).alias("src_ord"), F.lit("o").alias("alias"), F.lit("orders").alias("table_name")), F.struct(F.lit(1).alias("src_ord"), F.lit("c").alias("alias"), F.lit("customer").alias("table_name")))
    rows = _table(spark, sf_dir, "orders").select(_key("o_orderkey").alias("scope"), F.explode(sources).alias("s"))
    return rows.select(F.lit("rows").alias("file"), "scope", "s.src_ord", "s.alias", F.lit("table").alias("kind"), "s.table_name", F.lit(None).cast("string").alias("child"), F.array().cast("array<string>").alias("names"))


def _schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("rows", t, c, i) for t in ("orders", "customer") for i, c in enumerate(_table(spark, sf_dir, t).columns)]
    return spark.createDataFrame(rows, "file string, table_name string, column_name string, ordinal int")


_NO_INDEX = "query string, name string, pos struct<branch:int,proj:int,el:int>, origin_ord int, origin_table string, origin_column string"


def _refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber") % 4
    name = F.when(n == 1, "c_name").when(n == 2, "o_totalprice").when(n == 3, "c_note").otherwise("remark")
    qualifier = F.when(F.col("flag") == "A", "o").when(F.col("flag") == "R", "c")
    items = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("flag"))
    return items.select(_key("l_orderkey").alias("scope"), F.lit(0).alias("proj"), F.col("l_linenumber").alias("ref_ord"), qualifier.alias("qualifier"), name.alias("name"))


def _source_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.source_columns(_scopes(spark, sf_dir), _schemas(spark, sf_dir), None, None, False)


def resolve_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve.resolve_refs(_refs(spark, sf_dir), _scopes(spark, sf_dir), _source_columns(spark, sf_dir), _schemas(spark, sf_dir), None, through=False)
    return out.select("scope", "ref_ord", "ans_ord", "origin_table", "origin_column")


_NAMES_SQL = """WITH r AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS scope, l_linenumber AS ref_ord, CASE min(l_returnflag) WHEN 'A' THEN 'o' WHEN 'R' THEN 'c' END AS q,
    CASE l_linenumber % 4 WHEN 1 THEN 'c_name' WHEN 2 THEN 'o_totalprice' WHEN 3 THEN 'c_note' ELSE 'remark' END AS name
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey, l_linenumber)
SELECT scope, ref_ord, 0 AS ans_ord, CASE WHEN q = 'o' THEN 'orders' WHEN q = 'c' OR name LIKE 'c#_%' ESCAPE '#' THEN 'customer' ELSE 'orders' END AS origin_table, name AS origin_column FROM r"""


def resolve_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    star = _table(spark, sf_dir, "orders").select(_key("o_orderkey").alias("scope"), F.lit(0).alias("proj"), F.when(F.col("o_orderstatus") == "F", "qualified").otherwise("star").alias("kind"), F.lit(None).cast("string").alias("out_name"), F.when(F.col("o_orderstatus") == "F", "c").alias("qualifier"), F.lit("*").alias("expression"), F.lit(False).alias("is_column"))
    return resolve.expand_stars(star, _source_columns(spark, sf_dir)).select("scope", "el", "output_column", "origin_table", "origin_column")


_STARS_SQL = """WITH c AS (SELECT t, c, ord FROM (VALUES ('orders', 'o_orderkey', 0), ('orders', 'o_custkey', 1), ('orders', 'o_orderstatus', 2), ('orders', 'o_totalprice', 3), ('orders', 'o_orderdate', 4), ('orders', 'o_orderpriority', 5),
  ('customer', 'c_custkey', 6), ('customer', 'c_name', 7), ('customer', 'c_nationkey', 8), ('customer', 'c_acctbal', 9), ('customer', 'c_mktsegment', 10)) v(t, c, ord))
SELECT CAST(o_orderkey AS VARCHAR) AS scope, CASE WHEN o_orderstatus = 'F' THEN ord - 6 ELSE ord END AS el, c AS output_column, t AS origin_table, c AS origin_column
FROM orders, c WHERE o_orderstatus <> 'F' OR t = 'customer'"""


def tidy_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passes over records, a customer a statement: line items name sources, some of them nothing."""
    items = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_linestatus").alias("l_linestatus"), F.min("l_returnflag").alias("l_returnflag"))
    l = items.join(_table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))  # noqa: E741
    empty = F.col("l_linenumber") == 1
    rows = l.select(F.lit("rows").alias("file"), F.col("o_custkey").alias("stmt"), F.row_number().over(resolve.Window.partitionBy("o_custkey").orderBy("l_orderkey", "l_linenumber")).alias("idx"), F.lit(0).alias("origin_ord"), F.col("l_linestatus").alias("expression"), F.col("l_returnflag").alias("target_column"), F.lit(None).cast("string").alias("target_table"), F.when(~empty, F.lit("supplier")).alias("origin_table"), F.when(~empty, _key("l_linenumber")).alias("origin_column"))
    return records.tidied(rows).select("stmt", "idx", "expression", "target_column", "origin_column")


_TIDY_SQL = """WITH r AS (
  SELECT o_custkey AS stmt, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber) AS INTEGER) AS idx, l_linestatus AS expression, l_returnflag AS target_column,
    CASE WHEN l_linenumber <> 1 THEN CAST(l_linenumber AS VARCHAR) END AS origin_column
  FROM (SELECT l_orderkey, l_linenumber, min(l_linestatus) AS l_linestatus, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY l_orderkey, l_linenumber) i JOIN orders ON l_orderkey = o_orderkey),
g AS (SELECT *, max(CASE WHEN origin_column IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY stmt, target_column) AS filled FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY stmt, target_column, origin_column ORDER BY idx) AS n FROM g WHERE origin_column IS NOT NULL OR filled = 0)
SELECT stmt, idx, expression, target_column, origin_column FROM k WHERE n = 1"""


# ---- statements made from rows: a customer or an order is a statement or a query, its orders are the branches,
# ---- its line items the elements, references and origins


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each order and line number: o_orderkey, o_custkey, o_orderstatus, n, flag, status."""
    items = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("flag"), F.min("l_linestatus").alias("status"))
    return items.join(_table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", "o_custkey", "o_orderstatus", F.col("l_linenumber").alias("n"), "flag", "status")


_ITEMS = """i AS (SELECT o_orderkey, o_custkey, o_orderstatus, l_linenumber AS n, min(l_returnflag) AS flag, min(l_linestatus) AS status
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey, o_orderstatus, l_linenumber)"""


def _branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(resolve.Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    return _table(spark, sf_dir, "orders").select(_key("o_custkey").alias("query"), place.alias("branch"), _key("o_orderkey").alias("scope"))


def _outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as projected elements: every fourth has two origins, returned ones have no name."""
    rows = _items(spark, sf_dir).withColumn("origin_ord", F.explode(F.when(F.col("n") % 4 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    name = F.when(F.col("flag") != "R", F.concat("flag", "status"))
    return rows.select(_key("o_orderkey").alias("scope"), F.col("n").alias("proj"), F.lit(0).alias("el"), F.when(F.col("status") == "F", "t.x").otherwise("f(x)").alias("expression"), name.alias("output_column"), "origin_ord", F.lit("part").alias("origin_table"), F.concat(F.lit("p"), _key("n"), F.lit("_"), _key("origin_ord")).alias("origin_column"))


def query_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a query of several branches shows: of elements of one name the first, unnamed ones by their only origin."""
    out = resolve.query_index(_outputs(spark, sf_dir), _branches(spark, sf_dir))
    return out.select("query", "name", F.col("pos.branch").alias("branch"), F.col("pos.proj").alias("proj"), "origin_ord", "origin_table", "origin_column")


_OUTPUTS = f"""{_ITEMS},
e AS (SELECT CAST(o_custkey AS VARCHAR) AS query, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS branch, n AS proj, CASE WHEN flag <> 'R' THEN flag || status END AS output_column,
    status, flag, o_custkey, o_orderkey, CASE WHEN n % 4 = 0 THEN 2 ELSE 1 END AS origins FROM i),
ord AS (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS place FROM orders),
x AS (SELECT e.query, place AS branch, proj, output_column, status, origins, CAST(k AS INTEGER) AS origin_ord, 'p' || proj || '_' || k AS origin_column
  FROM e JOIN ord USING (o_custkey, o_orderkey), unnest(range(origins)) AS u(k))"""
_QUERY_COLUMNS_SQL = f"""WITH {_OUTPUTS},
n AS (SELECT *, coalesce(output_column, CASE WHEN origins = 1 AND status = 'F' THEN origin_column END) AS name FROM x),
f AS (SELECT *, rank() OVER (PARTITION BY query, name ORDER BY branch, proj) AS r FROM n WHERE name IS NOT NULL)
SELECT query, name, branch, proj, origin_ord, 'part' AS origin_table, origin_column FROM f WHERE r = 1"""


def _statements(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    listed = F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("AF"), F.lit("NO"), F.lit("AF"))).otherwise(F.array().cast("array<string>"))
    return _table(spark, sf_dir, "customer").select(F.lit("rows").alias("file"), F.col("c_custkey").alias("stmt"), F.lit(kind).alias("kind"), F.lit("sales").alias("target_table"), listed.alias("target_cols"), _key("c_custkey").alias("root"))


def created_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CREATE TABLE AS of each customer's orders: every origin of every element, numbered through the branches."""
    rows = records.elements(_statements(spark, sf_dir, "ctas"), _outputs(spark, sf_dir), _branches(spark, sf_dir))
    return records.created(rows).select("stmt", "idx", "origin_ord", "target_table", "target_column", "origin_table", "origin_column")


_ELEMENTS = f"""{_OUTPUTS}, d AS (SELECT *, CAST(query AS BIGINT) AS stmt, CAST(dense_rank() OVER (PARTITION BY query ORDER BY branch, proj) - 1 AS INTEGER) AS idx, 'p' || proj || '_0' AS first_column FROM x)"""
_CREATED_SQL = f"WITH {_ELEMENTS} SELECT stmt, idx, origin_ord, CASE WHEN stmt % 3 <> 0 THEN 'sales' END AS target_table, coalesce(output_column, first_column) AS target_column, 'part' AS origin_table, origin_column FROM d"


def inserted_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INSERT of each customer's orders, every third with a column list."""
    rows = records.elements(_statements(spark, sf_dir, "insert"), _outputs(spark, sf_dir), _branches(spark, sf_dir))
    schema = spark.createDataFrame([("rows", "sales", c, i) for i, c in enumerate(("AF", "NO", "p1_0"))], "file string, table_name string, column_name string, ordinal int")
    return records.inserted(rows, schema).select("stmt", "idx", "origin_ord", "target_column", "origin_column")


_CREATED_RESOLVED_SQL = f"WITH {_ELEMENTS} SELECT stmt, idx, origin_ord, 'sales' AS target_table, CASE WHEN stmt % 3 = 0 THEN (['AF', 'NO', 'AF'])[idx + 1] ELSE coalesce(output_column, first_column) END AS target_column, 'part' AS origin_table, origin_column FROM d"
_INSERTED_RESOLVED_SQL = f"""WITH {_ELEMENTS}, p AS (SELECT *, dense_rank() OVER (PARTITION BY query, branch ORDER BY proj) AS place FROM d),
t AS (SELECT *, CASE WHEN stmt % 3 = 0 THEN (['AF', 'NO', 'AF'])[place] ELSE (['AF', 'NO', 'p1_0'])[place] END AS target_column FROM p)
SELECT stmt, idx, origin_ord, target_column, origin_column FROM t WHERE target_column IS NOT NULL"""
_INSERTED_SQL = f"""WITH {_ELEMENTS},
made AS (SELECT stmt, list(name ORDER BY idx) AS cols FROM (SELECT stmt, idx, coalesce(output_column, first_column) AS name FROM d WHERE origin_ord = 0) m WHERE name IN ('AF', 'NO', 'p1_0') GROUP BY stmt),
c AS (SELECT d.*, CASE WHEN d.stmt % 3 = 0 THEN ['AF', 'NO', 'AF'] ELSE coalesce(made.cols, CAST([] AS VARCHAR[])) END AS cols FROM d LEFT JOIN made ON made.stmt = d.stmt),
a AS (SELECT *, cols[idx + 1] AS spot FROM c),
t AS (SELECT *, CASE WHEN idx < len(cols) THEN CASE WHEN spot = first_column OR spot = output_column THEN spot END ELSE output_column END AS placed FROM a)
SELECT stmt, idx, origin_ord, coalesce(placed, CASE WHEN list_contains(cols, output_column) THEN output_column END) AS target_column, origin_column FROM t
WHERE coalesce(placed, CASE WHEN list_contains(cols, output_column) THEN output_column END) IS NOT NULL"""


def assigned_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UPDATE ... FROM of finished orders, MERGE of the others: a line item is an assignment that names one column."""
    rows = _items(spark, sf_dir)
    key = [F.lit("rows").alias("file"), F.col("o_orderkey").alias("stmt")]
    statements = _table(spark, sf_dir, "orders").select(*key, F.when(F.col("o_orderstatus") == "F", "update").otherwise("merge").alias("kind"), F.lit("main.orders").alias("target_table"))
    target = F.concat(F.lit("c"), _key("n"))
    assignments = rows.select(*key, "n", target.alias("target_column"), F.col("status").alias("expression"), F.when(F.col("n") % 2 == 0, "lineitem").alias("from_table"))
    qualifier = F.when(F.col("flag") == "A", "orders").when(F.col("flag") == "R", "lineitem")
    name = F.when(F.col("status") == "F", "o_totalprice").when(F.col("n") % 3 == 0, "l_tax").otherwise("unheard")
    refs = rows.select(*key, "n", F.lit(0).alias("ref_ord"), qualifier.alias("qualifier"), name.alias("name"))
    schema = spark.createDataFrame([("rows", "main.orders", "o_totalprice", 0), ("rows", "lineitem", "l_tax", 0)], "file string, table_name string, column_name string, ordinal int")
    return records.assigned(statements, assignments, refs, schema).select("stmt", "idx", "kind", "target_column", "origin_table", "origin_column")


_ASSIGNED_SQL = f"""WITH {_ITEMS},
r AS (SELECT *, o_orderstatus = 'F' AS up, n % 2 = 0 AS joined, CASE WHEN status = 'F' THEN 'o_totalprice' WHEN n % 3 = 0 THEN 'l_tax' ELSE 'unheard' END AS name FROM i)
SELECT o_orderkey AS stmt, n AS idx, CASE WHEN up THEN 'update' ELSE 'merge' END AS kind, 'c' || n AS target_column, name AS origin_column,
  CASE WHEN up AND flag = 'A' THEN 'main.orders' WHEN up AND flag = 'R' AND joined THEN 'lineitem' WHEN name = 'o_totalprice' THEN 'main.orders' WHEN up AND joined AND name = 'l_tax' THEN 'lineitem' END AS origin_table FROM r"""


def expression_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is an expression: what its nested SELECT (the customer) comes from, then its columns (the line items)."""
    orders, rows = _table(spark, sf_dir, "orders"), _items(spark, sf_dir)
    scope = _key("o_orderkey").alias("scope")
    projections = orders.select(scope, F.lit(0).alias("proj"), F.lit("expression").alias("kind"), F.lit("v").alias("out_name"), F.lit(None).cast("string").alias("qualifier"), F.lit("a + b").alias("expression"), F.lit(False).alias("is_column"))
    table = F.when(F.col("status") == "F", "part").when(F.col("flag") == "A", "supplier")
    answers = rows.select(scope, F.lit(0).alias("proj"), F.col("n").alias("ref_ord"), F.lit(0).alias("ans_ord"), table.alias("origin_table"), F.col("flag").alias("origin_column"))
    subs = orders.filter("o_orderkey % 2 = 0").select(scope, F.lit(0).alias("proj"), F.lit(0).alias("sub_ord"), F.concat(F.lit("c"), _key("o_custkey")).alias("sub_scope"))
    outputs = _table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), _key("c_custkey")).alias("scope"), F.lit(0).alias("proj"), F.lit(0).alias("el"), F.lit("x").alias("expression"), F.lit("x").alias("output_column"), F.lit(0).alias("origin_ord"), F.when(F.col("c_custkey") % 5 > 0, "customer").alias("origin_table"), F.when(F.col("c_custkey") % 5 > 0, F.substring("c_mktsegment", 1, 1)).alias("origin_column"))
    return resolve.projection_origins(projections, answers, subs, outputs).select("scope", "output_column", "origin_ord", "origin_table", "origin_column")


_ORIGINS_SQL = f"""WITH {_ITEMS},
a AS (SELECT o_orderkey, 1 AS part, n AS k, CASE WHEN status = 'F' THEN 'part' WHEN flag = 'A' THEN 'supplier' END AS t, flag AS c FROM i
  UNION ALL SELECT o_orderkey, 0, 0, 'customer', substr(c_mktsegment, 1, 1) FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 2 = 0 AND c_custkey % 5 > 0),
g AS (SELECT o_orderkey, t, c, min(part * 1000 + k) AS place FROM a GROUP BY o_orderkey, t, c),
w AS (SELECT *, bool_or(t IS NOT NULL) OVER (PARTITION BY o_orderkey, c) AS tabled, min(place) OVER (PARTITION BY o_orderkey, c) AS first FROM g),
o AS (SELECT o_orderkey, t, c, CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY first, place) - 1 AS INTEGER) AS k FROM w WHERE t IS NOT NULL OR NOT tabled)
SELECT CAST(orders.o_orderkey AS VARCHAR) AS scope, 'v' AS output_column, coalesce(k, 0) AS origin_ord, t AS origin_table, c AS origin_column FROM orders LEFT JOIN o USING (o_orderkey)"""


def _lone_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer is a scope, of four kinds: one table; two tables; a query and a table; two queries."""
    source = lambda ord_, alias, kind, table=None, child=None: F.struct(F.lit(ord_).alias("src_ord"), F.lit(alias).alias("alias"), F.lit(kind).alias("kind"), F.lit(table).cast("string").alias("table_name"), (F.lit(None) if child is None else child).cast("string").alias("child"))
    own = _key("c_nationkey")
    k = F.col("c_custkey") % 4
    kinds = F.when(k == 0, F.array(source(0, "o", "table", "orders"))).when(k == 1, F.array(source(0, "o", "table", "orders"), source(1, "l", "table", "lineitem")))
    kinds = kinds.when(k == 2, F.array(source(0, "q", "query", child=own), source(1, "l", "table", "lineitem"))).otherwise(F.array(source(0, "q", "query", child=own), source(1, "r", "query", child=own)))
    rows = _table(spark, sf_dir, "customer").select(_key("c_custkey").alias("scope"), F.explode(kinds).alias("s"))
    return rows.select(F.lit("rows").alias("file"), "scope", "s.src_ord", "s.alias", "s.kind", "s.table_name", "s.child", F.array().cast("array<string>").alias("names"))


def resolve_lone_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names asked of one source, of the one table whose schema has them, of queries by alias, and of nobody."""
    scopes = _lone_scopes(spark, sf_dir)
    schema = spark.createDataFrame([("rows", "orders", "o_totalprice", 0), ("rows", "lineitem", "l_tax", 0), ("rows", "lineitem", "l_quantity", 1)], "file string, table_name string, column_name string, ordinal int")
    index = _table(spark, sf_dir, "nation").select(_key("n_nationkey").alias("query"), F.lit("shown").alias("name"), F.struct(F.lit(0).alias("branch"), F.lit(0).alias("proj"), F.lit(0).alias("el")).alias("pos"), F.lit(0).alias("origin_ord"), F.lit("nation").alias("origin_table"), F.col("n_name").alias("origin_column"))
    asked = F.array(*[F.struct(F.lit(i).alias("ref_ord"), F.lit(q).cast("string").alias("qualifier"), F.lit(n).alias("name")) for i, (q, n) in enumerate([(None, "l_tax"), (None, "strange"), ("q", "shown"), ("nobody", "shown"), (None, "shown")])])
    refs = _table(spark, sf_dir, "customer").select(_key("c_custkey").alias("scope"), F.lit(0).alias("proj"), F.explode(asked).alias("r")).select("scope", "proj", "r.*")
    out = resolve.resolve_refs(refs, scopes, resolve.source_columns(scopes, schema, index, None), schema, None)
    return out.select("scope", "ref_ord", "ans_ord", "origin_table", "origin_column")


_LONE_SQL = """WITH c AS (SELECT CAST(c_custkey AS VARCHAR) AS scope, c_custkey % 4 AS k, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey),
a AS (
  SELECT scope, 0 AS ref_ord, CASE WHEN k = 0 THEN 'orders' WHEN k IN (1, 2) THEN 'lineitem' END AS origin_table, 'l_tax' AS origin_column FROM c
  UNION ALL SELECT scope, 1, CASE WHEN k IN (0, 1) THEN 'orders' WHEN k = 2 THEN 'lineitem' END, 'strange' FROM c
  UNION ALL SELECT scope, 2, CASE WHEN k >= 2 THEN 'nation' END, CASE WHEN k >= 2 THEN n_name ELSE 'shown' END FROM c
  UNION ALL SELECT scope, 3, NULL, 'shown' FROM c
  UNION ALL SELECT scope, 4, CASE WHEN k = 0 THEN 'orders' WHEN k = 1 THEN 'orders' WHEN k = 2 THEN 'lineitem' ELSE 'nation' END, CASE WHEN k = 3 THEN n_name ELSE 'shown' END FROM c)
SELECT scope, ref_ord, 0 AS ans_ord, origin_table, origin_column FROM a UNION ALL SELECT scope, 4, 1, 'nation', n_name FROM c WHERE k = 3"""


def resolve_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer is a scope of a query and a table, of VALUES alone, or of VALUES and a table. Names that the query shows come
    from a table whose schema alone has the name (nations) or from one whose schema does not (regions)."""
    c = _table(spark, sf_dir, "customer")
    source = lambda ord_, alias, kind, table=None, child=None, names=(): F.struct(F.lit(ord_).alias("src_ord"), F.lit(alias).alias("alias"), F.lit(kind).alias("kind"), F.lit(table).cast("string").alias("table_name"), (F.lit(None) if child is None else child).cast("string").alias("child"), F.array(*names).cast("array<string>").alias("names"))
    k, orders = F.col("c_custkey") % 4, source(1, "o", "table", "orders")
    values = source(0, "v", "values", names=(F.lit("shown"), F.concat(F.lit("v"), _key("c_nationkey"))))
    kinds = F.when(k == 0, F.array(source(0, "q", "query", child=F.concat(F.lit("n"), _key("c_nationkey"))), orders)).when(k == 1, F.array(source(0, "q", "query", child=F.concat(F.lit("r"), _key("c_nationkey"))), orders)).when(k == 2, F.array(values)).otherwise(F.array(values, orders))
    scopes = c.select(F.lit("rows").alias("file"), _key("c_custkey").alias("scope"), F.explode(kinds).alias("s")).select("file", "scope", "s.*")
    schema = spark.createDataFrame([("rows", "orders", "o_totalprice", 0), ("rows", "nation", "shown", 0)], "file string, table_name string, column_name string, ordinal int")
    pos = F.struct(F.lit(0).alias("branch"), F.lit(0).alias("proj"), F.lit(0).alias("el")).alias("pos")
    shown = lambda tag, t: _table(spark, sf_dir, "nation").select(F.concat(F.lit(tag), _key("n_nationkey")).alias("query"), F.lit("shown").alias("name"), pos, F.lit(0).alias("origin_ord"), F.lit(t).alias("origin_table"), F.col("n_name").alias("origin_column"))
    asked = F.array(*[F.struct(F.lit(i).alias("ref_ord"), F.lit(q).cast("string").alias("qualifier"), F.lit(n).alias("name")) for i, (q, n) in enumerate([(None, "shown"), (None, "o_totalprice"), ("v", "shown"), (None, "strange")])])
    refs = c.select(_key("c_custkey").alias("scope"), F.lit(0).alias("proj"), F.explode(asked).alias("r")).select("scope", "proj", "r.*")
    columns = resolve.source_columns(scopes, schema, shown("n", "nation").unionByName(shown("r", "region")), None)
    return resolve.resolve_refs(refs, scopes, columns, schema, None).select("scope", "ref_ord", "ans_ord", "origin_table", "origin_column")


_RULES_SQL = """WITH c AS (SELECT CAST(c_custkey AS VARCHAR) AS scope, c_custkey % 4 AS k, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT scope, 0 AS ref_ord, 0 AS ans_ord, CASE k WHEN 0 THEN 'nation' WHEN 1 THEN 'orders' END AS origin_table, CASE WHEN k = 0 THEN n_name ELSE 'shown' END AS origin_column FROM c
UNION ALL SELECT scope, 0, 1, 'orders', 'shown' FROM c WHERE k = 3
UNION ALL SELECT scope, 1, 0, CASE WHEN k <> 2 THEN 'orders' END, 'o_totalprice' FROM c
UNION ALL SELECT scope, 2, 0, NULL, 'shown' FROM c
UNION ALL SELECT scope, 3, 0, CASE WHEN k < 2 THEN 'orders' END, 'strange' FROM c UNION ALL SELECT scope, 3, 1, 'orders', 'strange' FROM c WHERE k = 3"""


def bare_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a column without more (every third an expression): line items are what it may come from, most of them nothing."""
    scope = _key("o_orderkey").alias("scope")
    bare = F.col("o_orderkey") % 3 > 0
    projections = _table(spark, sf_dir, "orders").select(scope, F.lit(0).alias("proj"), F.lit("expression").alias("kind"), F.lit("v").alias("out_name"), F.lit(None).cast("string").alias("qualifier"), F.lit("v").alias("expression"), bare.alias("is_column"))
    table, column = F.when((F.col("flag") == "A") & (F.col("n") > 5), "part"), F.when(F.col("n") % 2 == 0, "").otherwise(F.when((F.col("flag") == "A") & (F.col("n") > 5), "p"))
    answers = _items(spark, sf_dir).select(scope, F.lit(0).alias("proj"), F.col("n").alias("ref_ord"), F.lit(0).alias("ans_ord"), table.alias("origin_table"), column.alias("origin_column"))
    return resolve.projection_origins(projections, answers, None, None).select("scope", "origin_ord", "origin_table", "origin_column")


_BARE_SQL = f"""WITH {_ITEMS},
a AS (SELECT o_orderkey, n, CASE WHEN flag = 'A' AND n > 5 THEN 'part' END AS t, CASE WHEN n % 2 = 0 THEN '' WHEN flag = 'A' AND n > 5 THEN 'p' END AS c FROM i),
g AS (SELECT o_orderkey, t, c, min(n) AS place FROM a GROUP BY o_orderkey, t, c),
w AS (SELECT *, bool_or(t IS NOT NULL) OVER (PARTITION BY o_orderkey, c) AS tabled, min(place) OVER (PARTITION BY o_orderkey, c) AS first FROM g),
o AS (SELECT o_orderkey, t, c, CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY first, place) - 1 AS INTEGER) AS k, bool_or(coalesce(t, '') <> '' OR coalesce(c, '') <> '') OVER (PARTITION BY o_orderkey) AS found FROM w WHERE t IS NOT NULL OR NOT tabled),
j AS (SELECT orders.o_orderkey, k, t, c, orders.o_orderkey % 3 > 0 AND NOT coalesce(found, false) AS blank FROM orders LEFT JOIN o USING (o_orderkey))
SELECT CAST(o_orderkey AS VARCHAR) AS scope, coalesce(k, 0) AS origin_ord, CASE WHEN NOT blank THEN t END AS origin_table, CASE WHEN NOT blank THEN c END AS origin_column FROM j WHERE NOT blank OR coalesce(k, 0) = 0"""


def created_columns_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by SQL's rules: a column list names the elements at their place."""
    rows = records.elements(_statements(spark, sf_dir, "ctas"), _outputs(spark, sf_dir), _branches(spark, sf_dir))
    return records.created(rows, "resolved").select("stmt", "idx", "origin_ord", "target_table", "target_column", "origin_table", "origin_column")


def inserted_columns_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INSERT by SQL's rules: the place alone decides, in each branch anew, among the listed columns or the schema's."""
    rows = records.elements(_statements(spark, sf_dir, "insert"), _outputs(spark, sf_dir), _branches(spark, sf_dir))
    schema = spark.createDataFrame([("rows", "sales", c, i) for i, c in enumerate(("AF", "NO", "p1_0"))], "file string, table_name string, column_name string, ordinal int")
    return records.inserted(rows, schema, "resolved").select("stmt", "idx", "origin_ord", "target_column", "origin_column")


def resolve_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of a table behind a pivot, for each customer: generated ones come from what the aggregate mentions, or from all."""
    c = _table(spark, sf_dir, "customer")
    sources = c.select(F.lit("rows").alias("file"), _key("c_custkey").alias("scope"), F.lit(0).alias("src_ord"), F.lit("o").alias("alias"), F.lit("table").alias("kind"), F.lit("orders").alias("table_name"), F.lit(None).cast("string").alias("child"), F.array().cast("array<string>").alias("names"))
    mentioned = F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("o_totalprice"))).otherwise(F.array().cast("array<string>"))
    pivots = c.filter("c_custkey % 3 > 0").select(_key("c_custkey").alias("scope"), F.lit(0).alias("src_ord"), F.array(F.substring("c_mktsegment", 1, 3), F.lit("o_custkey")).alias("names"), mentioned.alias("refs"))
    schema = spark.createDataFrame([("rows", "orders", n, i) for i, n in enumerate(("o_orderkey", "o_custkey", "o_totalprice"))], "file string, table_name string, column_name string, ordinal int")
    out = resolve.source_columns(sources, schema, spark.createDataFrame([], _NO_INDEX), pivots)
    return out.select("scope", "name", "origin_ord", "origin_table", "origin_column")


_PIVOTS_SQL = """WITH b AS (SELECT * FROM (VALUES ('o_orderkey', 0), ('o_custkey', 1), ('o_totalprice', 2)) v(name, k)),
c AS (SELECT CAST(c_custkey AS VARCHAR) AS scope, c_custkey % 3 > 0 AS pivoted, c_custkey % 2 = 0 AS mentions, substr(c_mktsegment, 1, 3) AS made FROM customer)
SELECT scope, name, 0 AS origin_ord, 'orders' AS origin_table, name AS origin_column FROM c, b WHERE NOT (pivoted AND name = 'o_custkey')
UNION ALL SELECT scope, m, CASE WHEN mentions THEN 0 ELSE k END, 'orders', name FROM c, b, unnest([made, 'o_custkey']) AS u(m) WHERE pivoted AND (NOT mentions OR name = 'o_totalprice')"""


def records_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a record stands in its statement's result: targets in order of first appearance, then their origins."""
    rows = _items(spark, sf_dir).select(F.lit("rows").alias("file"), F.col("o_orderkey").alias("stmt"), F.col("n").alias("idx"), F.lit(0).alias("origin_ord"), F.lit("e").alias("expression"), F.col("flag").alias("target_column"), F.lit(None).cast("string").alias("target_table"), F.lit("part").alias("origin_table"), _key("n").alias("origin_column"))
    place = F.row_number().over(resolve.Window.partitionBy("file", "stmt").orderBy("target_seq", "seq"))
    return records.tidied(rows).select("stmt", "target_column", "origin_column", place.alias("place"))


_ORDER_SQL = f"""WITH {_ITEMS}, f AS (SELECT *, min(n) OVER (PARTITION BY o_orderkey, flag) AS first FROM i)
SELECT o_orderkey AS stmt, flag AS target_column, CAST(n AS VARCHAR) AS origin_column, CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY first, n) AS INTEGER) AS place FROM f"""


def update_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return dml.update(o, F.col("o_orderstatus") == "O", {"o_totalprice": F.col("o_totalprice") * 2, "o_orderstatus": F.lit("P")})


def merge_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    half = c.filter("c_custkey % 2 = 0")
    news = c.select("c_custkey", (F.col("c_nationkey") + 100).alias("c_nationkey"), (F.col("c_acctbal") * 2).alias("c_acctbal")).filter("c_custkey % 3 = 0")
    return dml.merge(half, news, ["c_custkey"], {"c_acctbal": F.col("s.c_acctbal")})


def insert_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    s = _table(spark, sf_dir, "supplier").select(F.col("s_name").alias("c_name"), F.col("s_suppkey").alias("c_custkey"), F.col("s_nationkey").alias("ignored"))
    return dml.insert(c, s)


def ctas_then_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = _table(spark, sf_dir, "customer").filter("c_acctbal > 0").select("c_custkey", F.upper("c_name").alias("n"))
    rich.createOrReplaceTempView("tracewell_rich")
    return spark.sql("SELECT substr(n, 1, 8) AS stem, count(*) AS k FROM tracewell_rich GROUP BY substr(n, 1, 8)")


#: Constructs whose lineage the engine follows, run on data: the same text for Spark and for DuckDB.
_MONEY = "CAST(sum(CAST({} AS DECIMAL(18, 2))) AS DOUBLE)"
SQL = {
    "exec_inner_join": "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey",
    "exec_left_join": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F'",
    "exec_right_join": "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey AND o_totalprice > 100000",
    "exec_full_join": "SELECT c_custkey, s_suppkey FROM customer FULL JOIN supplier ON c_custkey = s_suppkey",
    "exec_cross_join": "SELECT s_suppkey, r_name FROM supplier CROSS JOIN region",
    "exec_using": "SELECT k, a, b FROM (SELECT c_nationkey AS k, count(*) AS a FROM customer GROUP BY c_nationkey) x JOIN (SELECT s_nationkey AS k, count(*) AS b FROM supplier GROUP BY s_nationkey) y USING (k)",
    "exec_semi": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "exec_anti": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "exec_theta": "SELECT n_name, count(*) AS k FROM nation JOIN supplier ON s_nationkey <= n_nationkey AND s_acctbal > 0 GROUP BY n_name",
    "exec_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "exec_union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier",
    "exec_intersect": "SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders",
    "exec_except": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders",
    "exec_cte_chain": f"WITH a AS (SELECT o_custkey, {_MONEY.format('o_totalprice')} AS total FROM orders GROUP BY o_custkey), b AS (SELECT o_custkey, total FROM a WHERE total > 100000) SELECT c_name, total FROM b JOIN customer ON o_custkey = c_custkey",
    "exec_derived": "SELECT q.k, q.n FROM (SELECT l_suppkey AS k, count(*) AS n FROM lineitem GROUP BY l_suppkey) q WHERE q.n > 10",
    "exec_scalar_subquery": "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT max(o_totalprice) * 0.9 FROM orders)",
    "exec_correlated": "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer",
    "exec_case": "SELECT o_orderkey, CASE WHEN o_totalprice > 150000 THEN 'LARGE' WHEN o_totalprice > 50000 THEN 'MEDIUM' ELSE 'SMALL' END AS size_flag, upper(o_orderpriority) AS p FROM orders",
    "exec_expressions": "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, coalesce(nullif(l_returnflag, 'N'), '-') AS flag FROM lineitem",
    "exec_aggregate": f"SELECT l_returnflag, l_linestatus, {_MONEY.format('l_quantity')} AS sum_qty, min(l_extendedprice) AS low, max(l_extendedprice) AS high, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "exec_count_distinct": "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag",
    "exec_filtered_aggregate": "SELECT event_type, count(*) FILTER (WHERE value > 50) AS large, count(*) AS n FROM events GROUP BY event_type",
    "exec_having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15",
    "exec_rollup": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "exec_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "exec_grouping_sets": "SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand), (p_type), ())",
    "exec_window": "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS place FROM orders",
    "exec_window_frame": "SELECT o_orderkey, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS recent FROM orders",
    "exec_lag": "SELECT event_id, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events",
    "exec_top_of_group": "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) x WHERE r <= 3",
    "exec_distinct": "SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem",
    "exec_order_limit": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100",
    "exec_values_join": "SELECT o_orderkey, v.label FROM orders JOIN (VALUES ('F', 'done'), ('O', 'open')) AS v(code, label) ON o_orderstatus = v.code",
    "exec_recursive": "WITH RECURSIVE c(k, up, depth) AS (SELECT c_custkey, c_custkey, 0 FROM customer UNION ALL SELECT k, up DIV_BY_TWO, depth + 1 FROM c WHERE up > 1) SELECT k, max(depth) AS depth FROM c GROUP BY k",
}


def _sql(text: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for name in TABLES:
            _table(spark, sf_dir, name).createOrReplaceTempView(name)
        return spark.sql(text.replace("up DIV_BY_TWO", "up div 2"))

    return run


def _recursive(text: str) -> Query:
    """A recursive query whose rounds end by themselves: while it runs, the session's limit of their rows is lifted."""
    limit = "spark.sql.cteRecursionRowLimit"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        before = spark.conf.get(limit, None)
        spark.conf.set(limit, "-1")
        try:
            return checkpointed(_sql(text)(spark, sf_dir))
        finally:
            if before is None:
                spark.conf.unset(limit)
            else:
                spark.conf.set(limit, before)

    return run


def pivot_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    return o.groupBy("o_custkey").pivot("o_orderstatus", ["F", "O"]).agg(F.count(F.lit(1))).select("o_custkey", F.coalesce("F", F.lit(0)).alias("done"), F.coalesce("O", F.lit(0)).alias("open"))


def unpivot_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").unpivot("p_partkey", ["p_brand", "p_type"], "what", "value")


QUERIES: dict[str, Query] = {
    "chain_created_tables": lambda s, d: chains.created_tables(named(s, d)),
    "chain_base_tables": lambda s, d: chains.base_tables(named(s, d)),
    "chain_edges": lambda s, d: chains.edges(provenance(s, d)).select(F.col("source.table").alias("source_table"), F.col("source.column").alias("source_column"), F.col("target.table").alias("target_table"), F.col("target.column").alias("target_column"), "from_base"),
    "chain_final_outputs": lambda s, d: chains.final_outputs(named(s, d)),
    "chain_paths": lambda s, d: _paths_as_text(chains.chain_paths(provenance(s, d))),
    "chain_steps": lambda s, d: chains.chain_steps(provenance(s, d)),
    "chain_summary": lambda s, d: chains.summary(provenance(s, d)),
    "chain_fanout": lambda s, d: chains.fanout(provenance(s, d)),
    "chain_cycle_nodes": lambda s, d: chains.cycle_nodes(circuits(s, d)).select(F.col("table").alias("table_name"), F.col("column").alias("column_name")),
    "chain_tangled_steps": lambda s, d: chains.chain_steps(tangled(s, d)),
    "chain_tangled_fanout": lambda s, d: chains.fanout(tangled(s, d)),
    "chain_trace": traced_columns,
    "resolve_names": resolve_names,
    "resolve_stars": resolve_stars,
    "resolve_lone_names": resolve_lone_names,
    "resolve_query_columns": query_columns,
    "resolve_origins": expression_origins,
    "resolve_pivots": resolve_pivots,
    "records_tidied": tidy_records,
    "records_in_order": records_in_order,
    "records_created": created_columns,
    "records_inserted": inserted_columns,
    "records_assigned": assigned_columns,
    "resolve_rules": resolve_rules,
    "resolve_bare_columns": bare_columns,
    "records_created_resolved": created_columns_resolved,
    "records_inserted_resolved": inserted_columns_resolved,
    "exec_update": update_orders,
    "exec_merge": merge_customers,
    "exec_insert": insert_suppliers,
    "exec_ctas": ctas_then_select,
    "exec_pivot": pivot_orders,
    "exec_unpivot": unpivot_parts,
} | {name: (_recursive if "RECURSIVE" in text else _sql)(text) for name, text in SQL.items()}

ORACLES: dict[str, str] = {
    "chain_created_tables": f"WITH {_NAMED} SELECT 'nation' AS table_name WHERE EXISTS (SELECT 1 FROM nation) UNION ALL SELECT 'customer' WHERE EXISTS (SELECT 1 FROM customer) UNION ALL SELECT 'orders' WHERE EXISTS (SELECT 1 FROM orders) UNION ALL SELECT tt FROM made",
    "chain_base_tables": f"WITH {_NAMED} SELECT 'region' AS table_name WHERE EXISTS (SELECT 1 FROM nation) UNION ALL SELECT DISTINCT st FROM n WHERE st NOT IN (SELECT tt FROM made)",
    "chain_edges": "SELECT 'region' AS source_table, CAST(n_regionkey AS VARCHAR) AS source_column, 'nation' AS target_table, CAST(n_nationkey AS VARCHAR) AS target_column, true AS from_base FROM nation UNION SELECT 'nation', CAST(c_nationkey AS VARCHAR), 'customer', CAST(c_custkey AS VARCHAR), false FROM customer UNION SELECT 'customer', CAST(o_custkey AS VARCHAR), 'orders', CAST(o_orderkey AS VARCHAR), false FROM orders UNION SELECT 'orders', CAST(o_orderkey AS VARCHAR), '', o_orderpriority, false FROM orders",
    "chain_final_outputs": f"WITH {_NAMED} SELECT '' AS target_table, o_orderpriority AS target_column FROM orders UNION SELECT '', tc FROM n WHERE tt = '' UNION SELECT tt, tc FROM n WHERE tt <> '' AND NOT EXISTS (SELECT 1 FROM n u WHERE u.st = n.tt AND u.sc = n.tc) UNION ALL SELECT 'nation', CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer) UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "chain_paths": f"WITH f AS ({_FULL}) SELECT 'region.' || r || '>nation.' || n || '>customer.' || c || '>orders.' || o || '>.' || p AS path FROM f UNION ALL SELECT 'region.' || n_regionkey || '>nation.' || n_nationkey || '>customer.' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'region.' || n_regionkey || '>nation.' || n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer)",
    "chain_cycle_nodes": "SELECT 'customer' AS table_name, CAST(c_custkey AS VARCHAR) AS column_name FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT DISTINCT 'nation', CAST(c_nationkey AS VARCHAR) FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR) FROM supplier",
    "chain_tangled_steps": _TANGLED_STEPS,
    "chain_tangled_fanout": _TANGLED_FANOUT,
    "chain_trace": _TRACED_SQL,
    "resolve_names": _NAMES_SQL,
    "resolve_stars": _STARS_SQL,
    "resolve_lone_names": _LONE_SQL,
    "resolve_query_columns": _QUERY_COLUMNS_SQL,
    "resolve_origins": _ORIGINS_SQL,
    "resolve_pivots": _PIVOTS_SQL,
    "records_tidied": _TIDY_SQL,
    "records_in_order": _ORDER_SQL,
    "records_created": _CREATED_SQL,
    "records_inserted": _INSERTED_SQL,
    "records_assigned": _ASSIGNED_SQL,
    "resolve_rules": _RULES_SQL,
    "resolve_bare_columns": _BARE_SQL,
    "records_created_resolved": _CREATED_RESOLVED_SQL,
    "records_inserted_resolved": _INSERTED_RESOLVED_SQL,
    "exec_update": "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'P' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderstatus = 'O' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM orders",
    "exec_merge": "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey ELSE c_nationkey + 100 END AS c_nationkey, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal * 2 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0",
    "exec_insert": "SELECT c_custkey, c_name, c_acctbal FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier",
    "exec_ctas": "SELECT substr(upper(c_name), 1, 8) AS stem, count(*) AS k FROM customer WHERE c_acctbal > 0 GROUP BY 1",
    "exec_pivot": "SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, count(*) FILTER (WHERE o_orderstatus = 'O') AS open FROM orders GROUP BY o_custkey",
    "exec_unpivot": "SELECT p_partkey, 'p_brand' AS what, p_brand AS value FROM part UNION ALL SELECT p_partkey, 'p_type', p_type FROM part",
} | {name: text.replace("up DIV_BY_TWO", "up // 2") for name, text in SQL.items()}
_ALL_STEPS = f"""WITH f AS ({_FULL}), a AS (
  SELECT 'region' AS source_table, r AS source_column, 'nation' AS target_table, n AS target_column, r, '' AS ut, p AS uc, 1 AS t, 4 AS b FROM f
  UNION SELECT 'nation', n, 'customer', c, r, '', p, 2, 3 FROM f UNION SELECT 'customer', c, 'orders', o, r, '', p, 3, 2 FROM f UNION SELECT 'orders', o, '', p, r, '', p, 4, 1 FROM f),
i AS (SELECT CAST(n_regionkey AS VARCHAR) AS r, CAST(n_nationkey AS VARCHAR) AS n, CAST(c_custkey AS VARCHAR) AS c FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)),
e AS (SELECT CAST(n_regionkey AS VARCHAR) AS r, CAST(n_nationkey AS VARCHAR) AS n FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer)),
s AS (SELECT * FROM a UNION SELECT 'region', r, 'nation', n, r, 'customer', c, 1, 2 FROM i UNION SELECT 'nation', n, 'customer', c, r, 'customer', c, 2, 1 FROM i UNION SELECT 'region', r, 'nation', n, r, 'nation', n, 1, 1 FROM e)"""
ORACLES |= {
    "chain_steps": f"{_ALL_STEPS} SELECT source_table, source_column, target_table, target_column, 'region' AS ultimate_source_table, r AS ultimate_source_column, ut AS ultimate_target_table, uc AS ultimate_target_column, t AS level_top_to_bottom, b AS level_bottom_to_top FROM s",
    "chain_summary": f"{_ALL_STEPS} SELECT count(*) AS steps, count(DISTINCT r) AS sources, count(DISTINCT ut || '/' || uc) AS targets, CAST(count(*) FILTER (WHERE t > 1 OR b > 1) AS BIGINT) AS multi_level_steps, max(t) AS deepest FROM s",
    "chain_fanout": f"{_ALL_STEPS} SELECT 'region' AS ultimate_source_table, r AS ultimate_source_column, count(DISTINCT ut || '/' || uc) AS targets FROM s GROUP BY r",
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All source-to-target steps of the provenance of rows."""
    return chains.chain_steps(provenance(spark, sf_dir))
