"""Name resolution: which physical columns a projection's columns come from.

Scopes are resolved level by level, all scopes of a level in one set of joins. The result of a level,
``outputs``, is what the scopes above see: scope, proj, el (elements of a star in order), expression,
output_column, origin_ord, origin_table, origin_column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OUTPUTS = "scope string, proj int, el int, expression string, output_column string, origin_ord int, origin_table string, origin_column string"

#: Column prefixes and the tables they speak for, used only where such a table takes part.
PREFIXES = [
    ("ss_", "store_sales"),
    ("sr_", "store_returns"),
    ("cs_", "catalog_sales"),
    ("ws_", "web_sales"),
    ("i_", "item"),
    ("d_", "date_dim"),
    ("c_", "customer"),
    ("ca_", "customer_address"),
    ("s_", "store"),
]


def _first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", n).filter("_n = 1").drop("_n")


def query_index(outputs: DataFrame, branches: DataFrame) -> DataFrame:
    """What a query shows: query, name, pos, origin_ord, origin_table, origin_column; the first element of a name counts.

    Elements without a name show their only origin's column if their text is qualified.
    """
    rows = outputs.join(branches.select("query", "branch", "scope"), "scope")
    element = ["query", "branch", "proj", "el"]
    only = F.count("*").over(Window.partitionBy(*element)) == 1
    name = F.coalesce("output_column", F.when(only & F.contains("expression", F.lit(".")), F.col("origin_column")))
    rows = rows.withColumn("name", name).filter(F.col("name").isNotNull() & (F.col("name") != "*"))
    at = F.struct("branch", "proj", "el")
    rows = rows.withColumn("at", at).withColumn("first", F.min("at").over(Window.partitionBy("query", "name"))).filter("at = first")
    return rows.select("query", "name", F.col("at").alias("pos"), "origin_ord", "origin_table", "origin_column")


def source_columns(sources: DataFrame, catalog: DataFrame, index: DataFrame | None, pivots: DataFrame | None, values: bool = True) -> DataFrame:
    """Every known column of every source: scope, src_ord, alias, col_ord, name, origin_ord, origin_table, origin_column.

    Where no source is a query, none is behind a pivot or none is VALUES, ``index`` or ``pivots`` may be None and ``values`` false.
    """
    keep = ["scope", "src_ord", "alias"]
    none = F.lit(None).cast("string")
    place = lambda kind, ord_: F.struct(F.lit(kind).alias("part"), ord_.alias("branch"), F.lit(0).alias("proj"), F.lit(0).alias("el"))
    tables = sources.filter("kind = 'table'").join(catalog, ["file", "table_name"])
    tables = tables.select(*keep, place(0, F.col("ordinal")).alias("col_ord"), F.col("column_name").alias("name"), F.lit(0).alias("origin_ord"), F.col("table_name").alias("origin_table"), F.col("column_name").alias("origin_column"))
    base = tables
    if index is not None:
        queries = sources.filter("kind = 'query'").join(index, F.col("child") == F.col("query"))
        base = base.unionByName(queries.select(*keep, F.struct(F.lit(0).alias("part"), "pos.branch", "pos.proj", "pos.el").alias("col_ord"), "name", "origin_ord", "origin_table", "origin_column"))
    if values:
        given = sources.filter("kind = 'values'").select(*keep, F.posexplode("names").alias("i", "name"))
        base = base.unionByName(given.select(*keep, place(0, F.col("i")).alias("col_ord"), "name", F.lit(0).alias("origin_ord"), none.alias("origin_table"), F.col("name").alias("origin_column")))
    if pivots is None:
        return base
    # generated columns of a pivot: all columns its aggregates mention, or all base columns if they mention none
    pivoted = pivots.select("scope", "src_ord", F.col("names").alias("made"), "refs").join(sources.select(*keep, "kind", "table_name"), ["scope", "src_ord"])
    mentioned = pivoted.select(*keep, "made", "kind", "table_name", F.posexplode("refs").alias("ref_ord", "name"))
    from_base = mentioned.filter("kind <> 'table'").join(base.select("scope", "src_ord", "name", "origin_ord", "origin_table", "origin_column"), ["scope", "src_ord", "name"])
    found = mentioned.filter("kind = 'table'").select(*keep, "made", "ref_ord", F.lit(0).alias("origin_ord"), F.col("table_name").alias("origin_table"), F.col("name").alias("origin_column"))
    found = found.unionByName(from_base.select(*keep, "made", "ref_ord", "origin_ord", "origin_table", "origin_column"))
    every = pivoted.join(found.select("scope", "src_ord").distinct(), ["scope", "src_ord"], "left_anti").select(*keep, "made")
    every = every.join(base.select("scope", "src_ord", F.col("col_ord.branch").alias("ref_ord"), "origin_ord", "origin_table", "origin_column"), ["scope", "src_ord"])
    found = found.unionByName(every.select(*found.columns))
    found = _first(found, ["scope", "src_ord", "origin_table", "origin_column"], ["ref_ord", "origin_ord"])
    number = (F.row_number().over(Window.partitionBy("scope", "src_ord").orderBy("ref_ord", "origin_ord", "origin_table", "origin_column")) - 1).alias("origin_ord")
    made = found.select(*keep, "made", number, "origin_table", "origin_column").select(*keep, F.posexplode("made").alias("i", "name"), "origin_ord", "origin_table", "origin_column")
    made = made.select(*keep, place(1, F.col("i")).alias("col_ord"), "name", "origin_ord", "origin_table", "origin_column")
    hidden = made.select("scope", "src_ord", "name").distinct()
    return base.join(hidden, ["scope", "src_ord", "name"], "left_anti").select(*made.columns).unionByName(made)


def expand_stars(projections: DataFrame, columns: DataFrame) -> DataFrame:
    """Rows of ``outputs`` for * and alias.*: each source's known columns in order, one element for each origin."""
    stars = projections.filter("kind in ('star', 'qualified')")
    rows = stars.join(columns, "scope").filter((F.col("kind") == "star") | (F.col("qualifier") == F.col("alias")))
    el = F.row_number().over(Window.partitionBy("scope", "proj").orderBy("src_ord", "col_ord", "origin_ord")) - 1
    return rows.select("scope", "proj", el.alias("el"), "expression", F.col("name").alias("output_column"), F.lit(0).alias("origin_ord"), "origin_table", "origin_column")


def _scoped(sources: DataFrame, columns: DataFrame, pivots: DataFrame | None) -> DataFrame:
    """One row for each scope: file, s (its sources in order), k (the columns they show, with origins), pv (sources behind a pivot)."""
    source = F.struct("src_ord", "alias", "kind", "table_name").alias("s")
    shown = F.struct("name", "src_ord", "origin_ord", F.col("origin_table").alias("t"), F.col("origin_column").alias("c")).alias("k")
    rows = sources.select("scope", "file", source, F.lit(None).cast("int").alias("pv")).unionByName(columns.select("scope", shown), allowMissingColumns=True)
    if pivots is not None:
        rows = rows.unionByName(pivots.select("scope", F.col("src_ord").alias("pv")), allowMissingColumns=True)
    return rows.groupBy("scope").agg(F.max("file").alias("file"), F.array_sort(F.collect_list("s")).alias("s"), F.array_sort(F.collect_list("k")).alias("k"), F.collect_set("pv").alias("pv"))


def _let(steps: list[dict[str, str]]) -> str:
    """One SQL expression of several steps, each a struct of the fields so far and its own; a step names earlier fields as ``o.field``.

    Every step is written once, however often later ones name it, so the expression stays as long as its steps.
    """
    out, known = "", []
    for k, step in enumerate(steps):
        named = lambda text: text.replace("o.", f"o{k}.")  # noqa: E731, B023
        fields = [f"'{f}', o{k}.{f}" for f in known if f not in step] + [f"'{f}', {named(text)}" for f, text in step.items()]
        body = f"named_struct({', '.join(fields)})"
        out = f"transform(array({out}), o{k} -> {body})[0]" if out else body
        known += [f for f in step if f not in known]
    return out


def _answered(asked: DataFrame) -> DataFrame:
    """Adds what the sources answer (ans) and, where the first rules settle it, the answer (settled); else the tables in question."""
    kind = "array<struct<src_ord:int,origin_ord:int,t:string,c:string>>"
    answer = lambda a, b, t, c: f"named_struct('src_ord', {a}, 'origin_ord', {b}, 't', {t}, 'c', {c})"
    shown = f"transform(filter(o.mine, y -> y.src_ord = x.src_ord), y -> {answer('y.src_ord', 'y.origin_ord', 'y.t', 'y.c')})"
    blind = "array(" + answer("x.src_ord", "0", "CASE WHEN x.kind = 'table' THEN x.table_name END", "name") + ")"
    per_source = f"CASE WHEN exists(o.mine, y -> y.src_ord = x.src_ord) THEN {shown} WHEN x.kind IN ('table', 'values') THEN {blind} ELSE CAST(array() AS {kind}) END"
    prefixes = ", ".join(f"named_struct('prefix', '{p}', 'means', '{m}')" for p, m in sorted(PREFIXES, key=lambda x: (-len(x[0]), x[0])))
    one = lambda t: f"CAST(array({answer(0, 0, t, 'name')}) AS {kind})"
    steps = [
        {"srcs": "coalesce(s, CAST(array() AS array<struct<src_ord:int,alias:string,kind:string,table_name:string>>))", "mine": "coalesce(filter(k, y -> y.name = name), array())"},
        {"n": "size(o.srcs)", "asks": "CASE WHEN qualifier IS NULL THEN o.srcs ELSE slice(filter(o.srcs, x -> x.alias = qualifier), 1, 1) END", "direct": "filter(o.srcs, x -> x.kind = 'table' AND NOT array_contains(pv, x.src_ord))"},
        {"ans": f"CAST(flatten(transform(o.asks, x -> {per_source})) AS {kind})", "hits": "transform(filter(o.direct, x -> exists(o.mine, y -> y.src_ord = x.src_ord)), x -> x.table_name)", "taking": "transform(o.direct, x -> x.table_name)"},
        {"meant": f"filter(array({prefixes}), p -> startswith(name, p.prefix) AND exists(o.taking, t -> endswith(t, p.means)))"},
        {"settled": f"CASE WHEN qualifier IS NOT NULL OR o.n = 1 THEN o.ans WHEN size(o.hits) = 1 THEN {one('o.hits[0]')} WHEN size(o.meant) > 0 THEN {one('o.meant[0].means')} END"},
        {"tables": "CASE WHEN o.settled IS NULL THEN array_distinct(filter(transform(o.ans, a -> a.t), t -> t IS NOT NULL)) ELSE CAST(array() AS array<string>) END"},
        {"open": "CASE WHEN size(o.tables) > 1 THEN array_except(o.tables, o.taking) ELSE CAST(array() AS array<string>) END"},
    ]
    rows = asked.withColumn("r", F.expr(_let(steps)))
    return rows.select("scope", "proj", "ref_ord", "qualifier", "name", "file", F.col("r.n").alias("n_sources"), *[f"r.{c}" for c in ("ans", "hits", "taking", "settled", "tables", "open")])


def resolve_refs(refs: DataFrame, sources: DataFrame, columns: DataFrame, catalog: DataFrame, pivots: DataFrame | None, through: bool = True) -> DataFrame:
    """refs (scope, proj, ref_ord, qualifier, name) -> scope, proj, ref_ord, ans_ord, origin_table, origin_column.

    A qualified name is asked of the first source of that alias, an unqualified one of the only source. Among
    several sources the one table whose schema has the column decides, then the prefix of the name, then what
    the sources answer: of several tables the one whose schema alone has it, else the first table.

    A scope's sources and columns are one row; references join it by scope, so a scope of very many references is split as
    any skewed join, and the rules are functions over the arrays of that row. Only tables that came through
    queries are looked up in the catalog, for the references they leave open (``through``: whether there may be any).
    """
    ref = ["scope", "proj", "ref_ord"]
    asked = _answered(refs.select(*ref, "qualifier", "name").join(_scoped(sources, columns, pivots), "scope", "left"))
    if not through:
        return _chosen(asked.withColumn("having", F.col("hits")), ref)
    closed, left = asked.filter(F.size("open") == 0), asked.filter(F.size("open") > 0)
    listed = catalog.select("file", F.col("table_name").alias("t"), F.col("column_name").alias("name"))
    having = left.select(*ref, "file", "name", F.explode("open").alias("t")).join(listed, ["file", "t", "name"]).groupBy(*ref).agg(F.collect_set("t").alias("more"))
    both = closed.withColumn("more", F.array().cast("array<string>")).unionByName(left.join(having, ref, "left"))
    return _chosen(both.withColumn("having", F.array_distinct(F.concat("hits", F.coalesce("more", F.array().cast("array<string>"))))), ref)


def _chosen(both: DataFrame, ref: list[str]) -> DataFrame:
    """Of what the sources answer what the last rules leave, by the tables that have the name (having)."""
    steps = [
        {"first": "filter(ans, a -> array_contains(taking, a.t))"},
        {"table": "CASE WHEN size(tables) <= 1 THEN NULL WHEN size(having) = 1 THEN having[0] WHEN size(o.first) > 0 THEN array_min(o.first).t END"},
        {"found": "coalesce(settled, CASE WHEN o.table IS NULL THEN ans ELSE filter(ans, a -> a.t = o.table) END)"},
        # a name that nobody answers stands for itself, but for one that an only source does not show
        {"all": "CASE WHEN size(o.found) = 0 AND (qualifier IS NOT NULL OR n_sources <> 1) THEN array(struct(0 AS src_ord, 0 AS origin_ord, CAST(NULL AS string) AS t, name AS c)) ELSE array_sort(o.found) END"},
    ]
    rows = both.select(*ref, F.expr(_let(steps))["all"].alias("all"))
    return rows.select(*ref, F.posexplode_outer("all").alias("ans_ord", "a")).filter("ans_ord is not null").select(*ref, "ans_ord", F.col("a.t").alias("origin_table"), F.col("a.c").alias("origin_column"))


def _concrete(t: Column, c: Column) -> Column:
    return (F.coalesce(t, F.lit("")) != "") | (F.coalesce(c, F.lit("")) != "")


def projection_origins(projections: DataFrame, answers: DataFrame, subs: DataFrame | None, outputs: DataFrame | None) -> DataFrame:
    """Rows of ``outputs`` for expressions: what nested SELECTs come from, then the columns, each origin once.

    Of the origins of one column name those with a table win. An expression of nothing has one empty origin.
    """
    key = ["scope", "proj"]
    expressions = projections.filter("kind = 'expression'")
    nested = None if subs is None else subs.join(outputs.withColumnsRenamed({"scope": "sub_scope", "proj": "sub_proj"}), "sub_scope").filter(_concrete(F.col("origin_table"), F.col("origin_column")))
    nested = None if nested is None else nested.select(*key, F.struct(F.lit(0).alias("a"), F.col("sub_ord").alias("b"), F.col("sub_proj").alias("c"), F.col("el").alias("d"), F.col("origin_ord").alias("e")).alias("at"), "origin_table", "origin_column")
    direct = answers.select(*key, F.struct(F.lit(1).alias("a"), F.col("ref_ord").alias("b"), F.lit(0).alias("c"), F.lit(0).alias("d"), F.col("ans_ord").alias("e")).alias("at"), "origin_table", "origin_column")
    rows = (direct if nested is None else nested.unionByName(direct)).join(expressions.select(*key), key)
    rows = rows.groupBy(*key, "origin_table", "origin_column").agg(F.min("at").alias("at"))
    named = Window.partitionBy(*key, "origin_column")
    rows = rows.withColumns({"tabled": F.max(F.col("origin_table").isNotNull().cast("int")).over(named), "group": F.min("at").over(named)})
    rows = rows.filter((F.col("tabled") == 0) | F.col("origin_table").isNotNull())
    everything = Window.partitionBy(*key)
    some = F.max(_concrete(F.col("origin_table"), F.col("origin_column")).cast("int")).over(everything)
    rows = rows.withColumn("some", some)
    ordinal = F.row_number().over(Window.partitionBy(*key).orderBy("group", "at")) - 1
    rows = rows.select(*key, ordinal.alias("origin_ord"), "origin_table", "origin_column", "some")
    out = expressions.join(rows, key, "left")
    blank = F.col("is_column") & (F.coalesce("some", F.lit(0)) == 0)
    out = out.filter(~blank | (F.coalesce("origin_ord", F.lit(0)) == 0))
    pick = lambda c: F.when(~blank, F.col(c)).alias(c)
    return out.select(*key, F.lit(0).alias("el"), "expression", F.col("out_name").alias("output_column"), F.coalesce("origin_ord", F.lit(0)).alias("origin_ord"), pick("origin_table"), pick("origin_column"))


def resolve(relations: dict[str, DataFrame], catalog: DataFrame, cut) -> DataFrame:
    """outputs of all scopes. catalog: file, table_name, column_name, ordinal; ``cut`` shortens the plan after each level.

    What no statement has (pivots, VALUES, nested SELECTs, stars, queries as sources) has no part in the plans.
    """
    spark: SparkSession = catalog.sparkSession
    branches, done = relations["branches"], []
    top = branches.agg(F.max("level")).first()[0]
    if top is None:
        return spark.createDataFrame([], OUTPUTS)
    some = {name: not relations[name].isEmpty() for name in ("pivots", "subs")}
    kinds = {r["kind"] for r in relations["sources"].select("kind").union(relations["projections"].select("kind")).distinct().collect()}
    for level in range(top + 1):
        here = {name: relations[name] for name in ("sources", "pivots", "projections", "refs", "subs")}
        if top:
            scopes = branches.filter(F.col("level") == level).select("scope").distinct()
            here = {name: rows.join(scopes, "scope", "left_semi") for name, rows in here.items()}
        outputs = reduce(DataFrame.unionByName, done) if done else None
        index = None
        if level and "query" in kinds:
            ready = branches.withColumn("top", F.max("level").over(Window.partitionBy("query"))).filter(F.col("top") < level)
            index = query_index(outputs, ready)
        pivots = here["pivots"] if some["pivots"] else None
        columns = cut(source_columns(here["sources"], catalog, index, pivots, "values" in kinds))
        answers = resolve_refs(here["refs"], here["sources"], columns, catalog, pivots, index is not None or pivots is not None)
        new = projection_origins(here["projections"], answers, here["subs"] if some["subs"] and level else None, outputs)
        if kinds & {"star", "qualified"}:
            new = expand_stars(here["projections"], columns).unionByName(new)
        done.append(cut(new))  # earlier levels stay as they were written
    return reduce(DataFrame.unionByName, done)
