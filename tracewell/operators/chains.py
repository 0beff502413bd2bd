"""Source-to-target chains over lineage records.

Edges go from a source column to a target column. A chain starts at a column of a base table (one that is
never a target) and follows edges to a final output. Of what is asked, as little as possible is followed path by path:

- steps: an edge stands in a chain for every source above it and every output below it, at every distance; both
  sides are carried along the edges once, and a step is an edge with one of each (``chain_steps``);
- counts: which outputs a column reaches is carried in bitmaps (``fanout``), the numbers of steps come from the two sides (``summary``);
- paths: grown from the heads as arrays; long ones are cut into segments, each with its parent, that are put together at the end by doubling (``chain_paths``, ``trace``).

Only where edges form cycles do simple paths have to remember where they have been, and only those nodes.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cut import checkpointed, written
from .graph import components, reach

STEP = ["source_table", "source_column", "target_table", "target_column", "ultimate_source_table", "ultimate_source_column", "ultimate_target_table", "ultimate_target_column", "level_top_to_bottom", "level_bottom_to_top"]
#: So many hops are followed before the graph is asked for cycles; chains are rarely longer.
UNCHECKED = 12
#: A path's nodes are kept in segments of so many; up to this many rows are broadcast.
SEGMENT, FEW = 16, 50_000
Cut = Callable[[DataFrame], DataFrame]


def cleaned(records: DataFrame) -> DataFrame:
    """The four names of a record, trimmed, null as empty."""
    names = ("source_table", "source_column", "target_table", "target_column")
    return records.select(*[F.coalesce(F.trim(F.col(c)), F.lit("")).alias(c) for c in names])


def node(table: str | Column, column: str | Column) -> Column:
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    return F.struct(as_col(table).alias("table"), as_col(column).alias("column"))


def created_tables(records: DataFrame) -> DataFrame:
    return cleaned(records).filter("target_table <> ''").select(F.col("target_table").alias("table_name")).distinct()


def base_tables(records: DataFrame) -> DataFrame:
    """Tables that are read and never created."""
    used = cleaned(records).filter("target_column <> '' and source_table <> ''").select(F.col("source_table").alias("table_name")).distinct()
    return used.join(created_tables(records), "table_name", "left_anti")


def edges(records: DataFrame) -> DataFrame:
    """source, target, from_base: each different pair of columns once; pairs with an empty source are none."""
    return _edges(cleaned(records).distinct())


def _edges(records: DataFrame) -> DataFrame:
    """The edges of records that are cleaned and different."""
    rows = records.filter("target_column <> '' and (source_table <> '' or source_column <> '')")
    base = base_tables(records).select(F.col("table_name").alias("source_table"), F.lit(True).alias("from_base"))
    rows = rows.join(base, "source_table", "left")
    return rows.select(node("source_table", "source_column").alias("source"), node("target_table", "target_column").alias("target"), F.coalesce("from_base", F.lit(False)).alias("from_base"))


def final_outputs(records: DataFrame) -> DataFrame:
    """Outputs of plain SELECTs, and created columns that no record with a target reads."""
    rows = cleaned(records).filter("target_column <> ''")
    targets = rows.select("target_table", "target_column").distinct()
    made = created_tables(records).withColumnRenamed("table_name", "source_table")
    used = rows.join(made, "source_table", "left_semi").select(F.col("source_table").alias("target_table"), F.col("source_column").alias("target_column")).distinct()
    unread = targets.filter("target_table <> ''").join(used, ["target_table", "target_column"], "left_anti")
    return targets.filter("target_table = ''").unionByName(unread)


class Graph:
    """The edges of records, read once: links (source, target, from_base), without edges from a column to itself.

    ``heads`` are where chains start: columns of base tables, and columns of no table that nothing leads to. ``finals`` are
    the outputs that something leads to. ``within`` limits both, to the nodes of its first and its second DataFrame.
    """

    def __init__(self, records: DataFrame, cut: Cut | None = None, within: tuple[DataFrame, DataFrame] | None = None):
        self.cut, self.within = cut or checkpointed, within
        self.rows = self.cut(cleaned(records).filter("target_column <> '' or target_table <> ''").distinct())
        self.all = self.cut(_edges(self.rows))
        self.links = self.all.filter("source <> target")

    @property
    def heads(self) -> DataFrame:
        lonely = self.all.filter("not from_base and source.table = ''").select(F.col("source").alias("node"))
        lonely = lonely.join(self.all.select(F.col("target").alias("node")), "node", "left_anti")
        found = self.all.filter("from_base").select(F.col("source").alias("node")).union(lonely).distinct()
        return found.join(self.within[0], "node", "left_semi") if self.within else found

    @property
    def outputs(self) -> DataFrame:
        return final_outputs(self.rows).select(node("target_table", "target_column").alias("node"))

    @property
    def finals(self) -> DataFrame:
        ends = self.outputs.join(self.links.select(F.col("target").alias("node")), "node", "left_semi")
        return ends.join(self.within[1], "node", "left_semi") if self.within else ends

    def cyclic(self) -> DataFrame:
        """The nodes of cycles of two edges or more."""
        return self.cut(components(self.links, self.cut).select("node"))

    def sides(self) -> tuple[DataFrame, DataFrame | None]:
        """(down, node, end, hops): the heads above each node (down) and the finals below it, with every distance, over paths
        that touch no cycle; and the nodes of cycles, None if there are none.

        All rows of a round have the same distance, so a round's rows are new by themselves.
        """
        both = lambda links: links.select(F.lit(True).alias("down"), F.col("source").alias("node"), F.col("target").alias("to")).unionByName(links.select(F.lit(False).alias("down"), F.col("target").alias("node"), F.col("source").alias("to")))
        start = self.heads.withColumn("down", F.lit(True)).unionByName(self.finals.withColumn("down", F.lit(False)))
        cycles, ways = None, both(self.links)
        front = self.cut(start.select("down", "node", F.col("node").alias("end"), F.lit(0).alias("hops")))
        done = [front]
        while True:
            front = self.cut(front.join(ways, ["down", "node"]).select("down", F.col("to").alias("node"), "end", (F.col("hops") + 1).alias("hops")).distinct())
            if front.isEmpty():
                return reduce(DataFrame.unionByName, done), cycles
            done.append(front)
            if len(done) == UNCHECKED and cycles is None:
                cycles = self.cyclic()
                if cycles.isEmpty():
                    continue
                off = lambda df, *cs: reduce(lambda d, c: d.join(cycles.withColumnRenamed("node", c), c, "left_anti"), cs, df)  # noqa: E731, B023
                ways = both(off(self.links, "source", "target"))
                front = self.cut(off(done[0], "node"))
                done = [front]


def _named(rows: DataFrame) -> DataFrame:
    """(source, target, head, final, top, bottom) as steps."""
    values = [F.col(f"{n}.{part}") for n in ("source", "target", "head", "final") for part in ("table", "column")]
    return rows.select(*[v.alias(name) for v, name in zip([*values, F.col("top"), F.col("bottom")], STEP, strict=True)])


def chain_steps(records: DataFrame, cut: Cut | None = None, within: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """A row for each hop of each chain, with the chain's ends and the level from either; equal rows once.

    A column without sources starts a chain if its table is empty or a base table; other dead ends give none, nor
    do paths that only run in a circle. Chains are simple paths: none comes to a column twice. ``within`` asks only for
    chains from some nodes to some nodes (two DataFrames, node).
    """
    graph = Graph(records, cut, within)
    sides, cycles = graph.sides()
    above = sides.filter("down").select(F.col("node").alias("source"), F.col("end").alias("head"), (F.col("hops") + 1).alias("top"))
    below = sides.filter("not down").select(F.col("node").alias("target"), F.col("end").alias("final"), (F.col("hops") + 1).alias("bottom"))
    straight = _named(graph.links.select("source", "target").join(above, "source").join(below, "target"))
    if cycles is None or cycles.isEmpty():
        return straight
    return straight.unionByName(explode_steps(_paths(graph, graph.finals, cycles, through=True, prune=True))).distinct()


def _alive(graph: Graph, ends: DataFrame, cycles: DataFrame | None, through: bool) -> DataFrame:
    """Links that lie between a head and an end (between a cycle's node and an end, or above one, if paths go ``through`` cycles)."""
    up, down = graph.links.select("source", "target"), graph.links.select(F.col("target").alias("source"), F.col("source").alias("target"))
    above, below = closed(up, ends, graph.cut), closed(down, graph.heads, graph.cut)
    links = graph.links.join(above.withColumnRenamed("node", "target"), "target", "left_semi").join(below.withColumnRenamed("node", "source"), "source", "left_semi")
    if through:
        near = closed(down, cycles, graph.cut).unionByName(closed(up, cycles, graph.cut)).distinct()
        links = links.join(near.withColumnRenamed("node", "target"), "target", "left_semi").join(near.withColumnRenamed("node", "source"), "source", "left_semi")
    return graph.cut(links)


def closed(links: DataFrame, ends: DataFrame, cut: Cut) -> DataFrame:
    """node: the ends and all that lead to them."""
    known = front = cut(ends.select("node").distinct())
    parts = [known]
    while True:
        came = links.join(front.withColumnRenamed("node", "target"), "target", "left_semi").select(F.col("source").alias("node")).distinct()
        front = cut(came.join(known, "node", "left_anti"))
        if front.isEmpty():
            return known
        parts.append(front)
        known = reduce(DataFrame.unionByName, parts)


def _lean(df: DataFrame) -> DataFrame:
    """A cut table with a hint for joins: broadcast if it has few rows, else merged."""
    return F.broadcast(df) if df.count() <= FEW else df.hint("merge")


def _paths(graph: Graph, ends: DataFrame, cycles: DataFrame | None = None, through: bool = False, most: int | None = None, prune: bool = False) -> DataFrame:
    """path: arrays of nodes from a head to an end, each simple path once; only those by way of a cycle's node with ``through``.

    Paths grow downstream as arrays of up to ``SEGMENT`` nodes. A full one is kept with its parent, and what grows on from it
    begins anew at its last node, so long paths share what they have in common; ``seen`` holds the nodes
    of cycles that a path has been to, all that it must not come to again. Where ``cycles`` is not given, it is found out when
    paths do not end, and growth starts again if there are any. ``prune`` first drops what leads from no head or to no end.
    """
    cut, links = graph.cut, _alive(graph, ends, cycles, through) if prune else graph.links
    on = links.select("source", F.col("target").alias("to"))
    none = F.array().cast("array<struct<table:string,column:string>>")
    last = F.element_at("path", -1)
    on_cycle = None if cycles is None else _lean(cut(cycles.select(F.col("node").alias("to"), F.lit(True).alias("cyclic"))))
    marked = lambda df: df.withColumn("cyclic", F.lit(None).cast("boolean")) if on_cycle is None else df.join(on_cycle, "to", "left")
    ends = _lean(cut(ends.select("node").distinct()))
    leading = cut(on.select(F.col("source.table").alias("table")).distinct())
    few = leading.count() <= FEW  # else tables are no help to tell what goes on
    front = cut(graph.heads.select(F.lit(None).cast("long").alias("parent"), F.array("node").alias("path"), none.alias("seen")))
    segments, ended, level = [], [], 0
    while not front.isEmpty():
        level += 1
        if most is not None and level > most:
            break
        if level == UNCHECKED and cycles is None:
            found = graph.cyclic()
            if not found.isEmpty():
                return _paths(graph, ends, found, through, most, True)
        if level % SEGMENT == 0:
            full = cut(front.withColumn("id", F.monotonically_increasing_id()))
            segments.append(full.select("id", "parent", F.slice("path", F.lit(1), F.size("path") - 1).alias("path")))
            front = full.select(F.col("id").alias("parent"), F.array(last).alias("path"), "seen")
        near = on
        if few:  # the edges of the tables that paths have come to
            at = front.select(last["table"].alias("at")).distinct()
            near = on.join(F.broadcast(at), F.col("source.table") == F.col("at"), "left_semi")
        grown = _lean(front).join(near, last == F.col("source")).select("parent", "path", "seen", "to")
        grown = marked(grown).filter(F.col("cyclic").isNull() | ~F.array_contains("seen", F.col("to")))
        grown = cut(grown.select("parent", F.concat("path", F.array("to")).alias("path"), F.when(F.col("cyclic"), F.concat("seen", F.array("to"))).otherwise(F.col("seen")).alias("seen")))
        over = grown.join(ends, last == F.col("node"), "left_semi")
        ended.append((over.filter(F.size("seen") > 0) if through else over).select(F.lit(len(segments)).alias("n"), "parent", "path"))
        front = grown.join(F.broadcast(leading), last["table"] == F.col("table"), "left_semi") if few else grown
    if not ended:
        return graph.links.select(F.array("source").alias("path")).limit(0)
    leaves = reduce(DataFrame.unionByName, ended)
    if not segments:
        return leaves.select("path")
    place = lambda n, id_: F.struct(F.col(n).alias("n") if isinstance(n, str) else n.alias("n"), F.col(id_).alias("id"))
    rows = reduce(DataFrame.unionByName, [df.select(place(F.lit(n), "id").alias("row"), F.when(F.col("parent").isNotNull(), place(F.lit(n - 1), "parent")).alias("up"), "path") for n, df in enumerate(segments, 1)])
    span = 1
    while span < len(segments):  # each round doubles the segments that a row holds
        next_ = rows.select(F.col("row").alias("up"), F.col("path").alias("rest"), F.col("up").alias("further"))
        rows = cut(rows.join(next_, "up", "left").select("row", F.col("further").alias("up"), F.when(F.col("rest").isNotNull(), F.concat("rest", "path")).otherwise(F.col("path")).alias("path")))
        span *= 2
    first = rows.select("row", F.col("path").alias("rest"))
    return leaves.withColumn("row", F.when(F.col("parent").isNotNull(), place("n", "parent"))).join(first, "row", "left").select(F.when(F.col("rest").isNotNull(), F.concat("rest", "path")).otherwise(F.col("path")).alias("path"))


def chain_paths(records: DataFrame, cut: Cut | None = None, most: int | None = None) -> DataFrame:
    """path: array of nodes from a base column to a final output, every simple path once.

    Chains start and end as those of ``chain_steps``; ``most`` stops after so many hops (default: no limit).
    """
    graph = Graph(records, cut or written)
    return _paths(graph, graph.outputs, None if most is None or most >= UNCHECKED else graph.cyclic(), most=most)


def trace(records: DataFrame, targets: DataFrame, cut: Cut | None = None) -> DataFrame:
    """path: the chains of given columns (table_name, column_name), whether they are final or not.

    Only what lies between base columns and the targets is followed. A target that nothing leads to is a path by itself if it
    has no table or a base table; a target that only other dead ends lead to has none. Names are trimmed, null is empty.
    """
    graph = Graph(records, cut)
    name = lambda c: F.coalesce(F.trim(F.col(c)), F.lit(""))
    asked = graph.cut(targets.select(node(name("table_name"), name("column_name")).alias("node")).distinct())
    paths = _paths(graph, asked, prune=True)
    alone = asked.join(graph.all.select(F.col("target").alias("node")), "node", "left_anti")
    base = base_tables(graph.rows).select(F.col("table_name"))
    alone = alone.filter("node.table = ''").unionByName(alone.join(base, F.col("node.table") == F.col("table_name"), "left_semi"))
    return paths.unionByName(alone.select(F.array("node").alias("path")))


def explode_steps(paths: DataFrame) -> DataFrame:
    """A row for each hop of each path, with the path's ends and the level from either; equal rows once."""
    n = F.size("path")
    hops = F.arrays_zip(F.slice("path", F.lit(1), n - 1).alias("s"), F.slice("path", F.lit(2), n - 1).alias("t"))
    rows = paths.select("path", n.alias("n"), F.posexplode(hops).alias("i", "hop"))
    return _named(rows.select(F.col("hop.s").alias("source"), F.col("hop.t").alias("target"), F.col("path")[0].alias("head"), F.element_at("path", -1).alias("final"), (F.col("i") + 1).alias("top"), (F.col("n") - 1 - F.col("i")).alias("bottom"))).distinct()


def cycle_nodes(records: DataFrame, cut: Cut | None = None) -> DataFrame:
    """table, column of the nodes from which following edges leads back to them: nodes of strongly connected components of
    two or more, and those with an edge to themselves."""
    graph = Graph(records, cut)
    own = graph.all.filter("source = target").select(F.col("source").alias("node"))
    return graph.cyclic().union(own).distinct().select("node.*")


def fanout(records: DataFrame, cut: Cut | None = None) -> DataFrame:
    """How many different final columns each ultimate source column reaches; no path is enumerated, cycles do not matter."""
    graph = Graph(records, cut)
    reached = reach(graph.links.select("source", "target"), graph.finals, graph.cut).join(graph.heads, "node", "left_semi")
    return reached.groupBy("node").agg(F.sum(F.bit_count("bits")).alias("targets")).select(F.col("node.table").alias("ultimate_source_table"), F.col("node.column").alias("ultimate_source_column"), "targets")


def summary(records: DataFrame, cut: Cut | None = None) -> DataFrame:
    """What ``chain_summary`` says of a graph's steps, from the two sides of each edge: heads above and finals below, by distance.

    Where cycles are, chains by way of them are followed as paths, since only simple ones count.
    """
    graph = Graph(records, cut)
    sides, cycles = graph.sides()
    if cycles is not None and not cycles.isEmpty():
        return chain_summary(chain_steps(records, cut))
    sides = graph.cut(sides.groupBy("down", "node").agg(F.count("*").alias("k"), F.max("hops").alias("far"), F.max((F.col("hops") == 0).cast("int")).alias("own")))
    up, down = sides.filter("down"), sides.filter("not down")
    met = graph.links.select("source", "target").join(up.select(F.col("node").alias("source"), F.col("k").alias("a"), F.col("far").alias("fa"), F.col("own").alias("oa")), "source")
    met = met.join(down.select(F.col("node").alias("target"), F.col("k").alias("b"), F.col("far").alias("fb"), F.col("own").alias("ob")), "target")
    counted = met.agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("steps"), F.countDistinct(F.when(F.col("oa") == 1, F.col("source"))).alias("sources"), F.countDistinct(F.when(F.col("ob") == 1, F.col("target"))).alias("targets"), F.sum(F.col("a") * F.col("b") - F.col("oa") * F.col("ob")).alias("multi_level_steps"), F.max(F.col("fa") + 1).alias("deepest"))
    return counted


def chain_summary(steps: DataFrame) -> DataFrame:
    """One row: steps, different ultimate sources and targets, steps of chains of more than one hop, the deepest level."""
    source, target = F.struct("ultimate_source_table", "ultimate_source_column"), F.struct("ultimate_target_table", "ultimate_target_column")
    deep = (F.col("level_top_to_bottom") > 1) | (F.col("level_bottom_to_top") > 1)
    return steps.agg(F.count("*").alias("steps"), F.countDistinct(source).alias("sources"), F.countDistinct(target).alias("targets"), F.sum(deep.cast("long")).alias("multi_level_steps"), F.max("level_top_to_bottom").alias("deepest"))


def chain_fanout(steps: DataFrame) -> DataFrame:
    """How many different final columns each ultimate source column reaches, of steps as they were written."""
    target = F.struct("ultimate_target_table", "ultimate_target_column")
    return steps.groupBy("ultimate_source_table", "ultimate_source_column").agg(F.countDistinct(target).alias("targets"))


def recursive_sql(view: str) -> str:
    """The steps of a view of records as one recursive query, for graphs within Spark's recursion limits."""
    return f"""
WITH RECURSIVE r AS (SELECT DISTINCT source_table st, source_column sc, target_table tt, target_column tc FROM {view} WHERE target_column <> ''),
created AS (SELECT DISTINCT target_table t FROM {view} WHERE target_table <> ''),
m AS (SELECT st, sc, tt, tc, st <> '' AND st NOT IN (SELECT t FROM created) AS base FROM r WHERE st <> '' OR sc <> ''),
finals AS (SELECT DISTINCT tt, tc FROM r WHERE tt = '' OR NOT EXISTS (SELECT 1 FROM r u WHERE u.st = r.tt AND u.sc = r.tc)),
p AS (
  SELECT m.st AS ht, m.sc AS hc, m.base, array(concat(m.st, '\\t', m.sc), concat(m.tt, '\\t', m.tc)) AS path
  FROM finals f JOIN m ON m.tt = f.tt AND m.tc = f.tc WHERE NOT (m.st = m.tt AND m.sc = m.tc)
  UNION ALL
  SELECT m.st, m.sc, m.base, concat(array(concat(m.st, '\\t', m.sc)), p.path)
  FROM p JOIN m ON m.tt = p.ht AND m.tc = p.hc WHERE NOT p.base AND NOT array_contains(p.path, concat(m.st, '\\t', m.sc)))
SELECT path FROM p WHERE base OR (ht = '' AND NOT EXISTS (SELECT 1 FROM m WHERE m.tt = p.ht AND m.tc = p.hc))
"""
