"""Approximate nearest neighbours by inner product: NN-descent builds a graph, queries walk it greedily.

Copies of a vector are one node that knows its smallest identifiers. Vectors get one more component
that makes their norms equal, so the nearest by inner product are nearest by angle. Nodes carry 32-bit
floats, and what that component takes off a product is kept apart, so that one long vector costs the
others no digits. A first, rough graph comes from small blocks of vectors on the same side of random planes;
then, round by round, the neighbours and some reverse neighbours of a node, others in each round, are joined
and compared with each other, and each keeps its best, until few lists change. A query starts at its own node
and the longest ones and expands the best nodes it has not expanded yet, until its beam holds none; a node's
edges are its list and half as many of the nodes that list it. What a beam holds is then measured exactly on
the original vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hinted, staged

K, TABLES, LEAF, OFFERS, SETTLED = 32, 6, 400, 12, 0.02
BEAM, STEP, ENTRIES = 160, 32, 32
#: Up to this many nodes that ask are broadcast with their codes.
ASKING = 50_000
LISTS = pa.schema([("u", pa.int64()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.float32()))])
LISTS_DDL = "u long, ids array<long>, scores array<float>"
GRAPH = LISTS.append(pa.field("new", pa.list_(pa.bool_())))
GRAPH_DDL = f"{LISTS_DDL}, new array<boolean>"


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, x of the rows that take part: all components finite, not all zero."""
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).filter(F.col("vec_id").isNotNull() & finite & F.exists("x", lambda c: c != 0))


def _whole(batches: Iterable[pa.RecordBatch], rows: int = 20000) -> Iterator[pa.RecordBatch]:
    """Sorted rows in batches that end where the first column changes."""
    held: list[pa.RecordBatch] = []
    count, most = 0, rows
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count < most:
            continue
        joined = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        last = int(_starts(joined)[-1])
        held, count = [joined.slice(last)], joined.num_rows - last
        most = max(rows, 2 * count)  # a long run is not put together again for each batch
        if last:
            yield joined.slice(0, last)
    if count:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _starts(batch: pa.RecordBatch) -> np.ndarray:
    """Where the runs of equal values of the first column begin."""
    values = batch.column(0).to_numpy()
    return np.r_[0, np.nonzero(values[1:] != values[:-1])[0] + 1]


def _matrix(codes: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of codes: the vector, minus the component that evens the norms, and its shortfall."""
    if isinstance(codes, pa.ChunkedArray):
        codes = codes.combine_chunks()
    wide = np.int64 if pa.types.is_large_binary(codes.type) else np.int32
    ends = np.frombuffer(codes.buffers()[1], wide)[codes.offset : codes.offset + len(codes) + 1]
    return np.frombuffer(codes.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(np.float32).reshape(len(codes), -1)


def _rows(schema: pa.Schema, sizes: list[np.ndarray], columns: list[list]) -> pa.RecordBatch:
    """Columns of pieces of arrays; those of lists are flat, ``sizes`` tells how many belong to each row."""
    ends = pa.array(np.r_[0, np.cumsum(np.concatenate(sizes))], pa.int32())
    arrays = []
    for field, pieces in zip(schema, columns, strict=True):
        if pa.types.is_list(field.type):
            arrays.append(pa.ListArray.from_arrays(ends, pa.array(np.concatenate(pieces), field.type.value_type)))
        else:
            arrays.append(pa.array(np.concatenate(pieces) if isinstance(pieces[0], np.ndarray) else pieces, field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _compare(most: int):
    """Groups of (group, id, code) or (group, id, code, new, worst): each member's best other members.

    With the latter, pairs of two members that are not new were compared before, and what is no better than the
    worst of a member's list is of no use to it.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole(batches):
            every, codes = batch.column(1).to_numpy(), _matrix(batch.column(2))
            flagged = batch.num_columns > 3
            news = batch.column(3).to_numpy(zero_copy_only=False) if flagged else None
            worsts = batch.column(4).to_numpy() if flagged else None
            starts = _starts(batch)
            us, near, scores, sizes = [], [], [], []
            for a, b in zip(starts, np.r_[starts[1:], len(every)], strict=True):
                if b - a < 2 or (flagged and not news[a:b].any()):
                    continue
                ids, x = every[a:b], codes[a:b]
                other = np.delete(x, -2, axis=1).T
                n = min(most, b - a - 1)
                for low in range(0, b - a, 512):  # few rows of a large group at a time
                    s = x[low : low + 512, :-1] @ other
                    s[np.arange(len(s)), np.arange(low, low + len(s))] = -np.inf
                    if flagged:
                        old = ~news[a:b]
                        s[np.ix_(old[low : low + 512], old)] = -np.inf
                        s[s <= worsts[a + low : a + low + len(s), None]] = -np.inf
                    best = np.argpartition(s, b - a - n, axis=1)[:, b - a - n :]
                    found = np.take_along_axis(s, best, axis=1)
                    of_use = found > -np.inf
                    size = of_use.sum(axis=1)
                    some = size > 0
                    us.append(ids[low : low + 512][some])
                    near.append(ids[best][of_use])
                    scores.append(found[of_use])
                    sizes.append(size[some])
            if us:
                yield _rows(LISTS, sizes, [us, near, scores])

    return run


def _merge(k: int):
    """Groups of (u, ids, scores, own), own lists first: the best k of all lists, and which were not in the own list."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole(batches):
            starts = _starts(batch)
            group = np.zeros(batch.num_rows, np.int32)
            group[starts[1:]] = 1
            lists = batch.column(1)
            lengths = lists.value_lengths().to_numpy()
            g = np.repeat(np.cumsum(group), lengths)
            ids, scores = lists.flatten().to_numpy(), batch.column(2).flatten().to_numpy()
            own = np.repeat(batch.column(3).to_numpy(zero_copy_only=False), lengths)
            order = np.lexsort((ids, g))  # stable: of a repeated pair that of the own list comes first
            again = (ids[order[1:]] == ids[order[:-1]]) & (g[order[1:]] == g[order[:-1]])
            order = order[np.r_[True, ~again]]
            order = order[np.lexsort((-scores[order], g[order]))]
            count = np.bincount(g[order], minlength=len(starts))
            rank = np.arange(len(order)) - np.repeat(np.cumsum(count) - count, count)
            order = order[rank < k]
            yield _rows(GRAPH, [np.minimum(count, k)], [[batch.column(0).to_numpy()[starts]], [ids[order]], [scores[order]], [~own[order]]])

    return run


def _encode(norm: float):
    """Codes of the vectors, divided by the largest norm.

    With e the component that makes a norm 1, the product of two nodes is x.y + e(x) e(y). It is used less
    e(x), the same for all that x is compared with: x.y - e(x) d(y), where d = 1 - e = |y|^2 / (1 + e).
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(batch.column(1).to_pylist(), np.float64) / norm
            squares = (x * x).sum(axis=1)
            e = np.sqrt(np.maximum(0, 1 - squares))
            x = np.c_[x, -e, squares / (1 + e)].astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "code"])

    return run


def _leaves(tables: int, planes: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))[:, :-2]  # the component that evens the norms would drown the others
            for t in range(tables):
                normals = np.random.default_rng(100 + t).standard_normal((x.shape[1], planes)).astype(np.float32)
                side = (x @ normals > 0) @ (1 << np.arange(planes, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(side * tables + t, pa.int64()), batch.column(0), batch.column(1)], names=["leaf", "id", "code"])

    return run


def _sorted_groups(df: DataFrame, key: str, *order: Column) -> DataFrame:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, key).sortWithinPartitions(key, *order)


def graph(nodes: DataFrame, k: int = K, tables: int = TABLES, leaf: int = LEAF, offers: int = OFFERS, settled: float = SETTLED) -> DataFrame:
    """nodes: id, code. Returns u, ids, scores: a list of up to k near nodes for each node, best first.

    A round goes over by whom a node is listed as well, ``k`` of them at a time, those that list it since the
    last round first, others drawn anew. Pairs are compared if one of the two edges that make them is new. The
    rounds end when less than the share ``settled`` of all places in lists changed hands; as lists only
    get better, that comes.
    """
    n = nodes.count()
    planes = max(0, math.ceil(math.log2(max(1, n / leaf))))
    placed = staged(nodes.mapInArrow(_leaves(tables, planes), "leaf long, id long, code binary"), "ann-leaves")
    blocks = placed.groupBy("leaf").agg(F.ceil(F.count("*") / (2 * leaf)).cast("int").alias("blocks"))
    split = placed.join(hinted(blocks), "leaf").select((F.col("leaf") * 1_000_003 + F.pmod(F.xxhash64("id", "leaf"), F.col("blocks"))).alias("g"), "id", "code")
    lists = _sorted_groups(split, "g").mapInArrow(_compare(k), LISTS_DDL).withColumn("own", F.lit(False))
    merge = lambda both: staged(_sorted_groups(both, "u", F.desc("own")).mapInArrow(_merge(k), GRAPH_DDL), "ann-graph")
    found = merge(lists)
    none = F.lit(float("-inf")).cast("float")
    turn = 0
    while True:
        turn += 1
        ahead = found.select("u", F.inline(F.arrays_zip(F.col("ids").alias("v"), "new")).alias("v", "new"))
        near = Window.partitionBy("v").orderBy(F.desc("new"), F.xxhash64("u", "v", F.lit(turn)), "u")
        back = ahead.withColumn("r", F.row_number().over(near)).filter(F.col("r") <= k)
        # dealt by id, so that neither the removal of repeated pairs nor the join deals them out again
        around = ahead.select(F.col("u").alias("c"), F.col("v").alias("id"), "new").union(back.select("v", "u", "new")).repartition("id").groupBy("c", "id").agg(F.max("new").alias("new"))
        worst = found.select(F.col("u").alias("id"), F.when(F.size("scores") == k, F.element_at("scores", -1)).otherwise(none).alias("worst"))
        noted = nodes.join(worst, "id", "left").select("id", "code", F.coalesce("worst", none).alias("worst"))
        offered = _sorted_groups(around.join(noted, "id").select("c", "id", "code", "new", "worst"), "c").mapInArrow(_compare(offers), LISTS_DDL)
        found = merge(found.select("u", "ids", "scores", F.lit(True).alias("own")).union(offered.withColumn("own", F.lit(False))))
        fresh = found.agg(F.sum(F.size(F.filter("new", lambda x: x)))).first()[0] or 0
        if fresh <= settled * k * n:
            break
    return found.select("u", "ids", "scores")


def _score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (q, id, code of the query, code of the node): their product."""
    for batch in batches:
        if batch.num_rows:
            s = np.einsum("ij,ij->i", _matrix(batch.column(2))[:, :-2], _matrix(batch.column(3))[:, :-2])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float32())], names=["q", "id", "score"])


def walk(starts: DataFrame, nodes: DataFrame, edges: DataFrame, entries: DataFrame, beam: int = BEAM, step: int = STEP) -> DataFrame:
    """starts: q, a node that asks, and its code; entries: nodes (id) that all queries meet first. Returns q, id: the nodes left in each query's beam, its own node among them.

    A beam is rows, one for each node that it holds. What a query meets for the first time is scored where the
    node's code is, so only (q, id, score) travel to the beam.
    """
    edges = staged(edges.select("u", F.col("ids").alias("to")), "ann-edges")
    both = edges.select("u", F.explode("to").alias("v"))
    near = Window.partitionBy("v").orderBy(F.xxhash64("u", "v"), "u")
    back = both.withColumn("r", F.row_number().over(near)).filter(F.col("r") <= K // 2).select(F.col("v").alias("u"), F.col("u").alias("v"))
    hops = staged(both.union(back).distinct(), "ann-hops")
    codes = hinted(starts.select("q", F.col("code").alias("own")), ASKING)
    best = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    ahead = Window.partitionBy("q").orderBy(F.desc("open"), F.desc("score"), "id")
    state = staged(starts.select("q", F.col("q").alias("id"), F.lit(float("inf")).cast("float").alias("score"), F.lit(True).alias("open"), F.lit(True).alias("asked")), "ann-beams")
    first = starts.select("q").crossJoin(F.broadcast(entries))
    while True:
        front = state.filter("asked").select("q", F.col("id").alias("u"))
        if front.isEmpty():
            return state.select("q", "id")
        met = front.join(hops, "u").select("q", F.col("v").alias("id"))
        met = met.union(first.select("q", "id")) if first is not None else met
        met = met.withColumn("held", F.lit(False)).union(state.select("q", "id", F.lit(True)))
        # dealt by id, so that neither the removal of repeated pairs nor the join deals them out again
        met = met.repartition("id").groupBy("q", "id").agg(F.max("held").alias("held")).filter("not held")
        scored = met.join(nodes, "id").join(codes, "q").select("q", "id", "own", "code").mapInArrow(_score, "q long, id long, score float")
        held = state.select("q", "id", "score", (F.col("open") & ~F.col("asked")).alias("open")).union(scored.withColumn("open", F.lit(True)))
        held = held.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= beam).drop("r")
        state = staged(held.withColumn("asked", F.col("open") & (F.row_number().over(ahead) <= step)), "ann-beams")
        first = None


def nearest(vectors: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", top: int = 20, tables: int = TABLES, leaf: int = LEAF) -> DataFrame:
    """For the rows that the condition ``queries`` on vec_id selects: query_id, rank, vec_id, score.

    The score is the inner product of the original vectors in double precision; ties go to the smaller
    identifier. A row is no candidate of its own query, its copies are. An identifier with several
    vectors makes several rows: each is a query of its own, with ranks of its own, and none is a candidate of
    another of that identifier. Rows without identifier and vectors that are null, zero or hold null or
    non-finite components take no part; repeated rows count once. Inner products are of vectors of one
    length: each length found is a table of its own. Fewer candidates than ``top`` are all returned; an empty
    table gives no rows; other columns are not read.
    """
    rows = staged(usable(vectors, id_col, vector_col).dropDuplicates(["vec_id", "x"]), "ann-rows")
    lengths = [r["d"] for r in rows.select(F.size("x").alias("d")).distinct().orderBy("d").collect()]
    found = [_nearest(rows.filter(F.size("x") == d), queries, top, tables, leaf) for d in lengths] or [_ranked(rows, queries)]
    for more in found[1:]:
        found[0] = found[0].union(more)
    return found[0]


def _ranked(rows: DataFrame, queries: Column) -> DataFrame:
    """No rows, in the result's columns."""
    return rows.filter(queries & F.lit(False)).select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))


def _nearest(rows: DataFrame, queries: Column, top: int, tables: int, leaf: int) -> DataFrame:
    first = Window.partitionBy("x").orderBy("vec_id")
    members = rows.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= top + 1)
    members = staged(members.withColumn("id", F.first("vec_id").over(first)), "ann-members")
    # a node's number: the first identifier of its copies may have other vectors too
    firsts = staged(members.filter("r = 1").withColumn("node", F.monotonically_increasing_id()).select(F.col("node").alias("id"), "x"), "ann-firsts")
    members = staged(members.select("x", "vec_id").join(firsts, "x").select("id", "vec_id"), "ann-copies")
    squares = F.aggregate("x", F.lit(0.0), lambda s, c: s + c * c)
    norm = firsts.agg(F.max(F.sqrt(squares))).first()[0] or 1.0
    nodes = staged(firsts.mapInArrow(_encode(float(norm)), "id long, code binary"), "ann-nodes")
    longest = firsts.orderBy(F.desc(squares), "id").limit(ENTRIES).select("id")
    # queries with the same vector walk the same way
    asked = staged(rows.filter(queries).join(firsts, "x").select(F.col("vec_id").alias("query_id"), F.col("id").alias("q")), "ann-queries")
    starts = staged(asked.select(F.col("q").alias("id")).distinct().join(nodes, "id").select(F.col("id").alias("q"), "code"), "ann-starts")
    found = walk(starts, nodes, graph(nodes, tables=tables, leaf=leaf), longest)
    exact = F.aggregate(F.zip_with("x", "y", lambda a, b: a * b), F.lit(0.0), lambda s, c: s + c)
    pairs = found.join(firsts.withColumnRenamed("x", "y"), "id").join(firsts.withColumnRenamed("id", "q"), "q").select("q", "id", exact.alias("score"))
    # a query leaves out the rows of its own identifier, at most so many
    own = rows.groupBy("vec_id").count().agg(F.max("count")).first()[0] or 0
    nearest_first = [F.desc("score"), F.col("vec_id")]
    spread = pairs.join(members, "id").withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(*nearest_first))).filter(F.col("r") <= top + own)
    spread = spread.join(asked, "q").filter("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("q", "query_id").orderBy(*nearest_first))
    return spread.withColumn("rank", rank).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
