"""Hard-negative mining by a multiway tree of hyperplanes with distance ranges, in the manner of GNAT.

A node has split points; a row belongs to the nearest of them, which cuts space by hyperplanes between the points.
For every split point and every subtree beside it the node keeps the least and greatest distance from the
point to a row there. A search measures its distance to the split points of a node and drops every subtree for
which, by the triangle inequality, the range of some point leaves nothing at the distances that are looked for. Scores are
inner products, so vectors get one more component that brings all to the same length: a window of scores is then
exactly an annulus of distances around the anchor. What is left is compared in full in the leaves.

The upper two levels have split points from a bounded sample; every row is routed through them, and rows of a cell
are cut into blocks of bounded size. Each block has the lower levels of the tree. Anchors first ask the cell that
they lie in; the scores found there narrow the annuli with which they ask the others.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hinted, staged

SCALE = 256
#: Larger components, scaled, count as this; sums of products then fit a long.
LARGEST = 1 << 26
#: Rows of a block, of a leaf; branches of a lower node; most branches of an upper one; rows sampled for its split points.
BLOCK, LEAF, BRANCHES, UPPER, SAMPLE = 4096, 256, 8, 64, 8192
POSITIVES, NEGATIVES = 5, 3
ANY = 1 << 62
INDEX = "block long, cell int, kind int, at int, id long, label long, vec binary"
QUERY = "qid long, label long, vec binary, lo array<long>, hi array<long>"
FOUND = "qid long, w int, id long, score long"


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, by floating point where that is exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a.astype(np.int64) @ b.T.astype(np.int64)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Packed vectors as rows; shorter ones end in zeros."""
    out = np.zeros((len(column), dim), np.int32)
    for k, value in enumerate(column):
        own = np.frombuffer(value.as_buffer(), np.int32)
        out[k, : len(own)] = own
    return out


class Space:
    """Distances between vectors that one more component brings to the length of the longest (its square is ``most``)."""

    def __init__(self, most: int):
        self.most = float(most)

    def lift(self, v: np.ndarray) -> np.ndarray:
        v = v.astype(np.float64)
        return np.concatenate([v, np.sqrt(np.maximum(0, self.most - (v * v).sum(axis=1, keepdims=True)))], axis=1)

    def anchor(self, v: np.ndarray) -> np.ndarray:
        """Those who ask get 0 for it, so that it does not enter the product."""
        return np.concatenate([v.astype(np.float64), np.zeros((len(v), 1))], axis=1)

    @staticmethod
    def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T))

    def annuli(self, q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest distance of rows with scores from lo to hi (asked for by a window each); empty windows have none."""
        square = (q.astype(np.float64) ** 2).sum(axis=1)[:, None] + self.most
        near = np.sqrt(np.maximum(0, square - 2 * np.minimum(hi, ANY).astype(np.float64)))
        far = np.sqrt(np.maximum(0, square - 2 * np.maximum(lo, -ANY).astype(np.float64)))
        return np.where(lo <= hi, near, np.inf), np.where(lo <= hi, far, -np.inf)


def spread(points: np.ndarray, k: int) -> np.ndarray:
    """Numbers of up to k different points, each the farthest from those before it."""
    chosen, gap = [], np.full(len(points), np.inf)
    for _ in range(min(k, len(points))):
        at = int(gap.argmax()) if chosen else 0
        if not gap[at] > 0:
            break
        chosen.append(at)
        gap = np.minimum(gap, Space.distances(points, points[at : at + 1])[:, 0])
    return np.array(chosen, np.int64)


def ranges(d: np.ndarray, child: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """By split point and subtree the least and greatest distance; inf and -inf for an empty subtree."""
    low, high = np.full((d.shape[1], k), np.inf), np.full((d.shape[1], k), -np.inf)
    for j in np.unique(child):
        low[:, j], high[:, j] = d[child == j].min(axis=0), d[child == j].max(axis=0)
    return low, high


def may_hold(d: np.ndarray, low: np.ndarray, high: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Queries by subtrees: whether a row in some window may lie there, by every split point's range.

    A row at distance x from a split point that is d away is between |d - x| and d + x away.
    """
    slack = 1e-9 * (1 + d.max(initial=0) + np.where(np.isfinite(high), high, 0).max(initial=0))
    least = np.maximum(d[:, :, None] - high, low - d[:, :, None]).max(axis=1) - slack
    most = (d[:, :, None] + high).min(axis=1) + slack
    return ((least[:, None, :] <= far[:, :, None]) & (most[:, None, :] >= near[:, :, None])).any(axis=1)


def grow(v: np.ndarray, lifted: np.ndarray) -> tuple[list, np.ndarray]:
    """The nodes of a block, root first, and each row's leaf. Node: split points, low, high, children (a node's number, or -1 - leaf)."""
    nodes, leaf, leaves = [], np.zeros(len(v), np.int64), 0
    todo = [(np.arange(len(v)), None)]
    while todo:
        rows, above = todo.pop()
        splits = spread(lifted[rows], BRANCHES) if len(rows) > LEAF else np.empty(0, np.int64)
        if len(splits) < 2:  # a leaf; rows that are all alike are one however many
            leaf[rows], name = leaves, -1 - leaves
            leaves += 1
        else:
            d = Space.distances(lifted[rows], lifted[rows[splits]])
            child = d.argmin(axis=1)
            name = len(nodes)
            nodes.append((lifted[rows[splits]], *ranges(d, child, len(splits)), [None] * len(splits)))
            todo += [(rows[child == j], (name, j)) for j in range(len(splits))]
        if above:
            nodes[above[0]][3][above[1]] = name
    return nodes, leaf


class Top:
    """The upper two levels: split points of the root, then of each of its branches."""

    def __init__(self, sample: np.ndarray, branches: int, space: Space):
        lifted = space.lift(sample)
        self.root = lifted[spread(lifted, branches)]
        at = Space.distances(lifted, self.root).argmin(axis=1) if len(lifted) else np.empty(0, np.int64)
        self.below = [lifted[at == j][spread(lifted[at == j], branches)] for j in range(len(self.root))]
        self.first = np.cumsum([0, *(len(b) for b in self.below)])
        self.cells = int(self.first[-1])

    def cell(self, lifted: np.ndarray) -> tuple[np.ndarray, list]:
        """Of each row its cell, and its distances to the split points on the way."""
        d = Space.distances(lifted, self.root)
        branch = d.argmin(axis=1)
        cell, below = np.zeros(len(lifted), np.int64), [None] * len(lifted)
        for j in np.unique(branch):
            rows = np.nonzero(branch == j)[0]
            e = Space.distances(lifted[rows], self.below[j])
            cell[rows] = self.first[j] + e.argmin(axis=1)
            for r, own in zip(rows, e, strict=True):
                below[r] = own
        return cell, [np.concatenate(x) for x in zip(d, below, strict=True)]

    def ranged(self, found: dict[int, tuple[np.ndarray, np.ndarray]]) -> Top:
        """Takes the ranges of the cells, by the split points on the way to each."""
        n = len(self.root)
        self.low, self.high = np.full((n, n), np.inf), np.full((n, n), -np.inf)
        self.inner = []
        for j, points in enumerate(self.below):
            low, high = np.full((len(points), len(points)), np.inf), np.full((len(points), len(points)), -np.inf)
            for c in range(len(points)):
                if own := found.get(int(self.first[j]) + c):
                    self.low[:, j], self.high[:, j] = np.minimum(self.low[:, j], own[0][:n]), np.maximum(self.high[:, j], own[1][:n])
                    low[:, c], high[:, c] = own[0][n:], own[1][n:]
            self.inner.append((low, high))
        return self

    def left(self, q: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
        """Queries by cells: which cells are not eliminated."""
        out = np.zeros((len(q), self.cells), bool)
        branch = may_hold(Space.distances(q, self.root), self.low, self.high, near, far)
        for j, points in enumerate(self.below):
            rows = np.nonzero(branch[:, j])[0]
            if len(rows):
                out[rows, self.first[j] : self.first[j + 1]] = may_hold(Space.distances(q[rows], points), *self.inner[j], near[rows], far[rows])
        return out


def _deal(top: Top, space: Space, dim: int):
    """(id, label, vec) -> the same with its cell."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, _ = top.cell(space.lift(matrix(batch.column(2), dim)))
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), *batch.columns], names=["cell", "id", "label", "vec"])

    return run


def _build(top: Top, space: Space, dim: int, size: int):
    """Rows in order of cells -> blocks: first a row with the block's nodes and ranges (kind 0), then its rows by leaf (kind 1)."""

    def block(cell: int, rows: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
        both = pa.Table.from_batches(rows).combine_chunks()
        vec = both.column("vec").combine_chunks() if both.num_rows else both.column("vec")
        v = matrix(vec, dim)
        lifted = space.lift(v)
        nodes, leaf = grow(v, lifted)
        far = np.stack(top.cell(lifted)[1])
        head = pickle.dumps((nodes, far.min(axis=0), far.max(axis=0)))
        order = np.lexsort((both.column("id").to_numpy(), leaf))
        rows_of = both.take(pa.array(order))
        n = len(order)
        return pa.RecordBatch.from_arrays([pa.array([number] * (n + 1), pa.int64()), pa.array([cell] * (n + 1), pa.int32()), pa.array([0, *[1] * n], pa.int32()), pa.array([0, *leaf[order]], pa.int32()), pa.array([None, *rows_of.column("id").to_pylist()], pa.int64()), pa.array([None, *rows_of.column("label").to_pylist()], pa.int64()), pa.array([head, *rows_of.column("vec").to_pylist()], pa.binary())], names=["block", "cell", "kind", "at", "id", "label", "vec"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, cell, held, count = TaskContext.get().partitionId() << 32, None, [], 0
        for batch in batches:
            cells = batch.column(0).to_numpy()
            at = 0
            while at < len(cells):
                if cell is not None and (cells[at] != cell or count == size):
                    yield block(cell, held, number)
                    number, held, count = number + 1, [], 0
                cell = int(cells[at])
                stop = min(int(np.searchsorted(cells, cell, "right")), at + size - count)
                held.append(batch.slice(at, stop - at))
                count, at = count + stop - at, stop
        if count:
            yield block(cell, held, number)

    return run


def _ask(top: Top, space: Space, dim: int, home: bool):
    """Queries -> (cell, query): the cell that a query lies in, or all others that are not eliminated."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                v = matrix(part.column(2), dim)
                own = top.cell(space.lift(v))[0]
                if home:
                    row, cell = np.arange(len(v)), own
                else:
                    lo, hi = (np.array(part.column(k).to_pylist(), np.int64).reshape(len(v), -1) for k in (3, 4))
                    left = top.left(space.anchor(v), *space.annuli(v, lo, hi))
                    left[np.arange(len(v)), own] = False
                    row, cell = np.nonzero(left)
                out = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), *out.columns], names=["cell", *part.schema.names])

    return run


class Windows:
    """The k best rows of each window of some queries; windows close from below as they fill."""

    def __init__(self, v: np.ndarray, label: np.ndarray, qid: np.ndarray, lo: np.ndarray, hi: np.ndarray, same: bool, k: int):
        self.v, self.label, self.qid, self.lo, self.hi, self.same, self.k = v, label, qid, lo.copy(), hi, same, k
        self.score = np.full((*lo.shape, k), -ANY, np.int64)
        self.id = np.full((*lo.shape, k), ANY, np.int64)

    def compare(self, rows: np.ndarray, v: np.ndarray, label: np.ndarray, ids: np.ndarray) -> None:
        s = products(self.v[rows], v)
        fit = ((self.label[rows][:, None] == label) == self.same) & (self.qid[rows][:, None] != ids)
        inside = fit[:, None, :] & (s[:, None, :] >= self.lo[rows][:, :, None]) & (s[:, None, :] <= self.hi[rows][:, :, None])
        some = inside.any(axis=(1, 2))
        rows, inside, s = rows[some], inside[some], s[some]
        if not len(rows):
            return
        s = np.where(inside, s[:, None, :], -ANY)
        if s.shape[2] > self.k:  # ids ascend within a leaf, so a stable order breaks ties
            best = np.argsort(-s, axis=2, kind="stable")[:, :, : self.k]
            s, ids = np.take_along_axis(s, best, 2), ids[best]
        else:
            ids = np.broadcast_to(ids, s.shape)
        score, found = np.concatenate([self.score[rows], s], axis=2), np.concatenate([self.id[rows], np.where(s > -ANY, ids, ANY)], axis=2)
        best = np.lexsort((found, -score), axis=-1)[:, :, : self.k]
        self.score[rows], self.id[rows] = np.take_along_axis(score, best, 2), np.take_along_axis(found, best, 2)
        self.lo[rows] = np.maximum(self.lo[rows], self.score[rows][:, :, -1])


class Block:
    def __init__(self, head: bytes):
        self.nodes = pickle.loads(head)[0]
        self.at, self.id, self.label, self.v = [], [], [], []

    def add(self, batch: pa.RecordBatch, dim: int) -> None:
        self.at.append(batch.column("at").to_numpy())
        self.id.append(batch.column("id").to_numpy())
        self.label.append(batch.column("label").to_numpy())
        self.v.append(matrix(batch.column("vec"), dim))

    def ready(self) -> None:
        if isinstance(self.at, list):
            self.at, self.id, self.label, self.v = (np.concatenate(x) for x in (self.at, self.id, self.label, self.v))

    def search(self, asked: Windows, space: Space) -> None:
        q = space.anchor(asked.v)
        todo = [(0 if self.nodes else -1, np.arange(len(q)))]
        while todo:
            name, rows = todo.pop()
            if name < 0:
                a, b = np.searchsorted(self.at, [-1 - name, -name])
                asked.compare(rows, self.v[a:b], self.label[a:b], self.id[a:b])
                continue
            points, low, high, children = self.nodes[name]
            near, far = space.annuli(asked.v[rows], asked.lo[rows], asked.hi[rows])
            left = may_hold(Space.distances(q[rows], points), low, high, near, far)
            todo += [(child, rows[left[:, j]]) for j, child in enumerate(children) if left[:, j].any()]


def _search(space: Space, dim: int, same: bool, k: int, chunk: int = 512):
    """In order of (block, kind): a block's nodes, its rows, then the queries that ask it -> what each query's windows find there."""

    def answers(block: Block, asked: pa.RecordBatch) -> pa.RecordBatch:
        block.ready()
        lo, hi = (np.array(asked.column(c).to_pylist(), np.int64).reshape(asked.num_rows, -1) for c in ("lo", "hi"))
        windows = Windows(matrix(asked.column("vec"), dim), asked.column("label").to_numpy(), asked.column("id").to_numpy(), lo, hi, same, k)
        block.search(windows, space)
        q, w, n = np.nonzero(windows.score > -ANY)
        return pa.RecordBatch.from_arrays([pa.array(windows.qid[q], pa.int64()), pa.array(w, pa.int32()), pa.array(windows.id[q, w, n], pa.int64()), pa.array(windows.score[q, w, n], pa.int64())], names=["qid", "w", "id", "score"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block = None, None
        for batch in batches:
            key = np.stack([batch.column("block").to_numpy(), batch.column("share").to_numpy(), batch.column("kind").to_numpy()])
            cuts = np.nonzero((key[:, 1:] != key[:, :-1]).any(axis=0))[0] + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                part, kind, own = batch.slice(a, b - a), key[2, a], (key[0, a], key[1, a])
                if kind == 0:
                    number, block = own, Block(part.column("vec")[0].as_py())
                elif kind == 1:
                    block.add(part, dim)
                elif number == own:
                    for at in range(0, part.num_rows, chunk):
                        yield answers(block, part.slice(at, chunk))

    return run


class Tree:
    """The tree over (id, label, vec), staged: its upper levels here, the blocks in a table."""

    def __init__(self, vectors: DataFrame, block: int = BLOCK):
        self.spark, self.vectors = vectors.sparkSession, vectors
        rows, most, dim = vectors.agg(F.count("*"), F.max("square"), F.max(F.octet_length("vec") / 4)).first()
        self.rows, self.dim, self.space = rows, max(1, int(dim or 1)), Space(most or 0)
        sample = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vec").toArrow().column("vec").combine_chunks()
        points = matrix(sample, self.dim) if rows else np.zeros((0, self.dim), np.int32)
        branches = min(UPPER, max(2, round((rows / block) ** 0.5)))
        top, space, dim = Top(points, branches, self.space), self.space, self.dim
        parts = max(2, int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // (64 * block)))
        dealt = vectors.select("id", "label", "vec").mapInArrow(_deal(top, space, dim), "cell int, id long, label long, vec binary")
        dealt = dealt.repartitionByRange(parts, "cell", F.xxhash64("id")).sortWithinPartitions("cell", F.xxhash64("id"))
        self.index = staged(dealt.mapInArrow(_build(top, space, dim, block), INDEX), "tree-blocks")
        heads = self.index.filter("kind = 0")
        spans = heads.select("cell", "vec").mapInArrow(_spans, "cell int, place int, low double, high double")
        found: dict[int, dict] = {}
        for r in spans.groupBy("cell", "place").agg(F.min("low").alias("low"), F.max("high").alias("high")).toLocalIterator():  # cells x 2 UPPER rows at most
            found.setdefault(r["cell"], {})[r["place"]] = (r["low"], r["high"])
        self.top = top.ranged({c: tuple(np.array([own[p][k] for p in range(len(own))]) for k in (0, 1)) for c, own in found.items()})
        self.blocks = heads.select("block", "cell")

    def search(self, queries: DataFrame, same: bool, k: int) -> DataFrame:
        """FOUND and place, from 1: the k best rows, of the same label or of others, in each window of each query."""
        queries = queries.select("qid", "label", "vec", "lo", "hi")
        near = staged(self._asked(queries, True, same, k), "tree-home")
        full = near.groupBy("qid", "w").agg(F.count("*").alias("n"), F.min("score").alias("least")).filter(F.col("n") == k)
        full = full.groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("w", "least"))).alias("least"))
        narrowed = F.transform("lo", lambda x, i: F.coalesce(F.greatest(x, F.col("least")[i]), x))
        rest = queries.join(full, "qid", "left").select("qid", "label", "vec", narrowed.alias("lo"), "hi")
        found = near.unionByName(self._asked(rest, False, same, k))
        place = F.row_number().over(Window.partitionBy("qid", "w").orderBy(F.desc("score"), "id"))
        return found.withColumn("place", place).filter(F.col("place") <= k)

    def _asked(self, queries: DataFrame, home: bool, same: bool, k: int, share: int = 65_536) -> DataFrame:
        """Blocks and the queries that ask them meet by block; many queries are cut in shares, each with the block."""
        shares = max(1, -(-self.rows // (50 * share)))
        asks = queries.mapInArrow(_ask(self.top, self.space, self.dim, home), f"cell int, {QUERY}").join(hinted(self.blocks), "cell")
        asks = asks.select("block", F.pmod(F.xxhash64("qid"), F.lit(shares)).cast("int").alias("share"), F.lit(2).alias("kind"), F.lit(0).alias("at"), F.col("qid").alias("id"), "label", "vec", "lo", "hi")
        none = F.lit(None).cast("array<long>")
        rows = self.index.select("block", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), "kind", "at", "id", "label", "vec", none.alias("lo"), none.alias("hi"))
        met = rows.unionByName(asks).repartition("block", "share").sortWithinPartitions("block", "share", "kind", "at", "id")
        return met.mapInArrow(_search(self.space, self.dim, same, k), FOUND)


def _spans(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for cell, head in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            _, low, high = pickle.loads(head.as_py())
            yield pa.RecordBatch.from_arrays([pa.array([cell] * len(low), pa.int32()), pa.array(range(len(low)), pa.int32()), pa.array(low), pa.array(high)], names=["cell", "place", "low", "high"])


def _packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(2)
        x = np.clip(np.floor(SCALE * lists.flatten().to_numpy(zero_copy_only=False)), -LARGEST, LARGEST).astype(np.int32)
        size = np.diff(lists.offsets.to_numpy())
        stops = np.cumsum(size)
        vec = [x[b - n : b].tobytes() for n, b in zip(size, stops, strict=True)]
        square = [int((x[b - n : b].astype(np.int64) ** 2).sum()) for n, b in zip(size, stops, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(vec, pa.binary()), pa.array(square, pa.int64())], names=["id", "label", "vec", "square"])


def vectors(embeddings: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label: Column | None = None) -> DataFrame:
    """id, label, vec (whole numbers, floor(256 x), packed), square (of its length); rows that take no part are gone."""
    rows = embeddings.select(F.col(id_col).cast("long").alias("id"), (F.col("label") if label is None else label).cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v").mapInArrow(_packed, "id long, label long, vec binary, square long")


def hard_negatives(embeddings: DataFrame, anchors: Column, label: Column | None = None, id_col: str = "vec_id", vec_col: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = 50, most: int = 95, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank from 1, negative_id, positive_score, negative_score.

    An anchor's positives are its best rows of the same label; the negatives of a positive are the best rows of other
    labels that score between ``least`` and ``most`` hundredths of it. ``anchors`` is a condition on ``id``.
    Rows with a null identifier, label, vector or component, or one that is not finite, take no part. Rows of the same
    identifier are one row, that with the smallest label, then vector. Of vectors of different length the
    shorter end in zeros; components of 2**18 and more count as 2**18. An empty table gives none; other columns are
    not read.
    """
    rows = staged(vectors(embeddings, id_col, vec_col, label), "tree-vectors")
    tree = Tree(rows, block)
    asked = rows.filter(anchors).select(F.col("id").alias("qid"), "label", "vec")
    whole = F.array(F.lit(-ANY)), F.array(F.lit(ANY))
    good = staged(tree.search(asked.select("*", whole[0].alias("lo"), whole[1].alias("hi")), True, positives), "tree-positives")
    floor_div = lambda x, n: F.call_function("div", x - F.pmod(x, F.lit(n)), F.lit(n))
    own = F.struct("place", floor_div(F.col("score") * least + 99, 100).alias("lo"), floor_div(F.col("score") * most, 100).alias("hi"))
    windows = good.groupBy("qid").agg(F.array_sort(F.collect_list(own)).alias("ws"))
    # as many windows for each query: those that are missing are empty
    pad = lambda name, default: F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.coalesce(F.get("ws", i)[name], F.lit(default)))
    asked = asked.join(windows, "qid").select("qid", "label", "vec", pad("lo", 1).alias("lo"), pad("hi", 0).alias("hi"))
    bad = tree.search(asked, False, negatives).select("qid", (F.col("w") + 1).alias("nth"), F.col("place").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    good = good.select("qid", F.col("place").alias("nth"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return bad.join(good, ["qid", "nth"]).select(F.col("qid").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, CAST(list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS DOUBLE[]) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.*, id AS negative_id, score AS negative_score, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""
