"""A linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Fitting sees a bounded sample of labelled rows: tasks count in how many texts of either label each hashed
n-gram occurs, and the counts are added block by block. The value of an n-gram is its log-count ratio, shrunk by what
chance explains of it (see ``shrunk_ratio``): with few texts as with many the values go to nothing without a
threshold between. A logistic regression on those values is fitted by gradients that tasks sum over the sample's rows;
the driver sees sums only. Scoring looks
every n-gram of a whole text up in one table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hinted, staged
from .worker import turn

BITS, BLOCK, ORDERS, SLICE = 20, 1 << 12, (3, 4, 5, 6), 1 << 20
#: Terms of a gradient are rounded to this part of one, so that their sum does not depend on the order of tasks.
GRAIN = 1 << 24
#: Standard errors of a log-count ratio that are put down to chance.
CHANCE = 2.0
_STEP, _MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


def hashed(data: bytes, orders: tuple[int, ...] = ORDERS) -> Iterator[np.ndarray]:
    """Hashes of the n-grams of a text's bytes, slice by slice, order by order."""
    most = max(orders)
    for at in range(0, max(1, len(data)), SLICE):
        b = np.frombuffer(data[at : at + SLICE + most - 1], np.uint8).astype(np.uint64)
        h, n_at = b, SLICE
        for n in range(2, most + 1):
            if len(b) < n:
                break
            h = h[: len(b) - n + 1] * _STEP + b[n - 1 :]
            if n in orders:
                x = (h[:n_at] ^ (h[:n_at] >> np.uint64(29))) * _MIX
                yield (x >> np.uint64(64 - BITS)).astype(np.int64)


def prepared(text: str | None) -> bytes:
    return f" {(text or '').lower()} ".encode("utf-8", "surrogatepass")


@dataclass
class Model:
    """Weights of the kept n-grams; score = logistic(bias + their sum over a text's different n-grams)."""

    features: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.empty(0))
    bias: float = 0.0
    orders: tuple[int, ...] = ORDERS

    def scorer(self):
        table, weights = np.full(1 << BITS, len(self.features), np.int32), np.append(self.weights, 0.0)
        table[self.features] = np.arange(len(self.features), dtype=np.int32)
        mark = np.zeros(len(weights), bool)

        def score(text: str | None) -> float:
            for h in hashed(prepared(text), self.orders):
                mark[table[h]] = True
            some = np.flatnonzero(mark)  # each n-gram once, in one order
            mark[some] = False
            return float(1 / (1 + np.exp(-np.clip(self.bias + weights[some].sum(), -60, 60))))

        return score


def _counts(orders: tuple[int, ...]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("chargrams")
        seen, some = np.zeros((2, 1 << BITS), np.int32), False
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1), strict=True):
                some = True
                seen[label.as_py()][np.unique(np.concatenate([np.empty(0, np.int64), *hashed(prepared(text.as_py()), orders)]))] += 1
        for block in range((1 << BITS) // BLOCK if some else 0):
            part = seen[:, block * BLOCK : (block + 1) * BLOCK]
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["block", "seen"])

    return run


def shrunk_ratio(no: np.ndarray, yes: np.ndarray, of: tuple[int, int], chance: float = CHANCE) -> np.ndarray:
    """Log-count ratios of n-grams that so many texts of either label hold, times 1 - (chance / z)**2, at least 0, where z is the
    ratio in standard errors. An n-gram of one text alone says nothing."""
    ratio = np.log((yes + 1) / (of[1] + 2)) - np.log((no + 1) / (of[0] + 2))
    error = 1 / (yes + 1) + 1 / (no + 1)
    left = 1 - chance * chance * error / np.maximum(ratio * ratio, 1e-300)
    return np.where((left > 0) & (yes + no > 1), ratio * left, 0.0)


def _kept(of: tuple[int, int]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("chargrams")
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, seen in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(seen, np.int32).reshape(2, BLOCK)
                sums[block] = sums[block] + part if block in sums else part
        for block, (no, yes) in sums.items():
            ratio = shrunk_ratio(no, yes, of)
            keep = np.nonzero(ratio)[0]
            yield pa.RecordBatch.from_arrays([pa.array([(keep + block * BLOCK).tobytes()], pa.binary()), pa.array([ratio[keep].tobytes()], pa.binary())], names=["features", "ratios"])

    return run


def _rows(features: np.ndarray, orders: tuple[int, ...]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("chargrams")
        table = np.full(1 << BITS, -1, np.int32)
        table[features] = np.arange(len(features), dtype=np.int32)
        for batch in batches:
            hits = [np.unique(np.concatenate([np.empty(0, np.int32)] + [k[k >= 0] for k in (table[h] for h in hashed(prepared(text.as_py()), orders))])) for text in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([h.tobytes() for h in hits], pa.binary())], names=["label", "hits"])

    return run


def gradient(rows: list[np.ndarray], labels: np.ndarray, value: np.ndarray, weight: tuple[float, float], point: np.ndarray) -> np.ndarray:
    """Of the weighted log loss at a point, the weights and the bias behind them: the loss and its gradient, in whole GRAINs."""
    out = np.zeros(len(point) + 1)
    w = value * point[:-1]
    for low in range(0, len(rows), 256):  # few rows at a time
        part, y = rows[low : low + 256], labels[low : low + 256].astype(float)
        at, own = np.concatenate(part), np.repeat(np.arange(len(part)), [len(r) for r in part])
        m = np.bincount(own, w[at], minlength=len(part)) + point[-1]
        share = np.where(y == 1, weight[1], weight[0])
        e = (1 / (1 + np.exp(-np.clip(m, -60, 60))) - y) * share
        out[0] += np.rint((np.logaddexp(0, m) - y * m) * share * GRAIN).sum()
        out[1:-1] += np.bincount(at, np.rint(value[at] * e[own] * GRAIN), minlength=len(value))
        out[-1] += np.rint(e * GRAIN).sum()
    return out


def minimised(at: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, most: int = 120, settled: float = 1e-3) -> np.ndarray:
    """L-BFGS from x on, until the gradient is the share ``settled`` of what it was at first, or for ``most`` gradients."""
    v, g = at(x)
    enough, seen, past = settled * np.linalg.norm(g), 1, []
    while np.linalg.norm(g) > enough and seen < most:
        q, shares = g.copy(), []
        for s, y in reversed(past):
            shares.append((s @ q) / (s @ y))
            q -= shares[-1] * y
        q *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, np.linalg.norm(g))
        for (s, y), share in zip(past, reversed(shares), strict=True):
            q += s * (share - (y @ q) / (s @ y))
        slope, step = g @ q, 1.0
        while True:
            new = x - step * q
            v_new, g_new = at(new)
            seen += 1
            if v_new <= v - 1e-4 * step * slope:
                break
            if seen >= most or step < 1e-8:
                return x
            step *= min(0.5, max(0.1, slope * step / (2 * (v_new - v + slope * step))))
        if (new - x) @ (g_new - g) > 0:
            past = [*past[-9:], (new - x, g_new - g)]
        x, v, g = new, v_new, g_new
    return x


def fitted(sums: Callable[[tuple[float, float], np.ndarray], np.ndarray], no: int, yes: int, value: np.ndarray, penalty: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights (times value) and bias from sums of gradients; the rarer label weighs the root of its odds."""
    weight = (float(np.sqrt(max(1.0, yes / no))), float(np.sqrt(max(1.0, no / yes))))

    def at(x: np.ndarray) -> tuple[float, np.ndarray]:
        out, w = sums(weight, x) / GRAIN, np.append(x[:-1], 0.0)
        return out[0] + penalty * (w @ w) / 2, out[1:] + penalty * w

    x = minimised(at, np.append(np.zeros(len(value)), np.log(yes / no)))
    return x[:-1] * value, float(x[-1])


def regression(rows: list[np.ndarray], labels: np.ndarray, value: np.ndarray, penalty: float = 1.0) -> tuple[np.ndarray, float]:
    """The fit to rows at hand."""
    yes = int(labels.sum())
    return fitted(lambda weight, x: gradient(rows, labels, value, weight, x), len(labels) - yes, yes, value, penalty)


def _gradients(value: np.ndarray, weight: tuple[float, float], point: np.ndarray):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("chargrams")
        out = np.zeros(len(point) + 1)
        for batch in batches:
            out += gradient([np.frombuffer(h, np.int32) for h in batch.column(1).to_pylist()], batch.column(0).to_numpy(), value, weight, point)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["sums"])

    return run


def sample(labels: DataFrame, id_col: str, label_col: str, use: Column, most: int) -> DataFrame:
    """Up to ``most`` labelled identifiers of either label, the first by hash; one with both labels is not used."""
    good = labels.filter(use & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id"))
    good = good.agg(F.min(label_col).cast("int").alias("_label"), F.max(label_col).alias("_other")).filter(F.col("_label") == F.col("_other")).drop("_other")
    pick = lambda v: good.filter(F.col("_label") == v).orderBy(F.xxhash64("_id"), "_id").limit(most)
    return pick(0).union(pick(1))


def fit(docs: DataFrame, labels: DataFrame, label_col: str, use: Column, id_col: str = "doc_id", text_col: str = "text", most: int = 6000, orders: tuple[int, ...] = ORDERS) -> Model:
    """Fits on at most ``most`` rows of each label among those that ``use`` allows (a documented bound).

    Of rows with one identifier the least text is used, so the bound holds however often one occurs.
    All n-grams of two texts or more whose ratio is not chance alone are kept. Without rows of both labels the score is the label's share alone.
    """
    parts = 12
    picked = hinted(sample(labels, id_col, label_col, use, most))
    rows = staged(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(picked, "_id").groupBy("_id", "_label").agg(F.min("_text").alias("_text")).select("_text", "_label").repartition(parts, F.xxhash64("_id")), "grams-sample")
    of = {r["_label"]: r["count"] for r in rows.groupBy("_label").count().collect()}
    no, yes = of.get(0, 0), of.get(1, 0)
    if not no or not yes:
        return Model(bias=float(np.log((yes + 0.5) / (no + 0.5))), orders=orders)
    blocks = rows.mapInArrow(_counts(orders), "block int, seen binary").repartition(parts, "block")
    kept = blocks.mapInArrow(_kept((no, yes)), "features binary, ratios binary").collect()
    chosen, ratio = np.frombuffer(b"".join(r["features"] for r in kept), np.int64), np.frombuffer(b"".join(r["ratios"] for r in kept), np.float64)
    order = np.argsort(chosen)
    chosen, ratio = chosen[order], ratio[order]
    hits = staged(rows.mapInArrow(_rows(chosen, orders), "label int, hits binary"), "grams-hits")

    def sums(weight: tuple[float, float], x: np.ndarray) -> np.ndarray:
        return sum(np.frombuffer(r["sums"], np.float64) for r in hits.mapInArrow(_gradients(ratio, weight, x), "sums binary").collect())

    weights, bias = fitted(sums, no, yes, ratio)
    return Model(chosen, weights, bias, orders)


def scored(docs: DataFrame, model: Model, columns: list[str], text_col: str = "text", name: str = "score") -> DataFrame:
    """The columns of docs named, and the score of each row's whole text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("chargrams")
        score = model.scorer()
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            out = pa.array([score(t.as_py()) for t in texts], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], out], names=[*columns, name])

    rows = docs.select(*columns, F.col(text_col).alias("_scored_text"))
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns)
    return rows.mapInArrow(run, f"{kinds}, `{name}` double")
