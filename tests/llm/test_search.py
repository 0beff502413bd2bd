"""Lexical search, hard negatives and repeated passages against brute force."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import ann, lexical, negatives, substrings

TERM = re.compile(lexical.TERM)


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_ranks(docs, items, k):
    held = [(i, collections.Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    total, length = len(held), sum(sum(c.values()) for _, c in held)
    wanted = collections.defaultdict(set)
    for i, t in items:
        wanted[i] |= set(terms(t))
    df = collections.Counter(t for _, c in held for t in c)
    out = []
    for item, own in wanted.items():
        rows = []
        for doc, c in held:
            m = 50 + (50 * sum(c.values()) * total) // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in own if t in c)
            if score > 0:
                rows.append((-score, doc is None, doc or 0, doc))
        out += [(item, r, doc, -s) for r, (s, _, _, doc) in enumerate(sorted(rows, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


ITEMS = [(1, "Alpha beta, GAMMA!"), (1, "delta"), (2, "é É ñandú"), (3, None), (4, "¿...?"), (5, ""), (None, "alpha1 alpha2"), (6, "the-same-row eta3 _eta4_ İstanbul"), (6, "the-same-row")]


@pytest.mark.parametrize(("k", "block"), [(50, lexical.BLOCK_CHARS), (3, 20)])
def test_lexical_ranks(spark, docs, rows, k, block):
    more = [(None, "ñandú É alpha1"), (None, "Alpha BETA alpha"), (910, "é é\x00é alphabeta"), (911, "ALPHA1　eta3\x7feta4 THE same row İSTANBUL"), (911, "ALPHA1　eta3\x7feta4 THE same row İSTANBUL")]
    extra = spark.createDataFrame(more, "doc_id long, text string").withColumns({"rank": F.lit("x"), "score": F.lit(1), "item": F.lit(0), "term": F.lit("t")})
    both = docs.unionByName(extra, allowMissingColumns=True)
    items = spark.createDataFrame(ITEMS, "item_id int, text string").withColumn("doc_id", F.lit(3))
    found = lexical.rank(both, items, k=k, block_chars=block).collect()
    own = [(r["doc_id"], r["text"]) for r in both.select("doc_id", "text").collect()]
    assert sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in found), key=str) == brute_ranks(own, ITEMS, k)
    assert len({(r["item_id"], r["rank"]) for r in found}) == len(found)


def test_lexical_ranks_of_nothing(spark, docs, empty):
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    assert lexical.rank(empty, items).count() == 0
    assert lexical.rank(docs, items.limit(0)).count() == 0
    assert lexical.rank(docs, items.filter("item_id in (3, 4, 5)")).count() == 0
    assert lexical.rank(empty, items).columns == ["item_id", "rank", "doc_id", "score"]


def test_best_keeps_the_first_of_equal_scores():
    best, rng = lexical.Best(2, 3), random.Random(5)
    offered = [(rng.randrange(2), rng.randrange(1, 4), rng.randrange(1000)) for _ in range(6000)]
    for i in range(0, 6000, 50):
        item, score, doc = (np.array(x) for x in zip(*offered[i : i + 50], strict=True))
        best.offer(item, score, doc, np.zeros(50, np.int64))
    best.cut()
    for k in (0, 1):
        expected = sorted((-s, d) for i, s, d in offered if i == k)[:3]
        assert sorted((-int(s), int(d)) for i, s, d in zip(*best.rows[:3], strict=True) if i == k) == expected


def brute_negatives(rows):
    own = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        own[i] = min(own.get(i, (label, v)), (label, v))
    dim = max(len(v) for _, v in own.values())
    ids = sorted(own)
    whole = np.array([[math.floor(256 * x) for x in own[i][1]] + [0] * (dim - len(own[i][1])) for i in ids])
    out = []
    for a in (i for i in ids if i % 50 == 0):
        scored = sorted((-int(s), i) for s, i in zip(whole @ whole[ids.index(a)], ids, strict=True) if i != a)
        good = [(i, -s) for s, i in scored if own[i][0] == own[a][0]][:5]
        for p, ps in good:
            bad = [(i, -s) for s, i in scored if own[i][0] != own[a][0] and 50 * ps <= -100 * s <= 95 * ps][:3]
            out += [(a, p, r, i, ps, s) for r, (i, s) in enumerate(bad, 1)]
    return sorted(out)


def vectors(n=1200, dim=8, seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    out = []
    for i in range(n):
        v = centres[rng.integers(12)] * rng.uniform(0.3, 1.5) + rng.normal(size=dim) * 0.2
        out.append((i, [float(np.float32(x)) for x in v], int(rng.integers(4))))
    out += [(n + i, out[3][1], i % 3) for i in range(90)]  # ties of one vector, more than a leaf of the test's holds
    out += [(50, out[50][1], out[50][2])] * 2 + [(100, [0.5] * dim, 9)]  # repeated identifiers
    out += [(None, [1.0] * dim, 1), (5001, None, 1), (5002, [1.0] * dim, None), (5003, [1.0, None] + [0.0] * (dim - 2), 1), (5004, [float("nan")] * dim, 1), (5005, [float("inf")] * dim, 1)]
    out += [(5050, [0.0] * dim, 2), (5051, [], 2), (5052, [1.0, 2.0], 2), (5100, [-1.5] * dim, 3)]
    return out


@pytest.mark.parametrize(("block", "leaf"), [(4096, 256), (128, 16)])
def test_hard_negatives(spark, monkeypatch, block, leaf):
    rows = vectors()
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"qid": F.lit("q"), "cell": F.lit(None), "score": F.lit(0.5)}).repartition(5)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    monkeypatch.setattr(negatives, "LEAF", leaf)
    found = negatives.hard_negatives(table, F.col("id") % 50 == 0, label, block=block)
    assert sorted(tuple(r) for r in found.collect()) == brute_negatives(rows)
    assert negatives.hard_negatives(table.limit(0), F.col("id") % 50 == 0, label).count() == 0


def test_tree_eliminates_and_stays_exact():
    """Blocks of clustered vectors: most leaves are eliminated, what is found is what brute force finds."""
    rng = np.random.default_rng(1)
    v = (rng.normal(size=(40, 16))[rng.integers(40, size=4000)] * 200 + rng.normal(size=(4000, 16)) * 8).astype(np.int32)
    space = negatives.Space(int((v.astype(np.int64) ** 2).sum(axis=1).max()))
    nodes, leaf = negatives.grow(v, space.lift(v))
    order = np.lexsort((np.arange(4000), leaf))
    block = negatives.Block.__new__(negatives.Block)
    block.nodes, block.at, block.id, block.label, block.v = nodes, leaf[order], order, np.zeros(4000, int), v[order]
    q = v[::40]
    own = negatives.Windows(q, np.zeros(100, int), np.arange(0, 4000, 40), np.full((100, 1), -negatives.ANY), np.full((100, 1), negatives.ANY), True, 5)
    compared, compare = [], own.compare
    own.compare = lambda rows, *a: (compared.append(len(rows) * len(a[0])), compare(rows, *a))
    own.lo[:] = np.sort(q.astype(np.int64) @ v.T.astype(np.int64), axis=1)[:, -6:-5]
    block.search(own, space)
    scores = q.astype(np.int64) @ v.T.astype(np.int64)
    for k in range(100):
        expected = sorted((-int(s), i) for i, s in enumerate(scores[k]) if i != 40 * k)[:5]
        assert [(-int(s), int(i)) for s, i in zip(own.score[k, 0], own.id[k, 0], strict=True)] == expected
    assert sum(compared) < 0.5 * 100 * 4000


def test_products_are_exact_for_large_components():
    a = np.array([[negatives.LARGEST, 1, -3]], np.int32)
    assert negatives.products(a, a)[0, 0] == negatives.LARGEST**2 + 10


def brute_substrings(docs, window):
    seen, own = collections.Counter(), []
    for i, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        spans = [tuple(w[k : k + window]) for k in range(len(w) - window + 1)]
        seen.update(spans)
        own.append((i, w, spans))
    out = []
    for i, w, spans in own:
        gone = {k + j for k, s in enumerate(spans) if seen[s] > 1 for j in range(window)}
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def passages(seed=8):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(40))
    text = lambda n: [word() for _ in range(n)]
    common, other = text(60), text(35)
    docs = []
    for i in range(150):
        w = text(rng.randrange(0, 120))
        for own in (common, other, common[7:50], other[:34]):
            if rng.random() < 0.4:
                at = rng.randrange(len(w) + 1)
                w[at:at] = own
        docs.append((i, rng.choice([" ", "\n", "\t "]).join(w)))
    docs += [(200, "x " * 300), (201, " ".join(["p", "q", "r"] * 30)), (202, docs[5][1]), (202, docs[5][1]), (203, None), (None, " ".join(common)), (204, " \n "), (205, "ñ" * 5000 + " é é " * 40), (206, " ".join(text(3000) + common)), (207, "nul\x00byte " * 40)]
    return docs


@pytest.mark.parametrize(("hot", "slice_words", "held"), [(substrings.HOT, substrings.SLICE_WORDS, substrings.HELD_BYTES), (2, 500, 2000)])
def test_repeated_passages(spark, monkeypatch, hot, slice_words, held):
    docs = passages()
    monkeypatch.setattr(substrings, "SLICE_WORDS", slice_words)
    monkeypatch.setattr(substrings, "HELD_BYTES", held)
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"uid": F.lit(1), "body": F.lit("b"), "n_words": F.lit("n")}).repartition(4)
    found = substrings.without_repeats(table, hot=hot)
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in found.collect()), key=str) == brute_substrings(docs, 35)
    assert all(r["n_removed"] == sum(s["length"] for s in r["removed"]) for r in found.collect())
    assert substrings.without_repeats(table.limit(0)).count() == 0


def test_long_texts_are_cut_into_slices_that_lose_no_window(monkeypatch):
    rng = random.Random(2)
    w = [f"w{rng.randrange(50)}" for _ in range(3000)]
    import zlib

    import pyarrow as pa

    monkeypatch.setattr(substrings, "SLICE_WORDS", 400)
    monkeypatch.setattr(substrings, "SLICE_BYTES", 2000)
    batch = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([zlib.compress(" ".join(w).encode())], pa.binary())], names=["uid", "body"])
    covered = []
    for words, first, uids, before in substrings.slices([batch], 35):
        a, b, _ = substrings.super_kmers(words, first)
        text = np.searchsorted(first, a, "right") - 1
        for x, y, t in zip(a, b, text, strict=True):
            own = words.data[words.starts[x] : words.ends[y + 33]].decode().split(" ")
            at = int(x - first[t] + before[t])
            assert own == w[at : at + len(own)] and uids[t] == 7
            covered += range(at, at + int(y - x))
    assert sorted(covered) == list(range(3000 - 34))


def test_ann_beams_are_narrow_rows_and_copies_walk_once(spark, monkeypatch):
    """200 queries of 10 different vectors: ten walks, and no row of a beam holds lists or codes."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(50, 8)).astype(np.float32).astype(np.float64)
    df = spark.createDataFrame([(i, x[i % 50].tolist()) for i in range(1000)], "vec_id long, embedding array<float>")
    kept = {}
    monkeypatch.setattr(ann, "staged", lambda d, name, put=ann.staged: kept.setdefault(name, []).append(put(d, name)) or kept[name][-1])
    found = ann.nearest(df, F.col("vec_id") % 5 == 0).collect()
    assert kept["ann-beams"] and all(t in ("bigint", "float", "boolean") for d in kept["ann-beams"] for _, t in d.dtypes)
    assert all(d.select("q").distinct().count() == 10 for d in kept["ann-beams"])
    s = x @ x.T
    for q in range(0, 1000, 5):
        got = [r["vec_id"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == q]
        assert got == sorted((i for i in range(1000) if i != q), key=lambda i: (-s[q % 50, i % 50], i))[:20]
