"""Packing documents into training sequences, each seed followed by its nearest texts.

The terms of a document are its token ids. How many documents hold a term, and how long documents are, is counted
over all of them. A sketch of each document, a random projection of its weighted terms, is dealt to the nearest of some
centres, which are fitted on a bounded sample, and within those by the sides of planes on which it lies, so that texts
with the same terms stand near each other, however large a group; in that order they form shards of bounded size. A shard has an inverted index with BM25 weights of those overall
counts. A window's seed is the document that stands at its start; the unused documents nearest to it
follow, best first, until the window is full, and what does not fit opens the next window. Copies of a text do
not share a window while there is another text. A shard's last window is cut at powers of two, so it needs no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .encoding import ids as pieces_of
from .encoding import load
from .worker import turn

WINDOW, END = 2048, 1
SHARD_TOKENS, SHARD_DOCS, BLOCK = 600_000, 4096, 1 << 12
#: Numbers of a sketch; centres, and documents on average that they are fitted on; sides of planes within a centre.
SKETCH, CENTRES, SAMPLE, SIDES = 32, 64, 4096, 16
K1, B = 1.2, 0.75


class Index:
    """BM25 over the documents of a shard, fewer than 2**20; terms are small integers.

    ``seen`` tells for each term how many of all ``total`` documents hold it, ``mean`` is the mean length of all.
    """

    def __init__(self, terms: list[np.ndarray], seen: np.ndarray, total: int, mean: float):
        self.n = len(terms)
        lengths = np.array([len(t) for t in terms], np.int64)
        # term and document in one number: one sort groups the postings
        key = np.concatenate(terms).astype(np.int64) if self.n else np.empty(0, np.int64)
        key = key << 20 | np.repeat(np.arange(self.n), lengths)
        key.sort()
        at = np.nonzero(np.diff(key, prepend=-1))[0]
        tf, key = np.diff(at, append=len(key)), key[at]
        doc, term = key & ((1 << 20) - 1), key >> 20
        norm = K1 * (1 - B + B * lengths[doc] / max(1.0, mean))
        self.doc, self.weight = doc, idf(seen, total)[term] * tf * (K1 + 1) / (tf + norm)
        number = np.cumsum(np.diff(term, prepend=-1) != 0) - 1
        self.stops = np.cumsum(np.bincount(number))
        order = np.argsort(doc.astype(np.min_scalar_type(self.n)), kind="stable")  # few bits are sorted in linear time
        self.terms, self.starts = number[order], np.searchsorted(doc[order], np.arange(self.n + 1))

    def scores(self, seed: int) -> np.ndarray:
        """Of all documents, for the terms of one."""
        t = self.terms[self.starts[seed] : self.starts[seed + 1]]
        begin = np.where(t > 0, self.stops[t - 1], 0)
        size = self.stops[t] - begin
        at = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
        return np.bincount(self.doc[at], self.weight[at], minlength=self.n)

    def narrow(self, docs: np.ndarray) -> None:
        """From now on scores are those of the documents marked in ``docs`` alone; others have none, but may be seeds."""
        some = docs[self.doc]
        self.doc, self.weight = self.doc[some], self.weight[some]
        self.stops = np.concatenate([[0], np.cumsum(some)])[self.stops]


def idf(seen: np.ndarray, total: int) -> np.ndarray:
    return np.log1p((total - seen + 0.5) / (seen + 0.5))


def ranked(score: np.ndarray, few: int = 24) -> Iterator[int]:
    """The documents with a score, best first, ties by number; few are sorted at first, all only if those do not do."""
    found = np.nonzero(score > 0)[0]
    if len(found) > 4 * few:
        least = np.partition(score[found], len(found) - few)[len(found) - few]
        top = found[score[found] >= least]
        yield from top[np.argsort(-score[top], kind="stable")]
        found = found[score[found] < least]
    yield from found[np.argsort(-score[found], kind="stable")]


def order_and_cut(lengths: np.ndarray, index: Index, same: np.ndarray, window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length): every document once, whole, cut where windows end.

    Documents with the same number in ``same`` have the same text.
    """
    unused, sequences, current, room = np.ones(len(lengths), bool), [], [], window
    number = np.unique(same, return_inverse=True)[1]
    inside = np.zeros(len(lengths), bool)  # texts of the window, by number

    def place(doc: int) -> bool:
        """Appends a document; whether a window became full."""
        nonlocal current, room
        unused[doc] = False
        inside[number[doc]] = True
        start, left, full = 0, int(lengths[doc]), False
        while left:
            take = min(room, left)
            current.append((doc, start, take))
            start, left, room = start + take, left - take, room - take
            if not room:
                sequences.append(current)
                current, room, full = [], window, True
                inside[:] = False
                inside[number[doc]] = left > 0
        return full

    first, seed, indexed = 0, None, len(lengths)
    while True:
        free = unused & ~inside[number]
        if seed is None:
            while first < len(lengths) and not unused[first]:
                first += 1
            if first == len(lengths):
                break
            seed = int(free.argmax()) if free.any() else first  # a copy only where no other text is left
            place(seed)
            free = unused & ~inside[number]
            if not current:
                seed = None
        if seed is None or not free.any():
            seed = None
            continue
        left = np.count_nonzero(unused)
        if 4 * left < 3 * indexed:  # postings of what is used cost as much as others
            index.narrow(unused)
            indexed = left
        score = index.scores(seed)
        score[~free] = 0
        seed = None
        for doc in ranked(score):
            if not inside[number[doc]] and place(int(doc)):
                seed = int(doc) if current else None
                break
    if current:  # the rest, at powers of two
        rest = window - room
        for bit in reversed(range(window.bit_length())):
            if rest >> bit & 1:
                part, need = [], 1 << bit
                while need:
                    doc, start, length = current.pop(0)
                    take = min(length, need)
                    part.append((doc, start, take))
                    need -= take
                    if take < length:
                        current.insert(0, (doc, start + take, length - take))
                sequences.append(part)
    return sequences


TOKENS_DDL = "uid long, doc_id long, ids binary"


def different(own: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The different terms of some documents: document and term, in order; one sort for all of them."""
    doc = np.repeat(np.arange(len(own)), [len(x) for x in own])
    ids = np.concatenate(own)
    small = ids.dtype.itemsize == 2 and len(own) <= 1 << 16
    key = doc.astype(np.uint32) << np.uint32(16) | ids if small else doc.astype(np.uint64) << np.uint64(32) | ids.astype(np.uint64)
    key.sort()
    key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    bits = 16 if small else 32
    return (key >> key.dtype.type(bits)).astype(np.int64), (key & key.dtype.type((1 << bits) - 1)).astype(np.int64)


def _ids(path: str, end: int, kind: str, terms: int):
    """Rows (doc_id, text) to their ids, the last of them ``end``; behind them, with negative uid, in how many of the
    task's rows each term occurs, in blocks of terms."""

    def encoded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not path.endswith(".model"):
            return pieces_of(path, "H" if kind == "<u2" else "I").joined(texts, end)
        found = [np.array([*x, end], kind) for x in load(path).encode(texts.to_pylist(), num_threads=1)]
        return np.concatenate(found), np.cumsum([len(x) for x in found])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("encoding")
        uid = TaskContext.get().partitionId() << 33
        seen = np.zeros(-(-terms // BLOCK) * BLOCK, np.int64)
        out = lambda uids, doc_ids, blobs: pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), doc_ids, blobs], names=["uid", "doc_id", "ids"])
        for batch in batches:
            for part in parts(batch):
                ids, stops = encoded(part.column(1))
                stops = np.concatenate([[0], stops])
                for at in range(0, part.num_rows, 128):
                    seen += np.bincount(different([ids[a:b] for a, b in pairwise(stops[at : at + 129].tolist())])[1], minlength=len(seen))
                blobs = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer((stops * ids.itemsize).astype(np.int32)), pa.py_buffer(ids)])
                yield out(np.arange(uid, uid + part.num_rows), part.column(0), blobs)
                uid += part.num_rows
        blocks = [k for k in range(len(seen) // BLOCK) if seen[k * BLOCK : (k + 1) * BLOCK].any()]
        yield out([-k - 1 for k in blocks], pa.nulls(len(blocks), pa.int64()), pa.array([seen[k * BLOCK : (k + 1) * BLOCK].tobytes() for k in blocks], pa.binary()))

    return run


def parts(batch: pa.RecordBatch, size: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most about so many bytes of text, one row at least."""
    stops = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy()).tolist()
    first, begin = 0, 0
    for k, stop in enumerate(stops):
        if stop - begin >= size or k == batch.num_rows - 1:
            yield batch.slice(first, k + 1 - first)
            first, begin = k + 1, stop


def _added(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, seen in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sums[block] = sums.get(block, 0) + np.frombuffer(seen, np.int64)
    for block, seen in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([seen.tobytes()], pa.binary())], names=["block", "seen"])


class Sketches:
    """Directions of documents: of the different terms of each the sum of random vectors by weight, less what is usual."""

    def __init__(self, seen: np.ndarray, total: int):
        self.normals = np.random.default_rng(17).standard_normal((len(seen), SKETCH), np.float32)
        self.normals *= idf(seen, total)[:, None].astype(np.float32)
        self.normals -= (seen @ self.normals / max(1, seen.sum())).astype(np.float32)

    def of(self, ids: list[np.ndarray]) -> np.ndarray:
        """Documents have one id at least. Few are taken at a time."""
        out = np.zeros((len(ids), SKETCH), np.float32)
        for at in range(0, len(ids), 128):
            doc, term = different(ids[at : at + 128])
            stops = np.flatnonzero(np.diff(doc, append=-1)) + 1
            for k, (a, b) in enumerate(zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True)):
                out[at + k] = self.normals[term[a:b]].sum(axis=0)
        return out / np.maximum(1e-9, np.linalg.norm(out, axis=1, keepdims=True))


def _sampled(kind: str, seen: np.ndarray, total: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketches = Sketches(seen, total)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sketches.of([np.frombuffer(x.as_buffer(), kind) for x in batch.column(0)]).astype("<f4").tobytes()], pa.binary())], names=["sketches"])

    return run


def centres(points: np.ndarray, most: int = CENTRES, rounds: int = 12) -> np.ndarray:
    """K-means of sketches, in the order in which the centres lie along their main direction; one centre where points are few."""
    k = min(most, len(points) // 8)
    if k < 2:
        return np.zeros((1, SKETCH), np.float32)
    at = points[np.random.default_rng(5).choice(len(points), k, replace=False)].copy()
    for _ in range(rounds):
        own = nearest(points, at)
        for j in range(k):
            if (own == j).any():
                at[j] = points[own == j].mean(axis=0)
    main = np.linalg.svd(at - at.mean(axis=0), full_matrices=False)[2][0]
    return at[np.argsort(at @ main, kind="stable")].astype(np.float32)


def nearest(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.argmax(points @ at.T - 0.5 * (at * at).sum(axis=1), axis=1)


def _signed(kind: str, seen: np.ndarray, total: int, at: np.ndarray):
    """Adds a row's place among the others, its centre and then its sides, and a hash that copies share."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketches = Sketches(seen, total)
        for batch in batches:
            own = [np.frombuffer(x.as_buffer(), kind) for x in batch.column(2)]
            points = sketches.of(own)
            centre = nearest(points, at) if len(own) else np.empty(0, np.int64)
            sig = centre << SIDES | (points[:, :SIDES] > at[centre, :SIDES]) @ (1 << np.arange(SIDES)[::-1])
            same = [xxhash.xxh3_64_intdigest(x) >> 1 for x in own]
            yield pa.RecordBatch.from_arrays([pa.array(sig, pa.int32()), pa.array(same, pa.int64()), *batch.columns], names=["sig", "same", "uid", "doc_id", "ids"])

    return run


FIELDS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pack(kind: str, window: int, shard_tokens: int, shard_docs: int, seen: np.ndarray, total: int, mean: float, with_ids: bool):
    """Rows (same, doc_id, ids) in the order in which shards are formed."""
    schema = pa.schema(FIELDS + ([("ids", pa.binary())] if with_ids else []))

    def shard(doc_ids: list, same: list, ids: list[np.ndarray], base: int) -> tuple[list[pa.RecordBatch], int]:
        sequences = order_and_cut(np.array([len(x) for x in ids], np.int64), Index(ids, seen, total, mean), np.array(same), window)
        rows = []
        for k, pieces in enumerate(sequences):
            offset = 0
            for doc, start, length in pieces:
                own = ids[doc][start : start + length].astype("<u4").tobytes()
                rows.append((doc_ids[doc], start, length, zlib.crc32(own), len(ids[doc]), base + k, offset, *([own] if with_ids else [])))
                offset += length
        out = [pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + 5000]), schema, strict=True)], schema=schema) for i in range(0, len(rows), 5000)]
        return out, base + len(sequences)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 33
        doc_ids, same, ids, held = [], [], [], 0
        for batch in batches:
            for hash_, doc_id, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                doc_ids.append(doc_id)
                same.append(hash_)
                ids.append(np.frombuffer(own, kind))
                held += len(ids[-1])
                if held >= shard_tokens or len(ids) >= shard_docs:
                    out, base = shard(doc_ids, same, ids, base)
                    yield from out
                    doc_ids, same, ids, held = [], [], [], 0
        if doc_ids:
            yield from shard(doc_ids, same, ids, base)[0]

    return run


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shard_tokens: int = SHARD_TOKENS, shard_docs: int = SHARD_DOCS, end: int = END, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids on demand.

    A document is its ids and the id ``end``; null and empty texts are that id alone. A document may
    lie in several sequences, one piece behind the other. Repeated rows are packed each. An empty
    table gives none; other columns are not read. Documents of equal score follow in the order of their
    shard; so do those that may not follow yet, at the next seed.
    """
    spark = docs.sparkSession
    if path.endswith(".model"):
        terms = load(path).get_piece_size()
    else:
        terms = max(load(path).get_vocab(with_added_tokens=True).values(), default=0) + 1
    terms = max(terms, end + 1)
    kind = "<u2" if terms <= 1 << 16 else "<u4"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    both = staged(rows.mapInArrow(_ids(path, end, kind, terms), TOKENS_DDL), "pack-ids")
    own = both.filter("uid >= 0")
    total, tokens = own.agg(F.count("*"), F.sum(F.octet_length("ids"))).first()
    mean = (tokens or 0) / np.dtype(kind).itemsize / max(1, total)
    blocks = both.filter("uid < 0").select((-F.col("uid") - 1).cast("int").alias("block"), "ids").repartition(-(-terms // BLOCK), "block")
    seen = np.zeros(-(-terms // BLOCK) * BLOCK, np.int64)
    for r in blocks.mapInArrow(_added, "block int, seen binary").collect():
        seen[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["seen"], np.int64)
    some = own.filter(F.pmod(F.xxhash64("uid"), F.lit(max(1, total))) < SAMPLE).select("ids")
    points = np.frombuffer(b"".join(r["sketches"] for r in some.mapInArrow(_sampled(kind, seen, total), "sketches binary").collect()), "<f4").reshape(-1, SKETCH)
    signed = staged(own.mapInArrow(_signed(kind, seen, total, centres(points)), f"sig int, same long, {TOKENS_DDL}"), "pack-signed")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = signed.repartitionByRange(parts, "sig", "same", "uid").sortWithinPartitions("sig", "same", "uid").select("same", "doc_id", "ids")
    return dealt.mapInArrow(_pack(kind, window, shard_tokens, shard_docs, seen, total, mean, with_ids), DDL + (", ids binary" if with_ids else ""))
