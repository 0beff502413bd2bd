"""Removing passages that occur more than once, by super-k-mers in buckets of their minimisers.

A window is ``window`` consecutive words. Its minimiser is the leftmost of its shortest-hash runs of ``MER`` words;
consecutive windows with the same one, at the same place, form a super-k-mer, which travels as one packed string to the
bucket of that minimiser. Equal windows have equal minimisers at equal places, so they meet; within one super-k-mer all
windows differ. In a bucket the windows are sorted and counted by their bytes; hashes only decide where they go.

Minimisers are counted first. Those that occur once need no company: a bitmap of fixed size keeps out nearly
all of them on the way (where it fills up, more travel, with the same result). Under a minimiser that very many
share, as inside a passage that many documents hold, single windows travel, dealt by their own hash, so no bucket grows with
the copies of a passage. Equal strings of a task travel once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .shingles import mixed

WINDOW, MER = 35, 4
#: Words of a text, and bytes of several, that are looked at together; bytes of strings kept to find equal ones.
SLICE_WORDS, SLICE_BYTES, HELD_BYTES = 200_000, 1 << 21, 1 << 25
#: Super-k-mers of a minimiser from which on single windows travel; most such minimisers (more double the number).
HOT, MOST_HOT = 4096, 1 << 20
#: The bitmap has 2**BITS bits in blocks of 2**BLOCK.
BITS, BLOCK = 27, 19
TEXTS = "uid long, doc_id long, n_words long, body binary"
PIECES = "key long, piece binary, uid long, at int, n int"
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEPS = tuple(np.uint64(pow(0xD6E8FEB86659FD93, j, 1 << 64)) for j in range(MER))
_powers: list[np.ndarray] = []


def powers(n: int) -> list[np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, b, np.uint64)])) for b in (_BASE, _INVERSE)]
    return _powers


class Words:
    """Words between single blanks: where each begins and ends, and its hash."""

    def __init__(self, data: np.ndarray):
        blanks = np.flatnonzero(data == 0x20)
        self.data = data.tobytes()
        self.starts, self.ends = np.concatenate([[0], blanks + 1]), np.concatenate([blanks, [len(data)]])
        up, down = (p[: len(data) + 1] for p in powers(len(data)))
        sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1])])
        self.hash = mixed((sums[self.ends] - sums[self.starts]) * down[self.starts])


def super_kmers(words: Words, first: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First windows, ends and minimisers of super-k-mers; ``first`` holds the first word of each text."""
    n = len(words.hash)
    if n < window:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    h = words.hash[: n - MER + 1] * _STEPS[0]
    for j in range(1, MER):
        h += words.hash[j : n - MER + 1 + j] * _STEPS[j]
    h = mixed(h)
    at, width, wanted = np.arange(len(h)), 1, window - MER + 1
    while width < wanted:  # the leftmost least of ever wider stretches
        step = min(width, wanted - width)
        left, right = at[:-step], at[step:]
        at = np.where(h[left] <= h[right], left, right)
        width += step
    text = np.zeros(n, np.int64)
    text[first[1:]] = 1
    text = np.cumsum(text)
    own = text[: len(at)]
    cut = np.flatnonzero((at[1:] != at[:-1]) | (own[1:] != own[:-1])) + 1
    # windows that reach into the next text stand apart
    whole = own == text[window - 1 :]
    cut = np.union1d(cut, np.flatnonzero(whole[1:] != whole[:-1]) + 1)
    a, b = np.concatenate([[0], cut]), np.concatenate([cut, [len(at)]])
    a, b = a[whole[a]], b[whole[a]]
    return a, b, h[at[a]]


def slices(batches: Iterable[pa.RecordBatch], window: int) -> Iterator[tuple[Words, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts (uid, body), several at once: their words; of each text its first word here, its uid, and how many words went before."""

    def together(parts: list) -> tuple:
        words = Words(np.frombuffer(b" ".join(p[0] for p in parts), np.uint8))
        count = np.array([p[0].count(b" ") + 1 for p in parts])
        return words, np.cumsum(count) - count, np.array([p[1] for p in parts]), np.array([p[2] for p in parts])

    held, size = [], 0
    for batch in batches:
        for uid, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            body = zlib.decompress(value.as_buffer())
            blanks = np.flatnonzero(np.frombuffer(body, np.uint8) == 0x20) if len(body) > SLICE_BYTES else ()
            for w in range(0, max(1, len(blanks) + 1 - (window - 1)), SLICE_WORDS):
                begin = blanks[w - 1] + 1 if w else 0
                stop = w + SLICE_WORDS + window - 1
                held.append((body[begin : blanks[stop - 1]] if stop <= len(blanks) else body[begin:], uid, w))
                size += len(held[-1][0])
                if size > SLICE_BYTES:
                    yield together(held)
                    held, size = [], 0
    if held:
        yield together(held)


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uid, doc_id, text) -> TEXTS: words with one blank between them, packed."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            bodies = [b" ".join(v.as_buffer().to_pybytes().split()) if v.is_valid else b"" for v in part.column(2)]
            count = [b.count(b" ") + 1 if b else 0 for b in bodies]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(count, pa.int64()), pa.array([zlib.compress(b, 1) for b in bodies], pa.binary())], names=["uid", "doc_id", "n_words", "body"])


def _heads(window: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, first, _, _ in slices(batches, window):
            key, n = np.unique(super_kmers(words, first, window)[2].view(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["key", "n"])

    return run


def _bits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of whole blocks -> each block's bits."""
    found: dict[int, np.ndarray] = {}
    for batch in batches:
        place = batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - BITS)
        block = (place >> np.uint64(BLOCK)).astype(np.int64)
        for b in np.unique(block):
            found.setdefault(int(b), np.zeros(1 << BLOCK, bool))[(place[block == b] & np.uint64((1 << BLOCK) - 1)).astype(np.int64)] = True
    for b, own in found.items():
        yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([np.packbits(own).tobytes()], pa.binary())], names=["block", "bits"])


def bitmap(keys: DataFrame) -> np.ndarray:
    """Where keys lie, of 2**BITS places by their upper bits; 16 MB whatever their number."""
    out = np.zeros(1 << BITS - 3, np.uint8)
    block = F.shiftrightunsigned("key", 64 - BITS + BLOCK)
    dealt = keys.select("key").repartition(1 << BITS - BLOCK - 2, block)
    size = 1 << BLOCK - 3
    for r in dealt.mapInArrow(_bits, "block int, bits binary").toLocalIterator():
        out[r["block"] * size : (r["block"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return out


def _pieces(window: int, bits: np.ndarray, hot: np.ndarray):
    """Texts -> strings with their keys. A string that a task holds once has its place (uid, first word, windows); of those held
    more often the places follow as rows without a string, since all their windows are repeated."""

    def flushed(held: dict[bytes, list]) -> Iterator[pa.RecordBatch]:
        key, piece, uid, at, n = [], [], [], [], []
        for own, (k, size, *places) in held.items():
            once = len(places) == 1
            key.append(k)
            piece.append(own)
            uid.append(places[0][0] if once else None)
            at.append(places[0][1] if once else None)
            n.append(size)
            if not once:
                for u, a in places:
                    key.append(u * 0x9E3779B1 & (1 << 62) - 1)
                    piece.append(None)
                    uid.append(u)
                    at.append(a)
                    n.append(size)
        for i in range(0, len(key), 10_000):
            cut = slice(i, i + 10_000)
            yield pa.RecordBatch.from_arrays([pa.array(key[cut], pa.int64()), pa.array(piece[cut], pa.binary()), pa.array(uid[cut], pa.int64()), pa.array(at[cut], pa.int32()), pa.array(n[cut], pa.int32())], names=["key", "piece", "uid", "at", "n"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0
        for words, first, uids, before in slices(batches, window):
            a, b, key = super_kmers(words, first, window)
            place = (key >> np.uint64(64 - BITS)).astype(np.int64)
            some = np.flatnonzero((bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1).astype(bool))
            a, b, key = a[some], b[some], key[some]
            text = np.searchsorted(first, a, "right") - 1
            uid, at = uids[text], a - first[text] + before[text]
            single = np.isin(key, hot)
            begin, stop = words.starts[a], words.ends[b + window - 2]
            rows = zip(a.tolist(), b.tolist(), key.view(np.int64).tolist(), uid.tolist(), at.tolist(), single.tolist(), begin.tolist(), stop.tolist(), strict=True)
            for i, j, k, u, p, alone, x, y in rows:
                if alone:
                    for w in range(i, j):
                        own = words.data[words.starts[w] : words.ends[w + window - 1]]
                        if own not in held:
                            held[own] = [xxhash.xxh3_64_intdigest(own) - (1 << 63), 1]
                            size += len(own)
                        held[own].append((u, p + w - i))
                else:
                    own = words.data[x:y]
                    if own not in held:
                        held[own] = [k, j - i]
                        size += len(own)
                    held[own].append((u, p))
            if size > HELD_BYTES:
                yield from flushed(held)
                held, size = {}, 0
        yield from flushed(held)

    return run


def repeated(pieces: list[bytes], weight: list[int], window: int) -> list[np.ndarray]:
    """Of each string of a bucket, which of its windows occur more than once in the bucket: windows are sorted, equal ones lie together."""
    windows, which, out = [], [], []
    for i, own in enumerate(pieces):
        blanks = np.flatnonzero(np.frombuffer(own, np.uint8) == 0x20)
        starts, ends = [0, *(blanks + 1).tolist()], [*blanks.tolist(), len(own)]
        for k in range(len(starts) - window + 1):
            windows.append(own[starts[k] : ends[k + window - 1]])
            which.append((i, k))
        out.append(np.full(len(starts) - window + 1, weight[i] > 1))
    order = sorted(range(len(windows)), key=windows.__getitem__)
    for x, y in zip(order, order[1:], strict=False):
        if windows[x] == windows[y]:
            for i, k in (which[x], which[y]):
                out[i][k] = True
    return out


def own_windows(piece: bytes, window: int) -> int:
    return piece.count(b" ") + 2 - window


def stretches(mark: np.ndarray) -> list[tuple[int, int]]:
    """Begin and length of each run of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mark.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), (edge[1::2] - edge[::2]).tolist(), strict=True))


def _buckets(window: int):
    """Strings in order of (key, piece) -> where repeated windows begin: uid, first word, number of windows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pieces, weight, places = None, [], [], []
        uids, ats, ns = [], [], []

        def closed() -> None:
            if len(pieces) > 1:
                marks = repeated(pieces, weight, window)
            elif pieces and weight[0] > 1:
                marks = [np.ones(own_windows(pieces[0], window), bool)]
            else:
                return
            for mark, own in zip(marks, places, strict=True):
                if own and mark.any():
                    for begin, n in stretches(mark):
                        for u, a in own:
                            uids.append(u)
                            ats.append(a + begin)
                            ns.append(n)

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), pa.array(ats, pa.int32()), pa.array(ns, pa.int32())], names=["uid", "at", "n"])
            uids.clear(), ats.clear(), ns.clear()
            return made

        for batch in batches:
            for key, piece, uid, at, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if piece is None:
                    uids.append(uid)
                    ats.append(at)
                    ns.append(n)
                    continue
                if key != now:
                    closed()
                    now, pieces, weight, places = key, [], [], []
                if not pieces or pieces[-1] != piece:
                    pieces.append(piece)
                    weight.append(0)
                    places.append([])
                weight[-1] += 2 if uid is None else 1
                if uid is not None:
                    places[-1].append((uid, at))
            yield out()
        closed()
        yield out()

    return run


OUT = "doc_id long, n_words long, n_removed long, kept_text string, removed array<struct<begin:long,length:long>>"


def _kept(window: int):
    """(doc_id, n_words, body, at, n) -> OUT."""
    span = pa.struct([("begin", pa.int64()), ("length", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                gone, texts, spans = [], [], []
                for n_words, body, at, n in zip(part.column(1).to_pylist(), part.column(2), part.column(3), part.column(4), strict=True):
                    text = zlib.decompress(body.as_buffer())
                    if not at.is_valid:
                        gone.append(0)
                        texts.append(text)
                        spans.append([])
                        continue
                    begin, size = (x.values.to_numpy().astype(np.int64) for x in (at, n))
                    edge = np.bincount(begin, minlength=n_words + 1) - np.bincount(begin + size + window - 1, minlength=n_words + 1)
                    cover = np.cumsum(edge)[:n_words] > 0
                    words = text.split(b" ")
                    texts.append(b" ".join([words[k] for k in np.flatnonzero(~cover).tolist()]))
                    gone.append(int(cover.sum()))
                    spans.append([{"begin": b, "length": k} for b, k in stretches(cover)])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(gone, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(spans, pa.list_(span))], names=["doc_id", "n_words", "n_removed", "kept_text", "removed"])

    return run


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """One row for each document: doc_id, n_words, n_removed, kept_text, removed (stretches of words, from 0).

    Words covered by a window whose word sequence also begins anywhere else, in the same document too, are
    removed; windows are judged on the texts as given. Words are compared as they are; kept ones have one blank between
    them. Null and empty texts have no words; texts of fewer than ``window`` words lose none. Repeated rows are
    documents of their own, so they remove each other. An empty table gives none; other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    texts = staged(rows.mapInArrow(_texts, TEXTS), "substring-texts")
    long = texts.filter(F.col("n_words") >= window).select("uid", "body")
    counted = long.mapInArrow(_heads(window), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1")
    shared = staged(counted, "substring-shared")
    while shared.filter(F.col("n") >= hot).count() > MOST_HOT:
        hot *= 2
    common = shared.filter(F.col("n") >= hot).select("key").toArrow().column("key").to_numpy().view(np.uint64)  # at most MOST_HOT
    pieces = long.mapInArrow(_pieces(window, bitmap(shared), np.sort(common)), PIECES)
    pieces = pieces.repartition("key").sortWithinPartitions("key", "piece")
    found = pieces.mapInArrow(_buckets(window), "uid long, at int, n int")
    found = found.groupBy("uid").agg(F.collect_list("at").alias("at"), F.collect_list("n").alias("n"))
    return texts.join(found, "uid", "left").select("doc_id", "n_words", "body", "at", "n").mapInArrow(_kept(window), OUT)


ORACLE = rf"""WITH d AS (SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT uid, unnest(range(1, len(w) - {WINDOW} + 2)) AS pos FROM d WHERE len(w) >= {WINDOW}),
s AS (SELECT uid, pos, array_to_string(list_slice(w, pos, pos + {WINDOW} - 1), ' ') AS seq FROM p JOIN d USING (uid)),
h AS (SELECT uid, pos FROM s WHERE seq IN (SELECT seq FROM s GROUP BY seq HAVING count(*) > 1)),
g AS (SELECT DISTINCT uid, pos + k AS pos FROM h, range({WINDOW}) AS r(k)),
e AS (SELECT uid, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word FROM d),
k AS (SELECT uid, count(g.pos) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE g.pos IS NULL) AS kept FROM e LEFT JOIN g USING (uid, pos) GROUP BY uid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (uid)"""
