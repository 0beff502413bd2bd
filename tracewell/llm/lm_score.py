"""Language-model scores by a hashed maximum-entropy model with class-factored softmax.

Tokens have identifiers: the ``head`` most frequent words one each, all others one of a fixed number of slots
by hash. An identifier has a class: the end and the most frequent words one of their own, others one by their
last letters. A token's log probability is the sum of three factors'.

1. Its class, given the three tokens before it: a softmax over hashed features, namely each of the three tokens
   by its place (n-gram and skips) and the two before together. Trained by AdaGrad steps on pieces of the corpus
   whose weights are averaged by tokens; the next round goes on from there with the other half of the texts.
2. Its identifier, given its class and the token before it: a log-linear model with a feature for every pair of
   neighbours, so that what it holds grows with the corpus. The features of one context exclude each other, so
   the weights that its gradient leads to, with counts discounted by one, are known in closed form:
   (c - 1 + t p) / n, where c counts the pair, n and t count the tokens and the different tokens of the
   class after this context, and p is the identifier's share of its class.
3. A word that shares its slot: its share of the slot's counts, each plus one; unknown words get what the
   slot's words met once suggest.

Texts are tokenised once to arrays of identifiers. Pairs of neighbours go to buckets by context and class, those
of the most frequent contexts by the whole pair, and come back as sums by document.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fold, staged

FOLDS, HELD_OUT = 7, 2
END = b""  # no word is empty
BITS = 20  # of an identifier
HEAD, SLOTS = 1 << 19, 1 << 19
SINGLE, CLASSES, OFTEN = 28, 48, 256  # classes of one word, all classes, contexts whose pairs are dealt singly
REGION, OWN = 1 << 11, 1 << 10  # rows of the weight table for a place, those of them with one word
ROUNDS, RATE, STEP, PIECE = 2, 0.3, 4096, 4_000_000
WIDE = 16  # rows that one group takes of a sum at a time
FLUSH, BLOCK_DOCS, BLOCK_TOKENS = 400_000, 1 << 15, 4_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: bytes | None) -> list[bytes]:
    words = (text or b"").lower().split()
    words.append(END)
    return words


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a partition's tokens, given out whenever there are very many different ones."""

    def out(seen: Counter) -> Iterator[pa.RecordBatch]:
        words, counts = list(seen), list(seen.values())
        for i in range(0, len(words), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(words[i : i + 20_000], pa.binary()), pa.array(counts[i : i + 20_000], pa.int64())], names=["word", "c"])

    seen: Counter = Counter()
    for batch in batches:
        for text in batch.column(0):
            seen.update(tokens(text.as_py()))
            if len(seen) > FLUSH:
                yield from out(seen)
                seen = Counter()
    yield from out(seen)


def bucket_of(word: bytes) -> int:
    """The class of a word without one of its own, from its last letters."""
    return SINGLE + xxhash.xxh3_64_intdigest(word.rstrip(b".,;:!?\"')|*#$%&")[-3:]) % (CLASSES - SINGLE)


def slot_of(word: bytes) -> int:
    each = SLOTS // (CLASSES - SINGLE)
    return HEAD + (bucket_of(word) - SINGLE) * each + xxhash.xxh3_64_intdigest(word) % each


class Ids(dict):
    """token -> identifier; slots are kept for words met, up to a bound."""

    most = 1_000_000

    def __missing__(self, word: bytes) -> int:
        i = slot_of(word)
        if len(self) < self.most:
            self[word] = i
        return i


_KEPT: dict[str, tuple[str, Ids]] = {}


def kept_ids(name: str, shared) -> Ids:
    """The identifiers of a broadcast vocabulary, made once for a worker process."""
    if _KEPT.get("ids", ("",))[0] != name:
        _KEPT["ids"] = (name, Ids((w, i) for i, w in enumerate(shared.value[0])))
    return _KEPT["ids"][1]


def class_table(head: list[bytes]) -> np.ndarray:
    """The class of each identifier."""
    out = np.zeros(1 << BITS, np.uint8)
    out[: min(SINGLE, len(head))] = np.arange(min(SINGLE, len(head)))
    out[SINGLE : max(SINGLE, len(head))] = [bucket_of(w) for w in head[SINGLE:]]
    each = SLOTS // (CLASSES - SINGLE)
    out[HEAD:] = np.minimum(SINGLE + np.arange(SLOTS) // each, CLASSES - 1)
    return out


def _slots(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([slot_of(w) for w in batch.column(0).to_pylist()], pa.int32()), batch.column(1)], names=["slot", "c"])


_TAIL = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64()), ("known", pa.float64()), ("unknown", pa.float64())]))
TOKENS = pa.schema([("block", pa.int64()), ("idx", pa.int32()), ("doc_id", pa.int64()), ("train", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("logs", pa.float64()), ("ids", pa.binary()), ("tail", _TAIL)])
TOKENS_DDL = "block long, idx int, doc_id long, train boolean, n_tokens long, n_known long, logs double, ids binary, tail array<struct<word:binary,n:long,known:double,unknown:double>>"


def _tokenise(name: str, head):
    """Rows of identifiers; blocks number the rows so that a place in one fits in 15 bits."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = kept_ids(name, head)
        _, many, known, unknown = head.value
        logs = np.log10(many.astype(np.float64) + 1)
        block, idx, held = TaskContext.get().partitionId() << 33, -1, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part, rows, met, times, slots, sizes = batch.slice(at, 128), [], [], [], [], []
                for text in part.column(2):
                    words = tokens(text.as_py())
                    own = np.fromiter(map(ids.__getitem__, words), np.uint32, len(words))
                    idx += 1
                    if idx == BLOCK_DOCS or (idx and held + len(own) > BLOCK_TOKENS):
                        block, idx, held = block + 1, 0, 0
                    held += len(own)
                    inside = own < HEAD
                    outside = np.nonzero(~inside)[0].tolist()
                    rest = Counter(map(words.__getitem__, outside))
                    met += rest
                    times += rest.values()
                    slots += dict(zip(map(words.__getitem__, outside), own[outside].tolist())).values()  # in the same order
                    sizes.append(len(rest))
                    rows.append((block, idx, len(own), int((many[own[inside]] > 0).sum()), float(logs[own[inside]].sum()), own.tobytes()))
                if not rows:
                    continue
                slots = np.array(slots, np.int64) - HEAD
                fields = [pa.array(met, pa.binary()), pa.array(times, pa.int64()), pa.array(known[slots]), pa.array(unknown[slots])]
                tail = pa.ListArray.from_arrays(np.cumsum([0, *sizes]).astype(np.int32), pa.StructArray.from_arrays(fields, fields=list(_TAIL.value_type)))
                cols = list(zip(*rows, strict=True))
                cols = [cols[0], cols[1], part.column(0), part.column(1), *cols[2:], tail]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, TOKENS, strict=True)], schema=TOKENS)

    return run


def before(ids: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """The identifiers k places back; texts begin after ends, whose identifier is 0."""
    out = np.zeros(len(ids), np.int64)
    out[k:] = ids[:-k]
    for j in range(k):
        at = starts + j
        out[at[at < len(ids)]] = 0
    return out


def features(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Rows of the weight table for each token: one, two and three back, and both before."""
    row = np.where(ids < OWN, ids, OWN + (((ids.astype(np.uint64) * _MIX) >> np.uint64(40)) % np.uint64(REGION - OWN)).astype(np.int64))
    pair = ((before(ids, starts, 1) << BITS | before(ids, starts, 2)).astype(np.uint64) * _MIX) >> np.uint64(32)
    # the end's row is 0, as its identifier is
    return np.stack([*(k * REGION + before(row, starts, k + 1) for k in range(3)), 3 * REGION + (pair % np.uint64(REGION)).astype(np.int64)])


def odds(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Each token's class scores less their largest."""
    z = weights.take(rows[0], axis=0)
    for r in rows[1:]:
        z += weights.take(r, axis=0)
    z += bias
    z -= z.max(axis=1, keepdims=True)
    return z


def class_logs(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """log10 of each token's class probability."""
    out = np.empty(len(cls))
    for low in range(0, len(cls), STEP):
        z, t = odds(weights, bias, rows[:, low : low + STEP]), cls[low : low + STEP]
        own = z[np.arange(len(t)), t]
        out[low : low + STEP] = own - np.log(np.exp(z, out=z) @ np.ones(z.shape[1], z.dtype))
    return out / np.log(10)


def sums(x: np.ndarray, order: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of x's rows by groups: ``order`` names the rows, each group's begin at a place of ``at``.

    Groups are cut in chunks of up to ``WIDE`` rows. All chunks' first rows are added to, at once, all their second
    ones and so on, which is what makes it fast for many small groups; what chunks a group has behind its first are groups again.
    """
    size = np.diff(at, append=len(order))
    chunks = (size + WIDE - 1) // WIDE
    first = np.cumsum(chunks) - chunks
    begin = np.repeat(at - first * WIDE, chunks) + np.arange(chunks.sum()) * WIDE
    size = np.minimum(np.repeat(at + size, chunks) - begin, WIDE)
    longest = np.argsort((WIDE - size).astype(np.uint16), kind="stable")
    begin = begin[longest]
    reach = len(size) - np.cumsum(np.bincount(size, minlength=WIDE + 1))  # how many chunks have more rows than that
    out = x.take(order[begin], axis=0)
    for j in range(1, WIDE):
        out[: reach[j]] += x.take(order[begin[: reach[j]] + j], axis=0)
    place = np.empty_like(longest)
    place[longest] = np.arange(len(longest))
    big = np.nonzero(chunks > 1)[0]
    if len(big):
        more = np.ones(len(size), bool)
        more[first] = False
        stops = np.cumsum(chunks[big] - 1)
        out[place[first[big]]] += sums(out, place[more], stops - chunks[big] + 1)
    return out.take(place[first], axis=0)


def _texts(batch: pa.RecordBatch, column: int, most: int = 300_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Some rows of a batch at a time: from, to, their identifiers, and where each row's begin."""
    at = 0
    while at < batch.num_rows:
        own, held, stop = [], 0, at
        while stop < batch.num_rows and (stop == at or held < most):
            own.append(np.frombuffer(batch.column(column)[stop].as_buffer(), np.uint32))
            held += len(own[-1])
            stop += 1
        sizes = np.array([len(x) for x in own])
        yield at, stop, np.concatenate(own).astype(np.int64), np.cumsum(sizes) - sizes
        at = stop


def learn(weights: np.ndarray, power: np.ndarray, bias: np.ndarray, rows: np.ndarray, cls: np.ndarray, rate: float) -> None:
    """AdaGrad steps over some tokens, in place."""
    for low in range(0, len(cls), STEP):
        r, t = rows[:, low : low + STEP], cls[low : low + STEP]
        e = odds(weights, bias, r)
        np.exp(e, out=e)
        e /= (e @ np.ones(e.shape[1], e.dtype))[:, None]
        e[np.arange(len(t)), t] -= 1
        # no row of the table serves two features, so one step does for all; 16 bits are sorted in linear time
        f = r.ravel().astype(np.uint16)
        order = np.argsort(f, kind="stable")
        f = f[order]
        at = np.nonzero(np.diff(f.astype(np.int32), prepend=-1))[0]
        ids, g = f[at], sums(e, order % len(t), at)
        p = power.take(ids, axis=0)
        p += g * g
        power[ids] = p
        g /= np.sqrt(p, out=p)
        g *= np.float32(rate)
        weights[ids] -= g


def _train(shared, rate: float):
    """Rows (piece, ids) in order: for each piece the sum of what its tokens changed, times their number."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, bias, cls = shared.value
        piece, seen, weights, power = None, 0, None, None

        def out() -> Iterator[pa.RecordBatch]:
            if seen:
                step = ((weights - start) * np.float32(seen)).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int64()), pa.array([seen], pa.int64()), pa.array([step], pa.binary())], names=["piece", "n", "step"])

        for batch in batches:
            pieces = batch.column(0).to_numpy()
            cuts = np.r_[0, np.nonzero(np.diff(pieces))[0] + 1, len(pieces)]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if b > a and pieces[a] != piece:
                    yield from out()
                    piece, seen, weights, power = int(pieces[a]), 0, start.copy(), np.full(start.shape, 0.05, np.float32)
                for _, _, ids, starts in _texts(batch.slice(a, b - a), 1):
                    learn(weights, power, bias, features(ids, starts), cls[ids].astype(np.int64), rate)
                    seen += len(ids)
        yield from out()

    return run


def _added(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (group, piece, n, step) sorted by group: a row for each group, with the sums."""
    group, n, total, first = None, 0, None, 0
    for batch in batches:
        for g, piece, m, step in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if g != group:
                if total is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["piece", "n", "step"])
                group, n, total, first = g, 0, np.zeros(len(step) // 4, np.float32), g
            n += m
            total += np.frombuffer(step, np.float32)
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["piece", "n", "step"])


STEPS_DDL = "piece long, n long, step binary"


def trained(rows: DataFrame, total: int, bias: np.ndarray, cls: np.ndarray, rounds: int = ROUNDS, rate: float = RATE, piece: int = PIECE, fan: int = 64) -> np.ndarray:
    """The weight table, from rows (h, ids).

    Rows go to pieces of about ``piece`` tokens by their hash h and are read in its order, so the weights do not
    depend on how the input is split in files. Steps are added up in a tree of ``fan`` branches.
    """
    spark = rows.sparkSession
    weights = np.zeros((4 * REGION, CLASSES), np.float32)
    for turn in range(rounds):
        pieces = max(1, round(total / rounds / max(piece, total / 65_536)))
        shared = spark.sparkContext.broadcast((weights, bias, cls))
        own = rows.filter(F.pmod("h", F.lit(rounds)) == turn).select(F.pmod(F.shiftright("h", 8), F.lit(pieces)).alias("piece"), "h", "ids")
        own = own.repartition(pieces, "piece").sortWithinPartitions("piece", "h", "ids").select("piece", "ids")
        steps = own.mapInArrow(_train(shared, rate / (turn + 1)), STEPS_DDL)
        while pieces > 1:
            pieces = -(-pieces // fan)
            grouped = steps.select(F.pmod("piece", F.lit(pieces)).alias("group"), "piece", "n", "step")
            steps = grouped.repartition(pieces, "group").sortWithinPartitions("group", "piece").mapInArrow(_added, STEPS_DDL)
        for r in steps.collect():  # one table
            weights = weights + np.frombuffer(r["step"], np.float32).reshape(weights.shape) / np.float32(r["n"])
    return weights


def _classes(shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias, cls = shared.value
        for batch in batches:
            sums = [np.add.reduceat(class_logs(weights, bias, features(ids, starts), cls[ids].astype(np.int64)), starts) for _, _, ids, starts in _texts(batch, 2)]
            if sums:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(sums))], names=["block", "idx", "by_class"])

    return run


def _zipped(x: np.ndarray) -> bytes:
    """Numbers as planes of bytes, compressed."""
    return pa.compress(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes(), codec="zstd", asbytes=True)


def _unzipped(data: bytes, n: int, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(pa.decompress(data, n * size, codec="zstd"), np.uint8).reshape(size, n).T).view(kind).reshape(n)


def pair_keys(ids: np.ndarray, starts: np.ndarray, cls: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the tokens whose class has several: their places, keys (the token before and the token), and buckets."""
    context = before(ids, starts, 1)
    at = np.nonzero(cls[ids] >= SINGLE)[0]
    h, w = context[at], ids[at]
    key = (h << BITS | w).astype(np.uint64)
    group = np.where(h < OFTEN, key, (h * CLASSES + cls[w]).astype(np.uint64))
    return at, key, ((group * _MIX) >> np.uint64(32)) % np.uint64(buckets)


PAIRS_DDL = "bucket int, block long, k int, n int, keys binary, counts binary, docs binary"
PAIRS = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("k", pa.int32()), ("n", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("docs", pa.binary())])


def _pairs(shared, buckets: int, often: bool):
    """Rows (block, idx, train, ids): for each block and bucket its keys, how often each occurs, and in which rows.

    With ``often`` only the pairs of the most frequent contexts, without the rows. A row is its place in the
    block, with the highest bit set if it is held out.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, cls = shared.value
        at_block, held, parts = None, 0, []

        def out() -> Iterator[pa.RecordBatch]:
            if not any(len(p[0]) for p in parts):
                return
            bucket, key, doc = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(bucket << np.uint64(2 * BITS) | key)  # in which order rows stand at a key makes no difference
            bucket, key, doc = bucket[order], key[order], doc[order]
            cuts = np.nonzero(np.diff(bucket.astype(np.int64), prepend=-1))[0]
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(bucket)], strict=True):
                first = np.nonzero(np.diff(key[a:b].astype(np.int64), prepend=-1))[0]
                keys, counts = key[a:b][first], np.diff(first, append=b - a).astype(np.uint32)
                row = [int(bucket[a]), at_block, len(keys), b - a, _zipped(np.diff(keys, prepend=np.uint64(0))), _zipped(counts), None if often else doc[a:b].tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, PAIRS, strict=True)], schema=PAIRS)

        for batch in batches:
            blocks = batch.column(0).to_numpy()
            cuts = np.r_[0, np.nonzero(np.diff(blocks))[0] + 1, len(blocks)]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if b == a:
                    continue
                if blocks[a] != at_block or held > BLOCK_TOKENS:
                    yield from out()
                    at_block, held, parts = int(blocks[a]), 0, []
                part = batch.slice(a, b - a)
                for i, j, ids, starts in _texts(part, 3):
                    at, key, bucket = pair_keys(ids, starts, cls, buckets)
                    mark = part.column(1).slice(i, j - i).to_numpy() | np.where(np.asarray(part.column(2).slice(i, j - i)), 0, 1 << 15)
                    doc = np.repeat(mark.astype(np.uint16), np.diff(starts, append=len(ids)))[at]
                    if often:
                        use = (key >> np.uint64(BITS) < OFTEN) & (doc < 1 << 15)
                        key, bucket, doc = key[use], bucket[use], doc[use]
                    parts.append((bucket, key, doc))
                    held += len(ids)
        yield from out()

    return run


def _by_bucket(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    at, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] != at:
                if held:
                    yield at, held
                at, held = row["bucket"], []
            row["key"] = np.cumsum(_unzipped(row.pop("keys"), row["k"], np.uint64), dtype=np.uint64)
            row["count"] = _unzipped(row.pop("counts"), row["k"], np.uint32)
            held.append(row)
    if held:
        yield at, held


def _tallies(shared):
    """Of the most frequent contexts, by class: tokens and different tokens that follow, in one bucket."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, cls = shared.value
        n, t = np.zeros(OFTEN * CLASSES), np.zeros(OFTEN * CLASSES)
        for _, rows in _by_bucket(batches):
            key, count = (np.concatenate([r[c] for r in rows]) for c in ("key", "count"))
            n += np.bincount(_group(key, cls), count, minlength=len(n))
            t += np.bincount(_group(np.unique(key), cls), minlength=len(t))
        some = np.nonzero(n)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some].astype(np.int64)), pa.array(t[some].astype(np.int64))], names=["hc", "n", "t"])

    return run


def _group(key: np.ndarray, cls: np.ndarray) -> np.ndarray:
    key = key.astype(np.int64)
    return (key >> BITS) * CLASSES + cls[key & ((1 << BITS) - 1)]


def pair_logs(key: np.ndarray, c: np.ndarray, cls: np.ndarray, share: np.ndarray, often: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """log10 probability of each key's token, given its class and context; c: counts of different keys, all of a context and class here."""
    groups, inverse = np.unique(_group(key, cls), return_inverse=True)
    n, t = np.bincount(inverse, c), np.bincount(inverse, c > 0).astype(float)
    top = groups < OFTEN * CLASSES
    n[top], t[top] = often[0][groups[top]], often[1][groups[top]]
    n, t = np.where(n > 0, n, 1.0), np.where(n > 0, t, 1.0)
    p = share[(key & np.uint64((1 << BITS) - 1)).astype(np.int64)]
    return np.log10((np.maximum(c - 1, 0) + t[inverse] * p) / n[inverse])


def _within(shared, more):
    """Sums of the second factor by row: (bucket, block, rows, sums)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, cls = shared.value
        share, often = more.value
        for bucket, rows in _by_bucket(batches):
            seen = []
            for r in rows:
                r["docs"], r["at"] = np.frombuffer(r["docs"], np.uint16), np.repeat(np.arange(r["k"]), r["count"])
                seen.append(np.bincount(r["at"][r["docs"] < 1 << 15], minlength=r["k"]))
            keys, inverse = np.unique(np.concatenate([r["key"] for r in rows]), return_inverse=True)
            logs = pair_logs(keys, np.bincount(inverse, np.concatenate(seen)), cls, share, often)[inverse]
            at = 0
            for r in rows:
                docs = r["docs"] & 0x7FFF
                sums = np.bincount(docs, logs[at : at + r["k"]][r["at"]])
                some = np.nonzero(sums)[0]
                at += r["k"]
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([r["block"]], pa.int64()), pa.array([some.astype(np.uint16).tobytes()], pa.binary()), pa.array([sums[some].tobytes()], pa.binary())], names=["bucket", "block", "rows", "sums"])

    return run


def _by_row(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, bucket, rows, sums) sorted: (block, idx, by_token)."""

    def out(block: int, sums: np.ndarray) -> pa.RecordBatch:
        some = np.nonzero(sums)[0]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(some), block)), pa.array(some, pa.int32()), pa.array(sums[some])], names=["block", "idx", "by_token"])

    block, sums = None, np.zeros(BLOCK_DOCS)
    for batch in batches:
        for b, _, rows, values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if b != block:
                if block is not None:
                    yield out(block, sums)
                block, sums = b, np.zeros(BLOCK_DOCS)
            sums[np.frombuffer(rows, np.uint16)] += np.frombuffer(values, np.float64)
    if block is not None:
        yield out(block, sums)


def lm_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD, rounds: int = ROUNDS, rate: float = RATE, piece: int = PIECE) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null texts count as empty and have one token, the end. The model learns from the rows whose
    identifier's crc32 modulo 7 is not 2, repeated rows as often as they occur; null identifiers count as
    the empty text. Without training rows every token is unknown. An empty table gives no rows; other
    columns are not read. The words and counts of the ``head`` most frequent tokens and tables of a fixed
    number of slots are broadcast; all other words are joined as they are written, all pairs by key.
    """
    spark = docs.sparkSession
    if head > HEAD:
        raise ValueError(f"at most {HEAD} words have identifiers of their own")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (fold(F.col(id_col).cast("long"), FOLDS) != HELD_OUT).alias("train"), F.col(text_col).cast("binary").alias("t"))
    counts = rows.filter("train").select("t").mapInArrow(_count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))
    vocab = staged(counts, "lm-vocabulary")
    # the head is all words with a count that fewer than ``head`` reach; the window is over different counts, of which there are few
    tally = vocab.groupBy("c").agg(F.count("*").alias("n"))
    reach = tally.select("c", F.sum("n").over(Window.orderBy(F.desc("c"))).alias("reach")).filter(F.col("reach") < head)
    least = reach.agg(F.min("c")).first()[0]
    least = 2**62 if least is None else least
    is_end = F.length("word") == 0
    best = vocab.filter((F.col("c") >= least) & ~is_end).toArrow()
    best = sorted(zip(best.column(0).to_pylist(), best.column(1).to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))
    ends = vocab.filter(is_end).agg(F.sum("c")).first()[0] or 0
    words, many = [END, *(w for w, _ in best)], np.array([ends, *(n for _, n in best)], np.int64)
    cls = class_table(words)

    # slots: their number of tokens, different words, and words met once
    tail = vocab.filter((F.col("c") < least) & ~is_end).mapInArrow(_slots, "slot int, c long")
    slot = tail.groupBy("slot").agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.sum((F.col("c") == 1).cast("long")).alias("once")).toArrow()
    size, distinct, once = (np.zeros(SLOTS) for _ in range(3))
    at = slot.column("slot").to_numpy() - HEAD
    for table, name in ((size, "n"), (distinct, "v"), (once, "once")):
        table[at] = slot.column(name).to_numpy()
    unseen = np.where(size > 0, np.minimum((once + 0.5) / (size + 1), 0.5), 1.0)
    known = np.log10(np.maximum(1 - unseen, 1e-12)) - np.log10(np.maximum(size + distinct, 1))
    of_id = np.r_[many, np.zeros(HEAD - len(many), np.int64), size]
    exists = np.r_[np.ones(len(many)), np.zeros(HEAD - len(many)), np.ones(SLOTS)]
    of_class, ids_of_class = np.bincount(cls, of_id, minlength=CLASSES), np.bincount(cls, exists, minlength=CLASSES)
    share = (of_id + 1) * exists / (of_class + ids_of_class)[cls]
    total, types = int(of_id.sum()), int(len(many) - (ends == 0) + distinct.sum())
    bias = np.log((of_class + 0.1) / (total + 0.1 * CLASSES)).astype(np.float32)

    name = uuid.uuid4().hex
    vocabulary = spark.sparkContext.broadcast((words, many, known, np.log10(unseen)))
    texts = rows.select("doc_id", "train", "t").mapInArrow(_tokenise(name, vocabulary), TOKENS_DDL)
    texts = staged(texts, "lm-tokens")
    in_all = texts.agg(F.sum("n_tokens")).first()[0] or 0

    own = texts.filter("train").select(F.xxhash64("doc_id", "ids").alias("h"), "ids")
    weights = trained(own, total, bias, cls, rounds, rate, piece)
    shared = spark.sparkContext.broadcast((weights, bias, cls))
    by_class = texts.select("block", "idx", "ids").mapInArrow(_classes(shared), "block long, idx int, by_class double")

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parts, -(-in_all // BLOCK_TOKENS))
    deal = lambda often: texts.select("block", "idx", "train", "ids").mapInArrow(_pairs(shared, buckets, often), PAIRS_DDL).repartition(buckets, "bucket").sortWithinPartitions("bucket", "block")
    tallies = deal(True).mapInArrow(_tallies(shared), "hc int, n long, t long").groupBy("hc").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).toArrow()
    often = np.zeros((2, OFTEN * CLASSES))
    often[:, tallies.column("hc").to_numpy()] = tallies.column("n").to_numpy(), tallies.column("t").to_numpy()
    more = spark.sparkContext.broadcast((share, (often[0], often[1])))
    sums = deal(False).mapInArrow(_within(shared, more), "bucket int, block long, rows binary, sums binary")
    by_token = sums.repartition(parts, "block").sortWithinPartitions("block", "bucket").select("block", "bucket", "rows", "sums").mapInArrow(_by_row, "block long, idx int, by_token double")

    rest = texts.select("block", "idx", F.explode("tail").alias("t")).join(vocab.select(F.col("word").alias("w"), "c"), F.col("t.word") == F.col("w"), "left")
    c = F.coalesce("c", F.lit(0))
    rest = rest.groupBy("block", "idx").agg(F.sum(F.when(c > 0, F.col("t.n")).otherwise(0)).alias("k"), F.sum(F.col("t.n") * F.log10(c + 1)).alias("l"), F.sum(F.col("t.n") * F.when(c > 0, F.col("t.known") + F.log10(c + 1)).otherwise(F.col("t.unknown"))).alias("s"))
    out = texts.select("block", "idx", "doc_id", "train", "n_tokens", "n_known", "logs").join(by_class, ["block", "idx"]).join(by_token, ["block", "idx"], "left").join(rest, ["block", "idx"], "left")
    zero = F.lit(0.0)
    base = F.col("logs") + F.coalesce("l", zero) - F.col("n_tokens") * F.lit(float(np.log10(total + types + 1)))
    score = F.col("by_class") + F.coalesce("by_token", zero) + F.coalesce("s", zero)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"))
