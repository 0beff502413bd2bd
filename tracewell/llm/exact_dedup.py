"""Exact deduplication with radix tries that own the texts.

Texts are equal when they are identical without white space. Each input partition first merges
its own copies, so that however large a group is, at most a few rows of it per partition are
shuffled. Representatives then go to partitions by length and content hash, where their full
bytes are inserted into a Patricia trie; terminals hold the best row. A text that very many partitions
hold is merged twice, first in shares of them, so that no task gets all its representatives. A trie over its memory
budget spills its largest subtree to the task's own scratch file and goes through it afterwards.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, hinted, staged
from .worker import turn

#: Bytes of text that a trie holds before it spills a subtree, or that a partition's own trie holds before it is emptied.
TRIE_BYTES = 48 << 20
BATCH = 512
#: A text with more representatives is merged in so many shares first.
SHARES = 64


class Node:
    __slots__ = ("edge", "kids", "value", "spill")

    def __init__(self, edge: bytes):
        self.edge, self.kids, self.value, self.spill = edge, None, None, None


def _common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of a and b[at:]."""
    n = min(len(a), len(b) - at)
    if a[:n] == b[at : at + n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[at + low : at + mid]:
            low = mid
        else:
            high = mid
    return low


class Trie:
    """A radix trie from byte strings to values. ``merge(old, new)`` combines values of equal strings."""

    def __init__(self, merge, budget: int = TRIE_BYTES):
        self.root, self.merge, self.budget, self.bytes, self.spills = Node(b""), merge, budget, 0, []

    def add(self, text: bytes, value) -> None:
        node, at = self.root, 0
        while True:
            if at == len(text):
                node.value = value if node.value is None else self.merge(node.value, value)
                return
            kids = node.kids
            kid = kids.get(text[at]) if kids else None
            if kid is None:
                kid = Node(text[at:])
                kid.value = value
                if kids is None:
                    node.kids = kids = {}
                kids[text[at]] = kid
                self.bytes += len(kid.edge) + 200
                if self.bytes > self.budget:
                    self._spill()
                return
            n = _common(kid.edge, text, at)
            if kid.spill is not None:  # below the root; its edge is what all its texts begin with
                kid.edge = kid.edge[:n]
                pickle.dump((text, value), kid.spill, protocol=5)
                return
            if n < len(kid.edge):  # split the edge
                upper = Node(kid.edge[:n])
                kid.edge = kid.edge[n:]
                upper.kids = {kid.edge[0]: kid}
                kids[text[at]] = upper
                self.bytes += 200
                kid = upper
            at += n
            node = kid

    def _size(self, node: Node) -> int:
        todo, total = [node], 0
        while todo:
            x = todo.pop()
            total += len(x.edge) + 200
            todo += x.kids.values() if x.kids else ()
        return total

    def _spill(self) -> None:
        """Moves subtrees below the root to scratch files, the largest first, until half the budget is free."""
        sizes = sorted(((self._size(k), k) for k in (self.root.kids or {}).values() if k.spill is None), key=lambda x: -x[0])
        for size, kid in sizes:
            if self.bytes <= self.budget // 2:
                break
            kid.spill = tempfile.TemporaryFile()
            for text, value in self._walk(kid, b""):
                pickle.dump((text, value), kid.spill, protocol=5)
            kid.kids = kid.value = None
            self.bytes -= size
            self.spills.append(kid)

    def _walk(self, node: Node, prefix: bytes) -> Iterator[tuple[bytes, object]]:
        todo = [(node, prefix + node.edge)]
        while todo:
            x, text = todo.pop()
            if x.value is not None:
                yield text, x.value
            for kid in x.kids.values() if x.kids else ():
                if kid.spill is None:
                    todo.append((kid, text + kid.edge))

    def items(self) -> Iterator[tuple[bytes, object]]:
        """All strings with their merged values; spilled subtrees come last, each through a trie of its own."""
        yield from self._walk(self.root, b"")
        self.root.kids = None
        for kid in self.spills:
            below, file = Trie(self.merge, self.budget), kid.spill
            file.seek(0)
            while True:
                try:
                    text, value = pickle.load(file)
                except EOFError:
                    break
                below.add(text[len(kid.edge) :], value)
            file.close()
            for text, value in below.items():
                yield kid.edge + text, value


def _order(n: int, doc_id) -> tuple:
    """Sorts the row that stays first: most code points, smallest identifier, null last."""
    return (-n, doc_id is None, doc_id or 0)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(col, f.type) for col, f in zip(zip(*rows), schema, strict=True)], schema=schema)


LOCAL = pa.schema([("part", pa.int32()), ("rep", pa.int64()), ("sha", pa.binary()), ("length", pa.int64()), ("body", pa.binary()), ("best", pa.int32()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))])
LOCAL_DDL = "part int, rep long, sha binary, length long, body binary, best int, ids array<long>, sizes array<long>"


def _local(budget: int):
    """Merges the copies within a partition. A row: a text, and the identifiers and sizes of the rows that have it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("dedup")
        part, rep = TaskContext.get().partitionId(), 0

        def merge(old, new):
            old[0].extend(new[0])
            old[1].extend(new[1])
            trie.bytes += 80 * len(new[0])  # identifiers and sizes count as well, so a text of very many rows gives several representatives
            return old

        def flush(trie: Trie) -> Iterator[pa.RecordBatch]:
            nonlocal rep
            rows, held = [], 0
            for text, (ids, sizes) in trie.items():
                best = min(range(len(ids)), key=lambda i: (*_order(sizes[i], ids[i]), i))
                rows.append((part, rep, hashlib.sha256(text).digest(), len(text), text, best, ids, sizes))
                rep, held = rep + 1, held + len(text)
                if len(rows) >= BATCH or held > 8 << 20:
                    yield _batch(rows, LOCAL)
                    rows, held = [], 0
            if rows:
                yield _batch(rows, LOCAL)

        trie = Trie(merge, 1 << 62)
        for batch in batches:
            for doc_id, text, n in zip(*(batch.column(i) for i in range(3)), strict=True):
                body = (text.as_py() or b"").translate(None, BLANKS)
                trie.add(body, ([doc_id.as_py()], [n.as_py() or 0]))
                if trie.bytes > budget:
                    yield from flush(trie)
                    trie = Trie(merge, 1 << 62)
        yield from flush(trie)

    return run


REPS = "part int, rep long, body binary, n long, i long, count long, best_part int, best_rep long"
OWNED = pa.schema([("part", pa.int32()), ("rep", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("best_part", pa.int32()), ("best_rep", pa.int64())])
OWNED_DDL = "part int, rep long, keep_id long, group_size long, best_part int, best_rep long"


def _merged(budget: int, batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[bytes, list]]:
    """Rows of REPS -> each text with its best row (its order, part, rep, identifier), how many rows have it, its representatives."""

    def merge(old, new):
        old[0] = min(old[0], new[0])
        old[1] += new[1]
        old[2].extend(new[2])
        trie.bytes += 80
        return old

    trie = Trie(merge, budget)
    for batch in batches:
        for part, rep, body, n, doc_id, count, best_part, best_rep in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            trie.add(body, [(*_order(n, doc_id), best_part, best_rep, doc_id, n), count, [(part, rep)]])
    yield from trie.items()


def _owners(budget: int):
    """Representatives -> who owns the text of each, and which row is the best."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("dedup")
        rows = []
        for _, (best, count, reps) in _merged(budget, batches):
            for part, rep in reps:
                rows.append((part, rep, best[-2], count, best[3], best[4]))
                if len(rows) >= 10_000:
                    yield _batch(rows, OWNED)
                    rows = []
        if rows:
            yield _batch(rows, OWNED)

    return run


SHARED = pa.schema([("part", pa.int32()), ("rep", pa.int64()), ("body", pa.binary()), ("n", pa.int64()), ("i", pa.int64()), ("count", pa.int64()), ("best_part", pa.int32()), ("best_rep", pa.int64()), ("of_part", pa.int32()), ("of_rep", pa.int64())])
SHARED_DDL = f"{REPS}, of_part int, of_rep long"


def _shares(budget: int):
    """Representatives -> one for each text of the task, under a number of its own (parts below 0), and rows that tell for which others
    it stands (of_part, of_rep; no body)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("dedup")
        own, rows = -1 - TaskContext.get().partitionId(), []
        for k, (body, (best, count, reps)) in enumerate(_merged(budget, batches)):
            rows.append((own, k, body, best[-1], best[-2], count, best[3], best[4], None, None))
            rows += [(own, k, None, None, None, None, None, None, part, rep) for part, rep in reps]
            if len(rows) >= BATCH:
                yield _batch(rows, SHARED)
                rows = []
        if rows:
            yield _batch(rows, SHARED)

    return run


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = TRIE_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, n_code_points.

    Null texts count as empty. Of equal texts the row with the most code points stays, then the one
    with the smallest identifier, a null identifier last; of rows alike in both exactly one is kept.
    An empty table gives none; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("binary").alias("t"), F.length(text_col).cast("long").alias("n"))
    local = staged(rows.mapInArrow(_local(budget), LOCAL_DDL), "dedup-local")
    at = F.col("best") + 1
    key = ["length", "sha"]
    reps = local.select("part", "rep", "body", F.element_at("sizes", at).alias("n"), F.element_at("ids", at).alias("i"), F.size("ids").cast("long").alias("count"), F.col("part").alias("best_part"), F.col("rep").alias("best_rep"), *key)
    parts, columns = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), [c.split(" ")[0] for c in REPS.split(", ")]
    hot = staged(local.groupBy(*key).count().filter(F.col("count") > SHARES).select(*key), "dedup-hot")
    if hot.isEmpty():
        owned = reps.repartition(parts, *key).select(*columns).mapInArrow(_owners(budget), OWNED_DDL)
    else:
        hot = hinted(hot)
        dealt = reps.join(hot, key).repartition(parts, *key, F.col("part") % SHARES)
        shared = staged(dealt.select(*columns).mapInArrow(_shares(budget), SHARED_DDL), "dedup-shares")
        stand = shared.filter("body is not null").select(*columns, F.length("body").cast("long").alias("length"), F.sha2("body", 256).alias("sha"))
        rest = reps.join(hot, key, "left_anti").select(*columns, "length", F.lower(F.hex("sha")).alias("sha"))
        owned = staged(rest.unionByName(stand).repartition(parts, *key).select(*columns).mapInArrow(_owners(budget), OWNED_DDL), "dedup-owned")
        through = shared.filter("body is null").select("part", "rep", "of_part", "of_rep").join(owned.filter("part < 0"), ["part", "rep"])
        owned = owned.filter("part >= 0").unionByName(through.select(F.col("of_part").alias("part"), F.col("of_rep").alias("rep"), "keep_id", "group_size", "best_part", "best_rep"))
    owned = owned.withColumn("own", (F.col("part") == F.col("best_part")) & (F.col("rep") == F.col("best_rep"))).drop("best_part", "best_rep")
    members = local.select("part", "rep", F.lower(F.hex("sha")).alias("text_sha256"), "best", F.arrays_zip("ids", "sizes").alias("m")).join(owned, ["part", "rep"])
    out = members.select("*", F.posexplode("m").alias("pos", "x"))
    kept = F.col("own") & (F.col("pos") == F.col("best"))
    return out.select(F.col("x.ids").alias("doc_id"), "keep_id", "group_size", kept.alias("kept"), "text_sha256", F.col("x.sizes").alias("n_code_points"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = TRIE_BYTES) -> DataFrame:
    """docs with one row of each group of equal texts, its columns as they were."""
    # one key that is never null, so that the join's partitions serve the removal of repeated rows as well
    key = lambda i, sha, n: F.concat_ws("/", F.coalesce(i.cast("string"), F.lit("-")), n.cast("string"), sha)
    kept = exact_dedup(docs, id_col, text_col, budget).filter("kept").select(key(F.col("doc_id"), F.col("text_sha256"), F.col("n_code_points")).alias("_dedup_kept"))
    plain = F.translate(F.coalesce(F.col(text_col), F.lit("")), " \t\n\x0b\x0c\r", "")
    keyed = docs.withColumn("_dedup_key", key(F.col(id_col).cast("long"), F.sha2(plain, 256), F.coalesce(F.length(text_col), F.lit(0))))
    out = keyed.join(kept, F.col("_dedup_key") == F.col("_dedup_kept"), "left_semi")
    return out.dropDuplicates(["_dedup_key"]).select(*docs.columns)
