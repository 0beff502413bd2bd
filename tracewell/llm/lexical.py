"""Ranked lexical search: few items ask, all documents answer, by an Aho-Corasick scan of the texts.

The terms of the items make one automaton, each between two blanks, so that only whole terms match. A text is
folded byte by byte (what is no term character becomes a blank, A-Z become a-z) and read once; what the automaton
puts out are the terms, and those lead to the items. There is no index of the documents: the scan leaves, for
each document, its length and how often it holds the items' terms; counts over all documents follow from
that, then the scores. Items are dealt out in blocks of bounded size, so what is sent to the tasks is
bounded; each block of items scans the documents once.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Terms are the maximal matches of this; only A-Z are lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_FOLD = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
BEST = 50
#: So many characters of items make a block, on average.
BLOCK_CHARS = 4_000_000
RANKS = "item_id {kind}, rank int, doc_id long, score long"


def folded(text: bytes) -> bytes:
    """Terms between blanks; every character outside of ASCII is a term character, so UTF-8 bytes can be folded one by one."""
    return b" " + text.translate(_FOLD) + b" "


def terms(text: str | None) -> list[str]:
    """A text's terms in order, as the automaton knows them: UTF-8 bytes read as Latin-1."""
    return (text or "").encode().translate(_FOLD).decode("latin-1").split(" ")


def distinct_terms(texts: Iterable[str | None]) -> set[str]:
    return {t for text in texts for t in terms(text)} - {""}


def length(text: bytes) -> int:
    """Terms of a folded text: as many as blanks that a term follows."""
    blank = np.frombuffer(text, np.uint8) == 0x20
    return int(np.count_nonzero(blank[:-1] & ~blank[1:]))


@lru_cache(maxsize=2)
def automaton(words: tuple[str, ...]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for k, word in enumerate(words):
        out.add_word(f" {word} ", k)
    out.make_automaton()
    return out


COUNTS = "doc_id long, n long, term array<int>, tf array<int>"


def _scan(words: tuple[str, ...]):
    """(doc_id, text in bytes) -> for each document its length, the items' terms in it and how often each occurs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(words)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sizes, own, often = [], [], []
                for value in part.column(1):
                    text = folded(value.as_buffer().to_pybytes() if value.is_valid else b"")
                    sizes.append(length(text))
                    hits = np.fromiter((k for _, k in found.iter(text.decode("latin-1"))), np.int32) if sizes[-1] else np.empty(0, np.int32)
                    term, tf = np.unique(hits, return_counts=True)
                    own.append(term)
                    often.append(tf.astype(np.int32))
                starts = pa.array(np.cumsum([0, *map(len, own)]), pa.int32())
                lists = [pa.ListArray.from_arrays(starts, pa.array(np.concatenate(x).astype(np.int32))) for x in (own, often)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), *lists], names=["doc_id", "n", "term", "tf"])

    return run


class Best:
    """The k best (score, then document) of each item among all that were offered, in bounded memory."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.zeros(items, np.int64)
        self.rows = [np.empty(0, np.int64)] * 4  # item, score, document, 1 where the document has no identifier

    def offer(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray, blank: np.ndarray) -> None:
        keep = score >= np.maximum(1, self.least[item])
        if keep.any():
            self.rows = [np.concatenate([old, new[keep]]) for old, new in zip(self.rows, (item, score, doc, blank), strict=True)]
        if len(self.rows[0]) > 4 * self.k * len(self.least) + 4096:
            self.cut()

    def cut(self) -> None:
        item, score, doc, blank = self.rows
        order = np.lexsort((doc, blank, -score, item))
        item = item[order]
        first = np.searchsorted(item, item)
        place = np.arange(len(item)) - first
        kept = order[place < self.k]
        last = order[place == self.k - 1]
        self.rows = [x[kept] for x in self.rows]
        if len(last):
            self.least[item[place == self.k - 1]] = score[last]


def scores(n: np.ndarray, starts: np.ndarray, term: np.ndarray, tf: np.ndarray, weight: np.ndarray, post: np.ndarray, stops: np.ndarray, total: int, length: int, items: int) -> np.ndarray:
    """Documents by items: the sum of w * ((10^9 tf) div (1000 tf + 20 m)) over the terms that both hold."""
    m = np.array([50 + (50 * int(x) * total) // length for x in n], np.int64)
    doc = np.repeat(np.arange(len(n)), np.diff(starts))
    tf = tf.astype(np.int64)
    part = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
    size = stops[term + 1] - stops[term]
    at = np.repeat(stops[term] - np.cumsum(size) + size, size) + np.arange(size.sum())
    out = np.zeros(len(n) * items, np.int64)
    np.add.at(out, np.repeat(doc, size) * items + post[at], np.repeat(part, size))
    return out.reshape(len(n), items)


def _rank(weight: np.ndarray, post: np.ndarray, stops: np.ndarray, total: int, length: int, items: int, k: int):
    """Counts of documents -> the k best documents of each item among the task's."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, step = Best(items, k), max(1, (1 << 20) // items)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                lists, ids = part.column(2), part.column(0)
                starts = lists.offsets.to_numpy()
                of = scores(part.column(1).to_numpy(), starts, lists.flatten().to_numpy(), part.column(3).flatten().to_numpy(), weight, post, stops, total, length, items)
                doc, item = np.nonzero(of >= np.maximum(1, best.least))
                number, blank = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
                best.offer(item, of[doc, item], number[doc], blank[doc])
        best.cut()
        item, score, doc, blank = best.rows
        part = np.full(len(item), TaskContext.get().partitionId())
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(doc, pa.int64(), mask=blank == 1), pa.array(score, pa.int64()), pa.array(part, pa.int64())], names=["item", "doc_id", "score", "part"])

    return run


def first(df: DataFrame, keys: list[str], order: list, k: int, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= k)


def _block(docs: DataFrame, wanted: dict, kind: str, k: int) -> DataFrame | None:
    """The ranks of one block of items: identifier -> terms."""
    ids = [i for i, own in wanted.items() if own]
    words = sorted({t for i in ids for t in wanted[i]})
    if not words:
        return None
    spark = docs.sparkSession
    counts = staged(docs.mapInArrow(_scan(tuple(words)), COUNTS), "lexical-counts")
    total, length = counts.filter("n > 0").agg(F.count("*"), F.sum("n")).first()
    if not total:
        return None
    seen = np.zeros(len(words), np.int64)
    for r in counts.select(F.explode("term").alias("t")).groupBy("t").count().toLocalIterator():  # as many rows as terms in the block
        seen[r["t"]] = r["count"]
    weight = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * int(df) + 1))) for df in seen], np.int64)
    number = {t: n for n, t in enumerate(words)}
    pairs = sorted((number[t], item) for item, i in enumerate(ids) for t in wanted[i])
    post = np.array([p[1] for p in pairs], np.int64)
    stops = np.searchsorted(np.array([p[0] for p in pairs]), np.arange(len(words) + 1))
    rows = counts.filter("size(term) > 0").mapInArrow(_rank(weight, post, stops, total, length, len(ids), k), "item int, doc_id long, score long, part long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    rows = first(rows.withColumn("part", F.col("part") % 64), ["item", "part"], order, k)
    rows = first(rows, ["item"], order, k)
    names = spark.createDataFrame(list(enumerate(ids)), f"item int, item_id {kind}")
    return rows.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", k: int = BEST, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Each item's k highest-scoring documents with a score above 0: item_id, rank from 1, doc_id, score.

    Null and empty texts, of items or documents, have no terms. Items of the same identifier (null is one) are one
    item with the terms of all; each row of docs is a document, also one like another, and those without an
    identifier come last among equal scores. Other columns are not read. Empty tables give no rows.
    """
    spark = docs.sparkSession
    kind = dict(items.dtypes)[item_col]
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    asked = items.select(F.col(item_col).alias("id"), F.col(item_text).alias("text"))
    chars = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = math.ceil(chars / block_chars)
    found = []
    for b in range(blocks):
        wanted: dict = {}
        for r in asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toLocalIterator():
            wanted.setdefault(r["id"], set()).update(distinct_terms([r["text"]]))
        found.append(_block(texts, wanted, kind, k))
    none = spark.createDataFrame([], RANKS.format(kind=kind))
    return reduce(DataFrame.unionByName, [ranks for ranks in found if ranks is not None] or [none])


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE = f"""WITH d AS (SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{TERM}') AS ts FROM documents),
h AS (SELECT uid, doc_id, len(ts) AS n, ts FROM d WHERE len(ts) > 0),
c AS (SELECT count(*) AS total, CAST(sum(n) AS BIGINT) AS length FROM h),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{TERM}')) AS term FROM benchmark),
o AS (SELECT uid, doc_id, n, unnest(ts) AS term FROM h),
f AS (SELECT uid, doc_id, n, term, count(*) AS tf FROM o WHERE term IN (SELECT term FROM q) GROUP BY uid, doc_id, n, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * total + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM f GROUP BY term) x, c),
s AS (SELECT item_id, uid, doc_id, CAST(sum(w.w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * total) // length)))) AS BIGINT) AS score
  FROM f JOIN w USING (term) JOIN q USING (term), c GROUP BY item_id, uid, doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= {BEST}"""

