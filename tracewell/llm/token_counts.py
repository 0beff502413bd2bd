"""Token counts of whole texts, huge ones by overlapping chunks that are spliced again.

A text of up to ``chunk`` characters is encoded where it lies. A longer one is cut into chunks that
overlap; every chunk is encoded with offsets, wherever Spark puts it. Two neighbours are spliced at
a place in their overlap at which both have a token boundary and which is stable (see encoding).
Where neighbours have none in common, the text is cut again with a wider overlap, at last as a whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hinted, staged
from .encoding import STABLE, counts, load
from .worker import turn

CHUNK, OVERLAP, WIDER = 32_768, 256, 16
_TOKENIZERS: dict[str, object] = {}


def _count(path: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("encoding")
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(2).to_pylist()
                if path.endswith(".model"):
                    n = [len(x) for x in load(path).encode(texts, num_threads=1)]
                else:
                    n = [sum(values) for values, _ in counts(path).of(texts)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return run


CUT = pa.schema([("key", pa.binary()), ("no", pa.int32()), ("last", pa.bool_()), ("start", pa.int64()), ("stop", pa.int64()), ("low", pa.int64()), ("piece", pa.string())])
CUT_DDL = "key binary, no int, last boolean, start long, stop long, low long, piece string"


def _cut(chunk: int, overlap: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                key, text = key.as_py(), text.as_py()
                for no, start in enumerate(range(0, len(text), chunk)):
                    stop = min(len(text), start + chunk)
                    low = max(0, start - overlap)
                    row = [key, no, stop == len(text), start, stop, low, text[low : stop + overlap]]
                    yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, CUT, strict=True)], schema=CUT)

    return run


_PLACE = pa.list_(pa.struct([("p", pa.int64()), ("k", pa.int64())]))
ENDS = pa.schema([("key", pa.binary()), ("no", pa.int32()), ("last", pa.bool_()), ("n", pa.int64()), ("left", _PLACE), ("right", _PLACE)])
ENDS_DDL = "key binary, no int, last boolean, n long, left array<struct<p:long,k:long>>, right array<struct<p:long,k:long>>"


def _encode(path: str, overlap: int):
    """For each chunk the stable places in its overlaps that are token boundaries, with the tokens before them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _TOKENIZERS:
            _TOKENIZERS[path] = load(path)
        tokenizer = _TOKENIZERS[path]
        for batch in batches:
            for row in batch.to_pylist():
                piece, low = row["piece"], row["low"]
                found = tokenizer.encode(piece, add_special_tokens=False)
                first: dict[int, int] = {}
                for k, (begin, _) in enumerate(found.offsets):
                    first.setdefault(begin, k)
                left, right = [], []
                for a, b, out in ((row["start"] - overlap, row["start"] + overlap, left), (row["stop"] - overlap, row["stop"] + overlap, right)):
                    a, b = max(1, a - low), min(len(piece) - 1, b - low)
                    out += [{"p": m.start() + low, "k": first[m.start()]} for m in STABLE.finditer(piece, a, b) if m.start() in first]
                out = [row["key"], row["no"], row["last"], len(found), left, right]
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(out, ENDS, strict=True)], schema=ENDS)

    return run


def spliced(texts: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """texts: key binary, text. Returns key, n_tokens for each different key."""
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    done = None
    while True:
        cut = texts.mapInArrow(_cut(chunk, overlap), CUT_DDL).repartition(parts, "key", "no").dropDuplicates(["key", "no"])
        ends = staged(cut.mapInArrow(_encode(path, overlap), ENDS_DDL), "token-ends")
        by_key = Window.partitionBy("key").orderBy("no")
        places = lambda c: F.transform(c, lambda x: x["p"])
        pairs = ends.withColumn("common", F.array_intersect(places(F.col("right")), places(F.lead("left").over(by_key))))
        pairs = pairs.withColumn("at", F.try_element_at("common", F.lit(1))).withColumn("before", F.lag("at").over(by_key))
        tokens_before = lambda c, at: F.try_element_at(F.filter(c, lambda x: x["p"] == at), F.lit(1))["k"]
        stop = F.when(F.col("last"), F.col("n")).otherwise(tokens_before(F.col("right"), F.col("at")))
        begin = F.when(F.col("no") == 0, 0).otherwise(tokens_before(F.col("left"), F.col("before")))
        sums = pairs.groupBy("key").agg(F.sum(stop - begin).alias("n_tokens"), F.bool_or(stop.isNull() | begin.isNull() | (stop < begin)).alias("failed"))
        sums = staged(sums, "token-sums")
        good = sums.filter("not failed").select("key", "n_tokens")
        done = good if done is None else done.union(good)
        failed = sums.filter("failed").select("key")
        if failed.isEmpty():
            return done
        overlap *= WIDER
        chunk = max(chunk, 8 * overlap)
        texts = texts.join(hinted(failed), "key", "left_semi")


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens, over_limit.

    Null texts count as empty: no bytes, no tokens. Copies of a huge text are encoded once. An empty
    table gives none; other columns are not read. For a sentencepiece model, whose cuts are not
    proven stable, every text is encoded as a whole.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long"
    huge = F.length("text") > (chunk if not path.endswith(".model") else 1 << 40)
    plain = rows.filter(~huge).mapInArrow(_count(path), schema)
    keyed = rows.filter(huge).withColumn("key", F.unhex(F.sha2("text", 256)))
    found = spliced(keyed.select("key", "text"), path, chunk, overlap)
    long = keyed.select("doc_id", "n_bytes", "key").join(hinted(found), "key").select("doc_id", "n_bytes", "n_tokens")
    return plain.union(long).withColumn("over_limit", F.col("n_tokens") > limit)
