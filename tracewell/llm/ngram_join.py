"""All pairs of texts whose word n-gram sets have a Jaccard similarity over a threshold, by MinHash banding.

Copies of a text count as one text with a number of copies, so a group of copies costs one row. Texts
that share a band hash are candidates; a pair is looked at in the first band it shares and verified there
on the full n-gram sets. Buckets of up to ``SMALL`` texts are joined with themselves on the narrow rows
to see who needs to be there at all; larger ones are dealt out in blocks, every two blocks a group, so
no task gets a whole bucket. A group tells of each text how many it is linked to and one link towards
the group's other texts, not all pairs; classes are the connected components of those links.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hinted, staged
from .shingles import MinHash, bands_for, digest, grams
from .worker import turn

SMALL, BLOCK, HUB = 64, 256, 200

SIG = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("key", pa.binary()), ("empty", pa.bool_()), ("bands", pa.list_(pa.int64()))])
SIG_DDL = "doc_id long, th long, key binary, empty boolean, bands array<long>"


def _signatures(n: int, bands: int, rows: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("shingles")
        hashes = MinHash(bands, rows)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                words = [(t or b"").split() for t in part.column(2).to_pylist()]
                found = [grams(w, n) for w in words]
                some = [i for i, g in enumerate(found) if len(g)]
                sigs: list = [None] * len(found)
                for i, s in zip(some, hashes.of([found[i] for i in some]).view(np.int64), strict=True):
                    sigs[i] = s
                cols = [part.column(0), part.column(1), pa.array([digest(w) for w in words], pa.binary()), pa.array([not len(g) for g in found]), pa.array(sigs, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, schema=SIG)

    return run


def _grams(n: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("shingles")
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                words = [(t or b"").split() for t in batch.column(0).slice(at, 256).to_pylist()]
                sets = [np.unique(grams(w, n)).view(np.int64) for w in words]
                yield pa.RecordBatch.from_arrays([pa.array([digest(w) for w in words], pa.binary()), pa.array(sets, pa.list_(pa.int64()))], names=["key", "grams"])

    return run


def overlaps(a: list[np.ndarray], b: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of every set of a with every set of b; sets are sorted arrays of different values."""
    sizes = [len(x) for x in a + b]
    flat, inverse, seen = np.unique(np.concatenate(a + b), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    shared = seen > 1
    number = np.cumsum(shared) - 1
    use = shared[inverse]
    owner, column = owner[use], number[inverse[use]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(a), len(b)), np.float64)
    total = int(shared.sum())
    for low in range(0, total, columns):
        i, j = np.searchsorted(column, [low, low + columns])
        x = np.zeros((len(sizes), columns), np.float32)
        x[owner[i:j], column[i:j] - low] = 1
        out += x[: len(a)] @ x[len(a) :].T
    return out


def components(linked: np.ndarray) -> np.ndarray:
    """The smallest member of each member's connected component, from a symmetric matrix of links."""
    label = np.arange(len(linked))
    while True:
        least = np.where(linked, label[None, :], len(linked)).min(axis=1)
        new = np.minimum(label, least)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


LINKS = pa.schema([("key", pa.binary()), ("root", pa.binary()), ("texts", pa.int64()), ("docs", pa.int64())])
LINKS_DDL = "key binary, root binary, texts long, docs long"


def _verify(threshold: float):
    """Rows come sorted by group; a group's rows have side 0, 1 or, if its pairs are all within, 0 only."""

    def group(rows: list[dict]) -> pa.RecordBatch | None:
        rows = list({(r["side"], r["key"]): r for r in rows}.values())
        left = [r for r in rows if r["side"] == 0]
        right = [r for r in rows if r["side"] == 1]
        within, k = not rows[0]["cross"], rows[0]["band"]
        right = left if within else right
        if not left or not right:
            return None
        a, b = (np.array([r["bands"] for r in side], np.int64) for side in (left, right))
        fresh = a[:, None, k] == b[None, :, k]
        for j in range(k):
            fresh &= a[:, None, j] != b[None, :, j]
        if within:
            fresh &= ~np.eye(len(left), dtype=bool)
        if not fresh.any():
            return None
        i, j = np.nonzero(fresh.any(axis=1))[0], np.nonzero(fresh.any(axis=0))[0]
        left, right, fresh = [left[x] for x in i], [right[x] for x in j], fresh[np.ix_(i, j)]
        sets = [[np.asarray(r["grams"], np.int64) for r in side] for side in (left, right)]
        both = overlaps(*sets)
        size = [np.array([len(x) for x in s], np.float64) for s in sets]
        linked = fresh & (both >= threshold * (size[0][:, None] + size[1][None, :] - both) - 1e-9)
        copies = [np.array([r["copies"] for r in side], np.int64) for side in (left, right)]
        keys = [r["key"] for r in left] + ([] if within else [r["key"] for r in right])
        if within:
            matrix, texts, docs = linked, linked.sum(axis=1), linked @ copies[0]
        else:
            n = len(left)
            matrix = np.zeros((len(keys), len(keys)), bool)
            matrix[:n, n:], matrix[n:, :n] = linked, linked.T
            texts, docs = np.r_[linked.sum(axis=1), linked.sum(axis=0)], np.r_[linked @ copies[1], linked.T @ copies[0]]
        root = components(matrix)
        some = np.nonzero(texts)[0]
        return pa.RecordBatch.from_arrays([pa.array([keys[x] for x in some], pa.binary()), pa.array([keys[root[x]] for x in some], pa.binary()), pa.array(texts[some], pa.int64()), pa.array(docs[some], pa.int64())], schema=LINKS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("shingles")
        at, held = None, []
        for batch in batches:
            names = [n for n in batch.schema.names if n != "grams"]
            arrays = batch.column(batch.schema.get_field_index("grams"))
            values, stops = arrays.values.to_numpy(zero_copy_only=False), arrays.offsets.to_numpy()
            for n, row in enumerate(batch.select(names).to_pylist()):
                if row["group"] != at:
                    if held and (out := group(held)) is not None:
                        yield out
                    at, held = row["group"], []
                held.append(row | {"grams": values[stops[n] : stops[n + 1]].copy()})
        if held and (out := group(held)) is not None:
            yield out

    return run


def connected(edges: DataFrame, a: str = "key", b: str = "root") -> DataFrame:
    """node, label: the smallest node of its component. Smallest labels spread over edges and are shortened each round.

    The edges of a node with very many are dealt out by salts, and its label goes to each.
    """
    both = staged(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).union(edges.select(F.col(b), F.col(a))).filter("u <> v").distinct(), "cc-pairs")
    hubs = both.groupBy("v").agg(F.ceil(F.count("*") / HUB).cast("int").alias("salts")).filter("salts > 1").withColumnRenamed("v", "hub")
    hubs = hinted(hubs)
    salts = F.coalesce("salts", F.lit(1))
    both = staged(both.join(hubs, F.col("v") == F.col("hub"), "left").select("u", "v", F.pmod(F.xxhash64("u"), salts).cast("int").alias("salt")), "cc-edges")
    dealt = lambda labels, node: labels.join(hubs, F.col(node) == F.col("hub"), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("hub", "salts")
    labels = staged(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")).withColumnRenamed("u", "node"), "cc-labels")
    while True:
        near = both.join(dealt(labels, "node"), (F.col("v") == F.col("node")) & (F.col("salt") == F.col("_salt"))).groupBy("u").agg(F.min("label").alias("near"))
        new = labels.join(near, F.col("node") == F.col("u"), "left").select("node", "label", F.least("label", "near").alias("to"))
        new = staged(new, "cc-spread")
        jump = new.select(F.col("node").alias("_n"), F.col("to").alias("_to"))
        jump = dealt(jump, "_n")
        to_salt = new.join(hubs, F.col("to") == F.col("hub"), "left").withColumn("_own", F.pmod(F.xxhash64("node"), salts).cast("int"))
        nxt = staged(to_salt.join(jump, (F.col("to") == F.col("_n")) & (F.col("_own") == F.col("_salt")), "left").select("node", F.col("label").alias("was"), F.least("to", "_to").alias("label")), "cc-labels")
        labels = nxt.select("node", "label")
        if nxt.filter("was <> label").isEmpty():
            return labels


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, recall: float = 0.9995, n: int = 5) -> DataFrame:
    """One row per row of docs: doc_id, class_id, n_links, n_text_links, copies.

    Words are runs of characters other than ASCII white space. A text of fewer words than n has one
    n-gram, all its words; null, empty and blank texts have none, no links and a class of their own.
    class_id is the smallest identifier among the rows linked directly or through others; n_links counts
    the other rows linked directly, copies included, n_text_links the different texts among them. Each
    pair at the threshold is found with the given recall, more similar ones with more. An empty table
    gives no rows; other columns are not read.
    """
    sig, classes = _classed(docs, id_col, text_col, threshold, recall, n)
    out = sig.select("doc_id", "key", "empty").join(classes, "key", "left")
    none = lambda c, v: F.when(F.col("empty"), v).otherwise(F.col(c)).alias(c)
    return out.select("doc_id", none("class_id", F.col("doc_id")), none("n_links", F.lit(0)), none("n_text_links", F.lit(0)), none("copies", F.lit(1)))


def _classed(docs: DataFrame, id_col: str, text_col: str, threshold: float, recall: float, n: int) -> tuple[DataFrame, DataFrame]:
    """Every row's text, and every text's class with ``lead``: the row (identifier, hash of the text) that comes first in it."""
    bands, rows = bands_for(threshold, recall)
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).cast("binary").alias("t"))
    sig = staged(ids.mapInArrow(_signatures(n, bands, rows), SIG_DDL), "ngram-sig")
    reps = sig.filter("not empty").groupBy("key").agg(F.min("doc_id").alias("first_id"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("lead"), F.count("*").alias("copies"), F.any_value("bands").alias("bands"))
    reps = staged(reps, "ngram-reps")
    spots = reps.select("key", F.posexplode("bands").alias("band", "hash"))
    full = spots.groupBy("band", "hash").agg(F.count("*").alias("m")).filter("m > 1")
    found = spots.join(full, ["band", "hash"]).join(reps.select("key", "copies", "bands"), "key")
    found = staged(found, "ngram-buckets")

    small = found.filter(F.col("m") <= SMALL)
    other = small.select(F.col("hash").alias("hash"), F.col("band").alias("band"), F.col("key").alias("key2"), F.col("bands").alias("bands2"))
    earlier = F.exists(F.zip_with(F.slice("bands", F.lit(1), F.col("band")), F.slice("bands2", F.lit(1), F.col("band")), lambda x, y: x == y), lambda same: same)
    pairs = small.join(other, ["hash", "band"]).filter((F.col("key") < F.col("key2")) & ~earlier)
    needed = pairs.select("hash", "band", F.explode(F.array("key", "key2")).alias("key")).distinct()
    needed = needed.join(reps, "key").select(F.concat_ws(":", "band", "hash").alias("group"), F.lit(False).alias("cross"), F.lit(0).alias("side"), "band", "key", "copies", "bands")

    large = found.filter(F.col("m") > SMALL).withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    large = large.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("own", "with"), F.greatest("own", "with")
    dealt = large.select(F.concat_ws(":", "band", "hash", low, high).alias("group"), (low != high).alias("cross"), (F.col("own") > F.col("with")).cast("int").alias("side"), "band", "key", "copies", "bands")
    members = staged(needed.unionByName(dealt), "ngram-members")

    wanted = members.select("key").distinct().join(reps.select("key", "first_id"), "key").select(F.col("first_id").alias("_w"))
    sets = ids.join(hinted(staged(wanted, "ngram-wanted")), F.col("doc_id").eqNullSafe(F.col("_w")), "left_semi").select("t").mapInArrow(_grams(n), "key binary, grams array<long>")
    grouped = members.join(sets, "key").select("group", "cross", "side", "band", "key", "copies", "bands", "grams").repartition(parts, "group").sortWithinPartitions("group")
    links = staged(grouped.mapInArrow(_verify(threshold), LINKS_DDL), "ngram-links")

    counts = links.groupBy("key").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    labels = connected(links)
    classes = reps.select("key", "first_id", "lead", "copies").join(labels, F.col("key") == F.col("node"), "left").join(counts, "key", "left")
    least = classes.filter("label is not null").groupBy("label").agg(F.min("first_id").alias("class_first"), F.min("lead").alias("class_lead"))
    classes = classes.join(least, "label", "left").select("key", F.coalesce("class_first", "first_id").alias("class_id"), F.coalesce("texts", F.lit(0)).alias("n_text_links"), (F.coalesce("docs", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "copies", F.coalesce("class_lead", "lead").alias("lead"))
    return sig, staged(classes, "ngram-classes")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, recall: float = 0.9995, n: int = 5) -> DataFrame:
    """docs with one row of each class, the one with the smallest identifier, then by a hash of its text; columns as they were.

    Rows without words are a class each and all stay. Rows alike in identifier and text are one row.
    """
    sig, classes = _classed(docs, id_col, text_col, threshold, recall, n)
    leads = classes.select(F.col("lead.doc_id").alias("_lead_id"), F.col("lead.th").alias("_lead_th"))
    leads = staged(leads.union(sig.filter("empty").select("doc_id", "th")).distinct(), "ngram-kept")
    again = sig.filter("not empty").groupBy("doc_id", "th").agg(F.count("*").alias("_n")).filter("_n > 1").select(F.col("doc_id").alias("_lead_id"), F.col("th").alias("_lead_th"))
    again = staged(again, "ngram-repeated")
    is_one = F.col(id_col).cast("long").eqNullSafe(F.col("_lead_id")) & (F.xxhash64(text_col) == F.col("_lead_th"))
    if again.isEmpty():
        return docs.join(hinted(leads), is_one, "left_semi")
    once = docs.join(hinted(staged(leads.exceptAll(again), "ngram-once")), is_one, "left_semi")
    repeated = docs.join(hinted(staged(leads.intersect(again), "ngram-repeated")), is_one, "left_semi")
    text_hash = F.xxhash64(text_col)
    first = repeated.withColumn("_one_th", text_hash).dropDuplicates([id_col, "_one_th"]).drop("_one_th")
    return once.unionByName(first)
