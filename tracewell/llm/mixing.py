"""Mixing sources to target weights by nested hash thresholds.

Every row gets a 63-bit hash of its identifier and text. Sizes are summed by source and hash
bucket; the bucket in which a source's budget ends is refined with the next bits of the hash,
again and again, until it holds one row. What remains is a threshold per source, so the mix is a
filter on the hash: no sort of the rows, the same rows on every run, and a smaller budget takes
a subset of what a larger one takes. Rows alike in identifier and text, which share their hash, are told apart
where a budget ends among them, by thresholds on a number that they get for that.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hinted, ranked, staged, word_count

#: The hash is read in these steps: so many low bits remain below each level's buckets.
SHIFTS = (51, 39, 27, 15, 3, 0)
LAST = 2**63 - 1


def source_key(source: Column) -> Column:
    """A text that is never null and differs for each source, the null source included."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def row_hash(doc_id: Column, text: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(doc_id, text), 1)


def shares(sources: DataFrame, weights: Sequence[float], budget: float, most: float) -> DataFrame:
    """Adds weight and target to sources (skey, source, source_size).

    Sources in code-point order, null last, take the weights in turn. The budget is a multiple of
    all sizes; no target exceeds ``most`` times its source's size, and what a source cannot take
    is reshared among the others by weight. Only sums come to the driver.
    """
    order = [F.col("source").isNull(), F.col("source")]
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    out = staged(ranked(sources, order).withColumn("weight", weight).drop("rank"), "mix-sources")
    cap = F.col("source_size") * most
    total = out.agg(F.sum("source_size")).first()[0] or 0
    level, before = 0.0, -1.0
    full = F.lit(False)
    while level != before:
        before = level
        taken, free = out.agg(F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight")))).first()
        if not free:
            level = float("inf")
            break
        level = (total * budget - (taken or 0)) / free
        full = cap <= F.col("weight") * level
    target = F.when(full, cap.cast("double")).otherwise(F.col("weight") * (0.0 if level == float("inf") else level))
    return out.withColumn("target", target)


def cutoffs(rows: DataFrame, asked: DataFrame, hist: DataFrame) -> DataFrame:
    """rows: skey, size, h. asked: skey, rest (how much is wanted). hist: rows by skey and first bucket b (w, n). Returns for each
    skey last (rows with a hash up to it are taken), and, where rows of one hash remain, that hash, how many of them are
    taken and of how many (edge, take, of); no row where all are wanted."""
    bucket = lambda level: F.shiftright("h", SHIFTS[level])
    running = Window.partitionBy("skey").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    edge = done = None
    none = F.lit(None).cast("long")
    for level, shift in enumerate(SHIFTS):
        if level:
            near = edge.filter("n > 1").select("skey", F.col("b").alias("up"), "rest")
            rows = rows.join(hinted(near.select("skey", "up")), "skey").filter(F.shiftright("h", SHIFTS[level - 1]) == F.col("up")).select("skey", "size", "h")
            rows = staged(rows, "mix-edge")
            asked = near.select("skey", "rest")
            hist = rows.groupBy("skey", bucket(level).alias("b")).agg(F.sum("size").alias("w"), F.count("*").alias("n"))
        cum = hist.select("skey", "b", "w", "n", F.sum("w").over(running).alias("cum")).join(asked, "skey").filter("cum >= rest")
        found = cum.groupBy("skey").agg(F.min(F.struct("b", "w", "n", "cum", "rest")).alias("x")).select("skey", "x.*")
        edge = staged(found.select("skey", "b", "w", "n", (F.col("rest") - F.col("cum") + F.col("w")).alias("rest")), "mix-found")
        # one row: whichever side of the budget is nearer
        start, size = F.col("b") * F.lit(1 << shift), 1 << shift
        last = start + F.when(F.col("rest") * 2 >= F.col("w"), size - 1).otherwise(-1)
        ended = edge.filter("n = 1").select("skey", last.alias("last"), none.alias("edge"), none.alias("take"), none.alias("of"))
        if not shift:  # rows of one hash: as many as come nearest
            take = F.when(F.col("w") > 0, F.round(F.col("rest") * F.col("n") / F.col("w"))).otherwise(0).cast("long")
            ended = ended.unionByName(edge.filter("n > 1").select("skey", (F.col("b") - 1).alias("last"), F.col("b").alias("edge"), take.alias("take"), F.col("n").alias("of")))
        done = ended if done is None else done.union(ended)
        if shift and edge.filter("n > 1").isEmpty():
            break
    return done


def histogram(rows: DataFrame, *more: str) -> DataFrame:
    return staged(rows.groupBy("skey", *more, F.shiftright("h", SHIFTS[0]).alias("b")).agg(F.sum("size").alias("w"), F.count("*").alias("n")), "mix-hist")


def thresholds(rows: DataFrame, weights: Sequence[float] = (5, 2, 1), budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """rows: skey, source, size, h. Returns for each source source_size, target, base (times every row is taken),
    last (rows with a hash up to it are taken once more), and edge, take, of (of the rows of that hash so many are taken once more)."""
    hist = histogram(rows, "source")
    sources = shares(hist.groupBy("skey", "source").agg(F.sum("w").alias("source_size")), weights, budget, most)
    base = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(int(most) - 1))).otherwise(0)
    sources = sources.withColumn("base", base.cast("long")).withColumn("rest", F.col("target") - F.col("base") * F.col("source_size"))
    sources = staged(sources, "mix-targets")
    done = cutoffs(rows, sources.select("skey", "rest"), hist)
    return sources.join(done, "skey", "left").select("skey", "source_size", "target", "base", F.coalesce("last", F.lit(LAST)).alias("last"), "edge", "take", "of")


def taken(rows: DataFrame, plan: DataFrame, h: str = "h") -> DataFrame:
    """Adds _copies to rows (_skey and a hash). Where a budget ends among rows of one hash, these get numbers and a threshold on a hash of those."""
    plan = plan.select(F.col("skey").alias("_skey"), F.col("base").alias("_base"), F.col("last").alias("_last"), F.col("edge").alias("_edge"), F.col("take").alias("_take"))
    plain = rows.join(hinted(plan), "_skey").withColumn("_copies", (F.col("_base") + (F.col(h) <= F.col("_last")).cast("long")).cast("int"))
    on_edge = F.coalesce(F.col(h) == F.col("_edge"), F.lit(False))
    if plan.filter("_take > 0").isEmpty():
        return plain.drop("_base", "_last", "_edge", "_take")
    alike = staged(plain.filter(on_edge).withColumn("_h2", F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 1)), "mix-alike")
    ones = alike.select(F.col("_skey").alias("skey"), F.lit(1).cast("long").alias("size"), F.col("_h2").alias("h"))
    last = cutoffs(ones, plan.filter("_take > 0").select(F.col("_skey").alias("skey"), F.col("_take").cast("double").alias("rest")), histogram(ones))
    last = staged(last.select(F.col("skey").alias("_skey"), F.col("last").alias("_last2")), "mix-last")
    # a source that wants none of them has no threshold, one that wants all has none either
    some = F.coalesce((F.col("_h2") <= F.col("_last2")).cast("int"), (F.col("_take") > 0).cast("int"))
    alike = alike.join(hinted(last), "_skey", "left").withColumn("_copies", (F.col("_base") + some).cast("int"))
    return plain.filter(~on_edge).unionByName(alike.select(*plain.columns)).drop("_base", "_last", "_edge", "_take")


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """The narrow table that everything else reads: the texts are scanned once."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), source_key(F.col(source_col)).alias("skey"), word_count(F.col(text_col)).alias("size"), row_hash(F.col(id_col), F.col(text_col)).alias("h"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1), budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, copies, taken.

    Null texts have size 0. Whole rows are taken, so a source is off its target by less than one row; of rows alike in
    identifier and text as many are taken as come nearest. A source of one row takes it whole or not, whichever is
    nearer its target. An empty table gives none; other columns are not read.
    """
    rows = staged(sized(docs, id_col, text_col, source_col), "mix-rows")
    plan = staged(thresholds(rows, weights, budget, most), "mix-plan")
    out = taken(rows.withColumnRenamed("skey", "_skey"), plan).join(hinted(plan.select(F.col("skey").alias("_skey"), "source_size", "target")), "_skey")
    return out.select("doc_id", "source", "size", "source_size", "target", F.col("_copies").cast("long").alias("copies"), (F.col("size") * F.col("_copies")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1), budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """The mix itself: docs with each row as often as it is taken, its columns as they were (names that begin with
    an underscore included, unless they are those used here: _skey, _h, _h2, _base, _last, _last2, _edge, _take, _copies, _copy)."""
    rows = staged(sized(docs, id_col, text_col, source_col), "mix-rows")
    plan = staged(thresholds(rows, weights, budget, most), "mix-plan")
    keyed = docs.withColumn("_skey", source_key(F.col(source_col))).withColumn("_h", row_hash(F.col(id_col), F.col(text_col)))
    out = taken(keyed, plan, "_h").filter("_copies > 0")
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)
