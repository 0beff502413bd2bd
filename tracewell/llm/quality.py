"""Quality of documents: a text classifier's evidence combined with what is known of host and path.

The evidence of every document is gathered by path and by host. Both levels have an empirical Bayes
prior: a host's mean is drawn to the global mean, a path's to its host's, the more so the fewer
documents it has and the less the means differ beyond what chance explains. The posterior odds of the
path, from its other documents alone, and the odds of the document's own evidence are then combined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chargrams import fit, scored
from .common import fold, hinted, staged

FOLDS, HELD_OUT, THRESHOLD, MOST = 3, 1, 0.5, 6000
ORDERS = (2, 3, 4)


def url_host(url: Column) -> Column:
    """A URL's host in small letters; what is no URL has the empty one."""
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))), F.lit(""))


def url_path(url: Column) -> Column:
    """The first part of a URL's path."""
    return F.coalesce(F.regexp_extract(F.try_parse_url(url, F.lit("PATH")), "^/([^/]*)", 1), F.lit(""))


def _strength(groups: DataFrame, centre: Column) -> float:
    """How many documents a group's prior is worth: the variance within groups over that between them.

    groups: n, s (sum), q (sum of squares). By moments; only sums come to the driver.
    """
    mean = F.col("s") / F.col("n")
    r = groups.agg(F.sum(F.col("q") - F.col("n") * mean * mean).alias("within"), F.sum(F.col("n") - 1).alias("free"), F.sum(F.col("n") * (mean - centre) ** 2).alias("between"), F.count("*").alias("k"), F.sum("n").alias("all"), F.sum(F.col("n") * F.col("n")).alias("squares")).first()
    if not r["k"] or not r["free"]:
        return 1.0
    within = max((r["within"] or 0.0) / r["free"], 1e-9)
    spread = r["all"] - r["squares"] / r["all"]
    between = max(((r["between"] or 0.0) - (r["k"] - 1) * within) / spread, 0.0) if spread > 0 else 0.0
    return min(within / max(between, 1e-12), 1e6)


def shrunk(evidence: DataFrame) -> DataFrame:
    """evidence: host, path, evidence. Returns for each path host, path, n, prior and posteriors of host and path, and what
    these are made of: s (the path's sum), host_n, host_s, k_host, k_path (what the priors are worth)."""
    e = F.col("evidence")
    paths = staged(evidence.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(e).alias("s"), F.sum(e * e).alias("q")), "quality-paths")
    hosts = staged(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")), "quality-hosts")
    total = hosts.agg(F.sum("s"), F.sum("n")).first()
    prior = float((total[0] or 0.0) / total[1]) if total[1] else 0.5
    k = _strength(hosts, F.lit(prior))
    hosts = hosts.select("host", F.col("n").alias("host_n"), F.col("s").alias("host_s"), ((F.col("s") + k * prior) / (F.col("n") + k)).alias("host_posterior"))
    paths = staged(paths.join(hinted(hosts), "host"), "quality-posteriors")
    k_path = _strength(paths, F.col("host_posterior"))
    own = ((F.col("s") + k_path * F.col("host_posterior")) / (F.col("n") + k_path)).alias("path_posterior")
    return paths.select("host", "path", "n", "s", "host_n", "host_s", F.lit(prior).alias("prior"), F.lit(k).alias("k_host"), F.lit(k_path).alias("k_path"), "host_posterior", own)


def quality(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD, most: int = MOST) -> DataFrame:
    """One row per row of docs: doc_id, evidence, host_posterior, path_posterior, n_path, score, keep, held_out.

    Null texts count as empty, null hosts and paths as a host and path of their own. Labels other than 0
    and 1 are not used, nor those of the held-out fold; at most ``most`` of either label are. Without
    labels of both kinds the evidence is the share of good labels. Repeated rows count as often as they
    occur. The posteriors given are those of the path and host as a whole; the score takes the document's own
    evidence out of both, so a document alone on its path has the prior that its host's others give. An empty table gives no rows; other columns are not read.
    """
    named = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-"))
    rows = docs.select(F.col(id_col).alias("doc_id"), named(host).alias("host"), named(path).alias("path"), F.col(text_col).alias("text"))
    model = fit(rows, labels.withColumnRenamed(id_col, "doc_id"), label_col, fold(F.col("doc_id"), FOLDS) != HELD_OUT, most=most, orders=ORDERS)
    evidence = staged(scored(rows, model, ["doc_id", "host", "path"], name="evidence"), "quality-evidence")
    odds = lambda c: F.log(F.greatest(c, F.lit(1e-9)) / F.greatest(1 - c, F.lit(1e-9)))
    out = evidence.join(hinted(shrunk(evidence)), ["host", "path"])
    e = F.col("evidence")
    of_host = (F.col("host_s") - e + F.col("k_host") * F.col("prior")) / (F.col("host_n") - 1 + F.col("k_host"))
    others = (F.col("s") - e + F.col("k_path") * of_host) / (F.col("n") - 1 + F.col("k_path"))
    score = 1 / (1 + F.exp(-(odds(e) + odds(others) - odds(F.col("prior")))))
    out = out.withColumn("score", score)
    return out.select("doc_id", "evidence", "host_posterior", "path_posterior", F.col("n").alias("n_path"), "score", (F.col("score") >= threshold).alias("keep"), (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"))
