"""Toxicity of whole texts: a character n-gram linear classifier scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chargrams import Model, fit, scored
from .common import fold

FOLDS, HELD_OUT, THRESHOLD, MOST = 3, 1, 0.7, 6000


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = MOST) -> Model:
    """Learns from at most ``most`` rows of each label, none of them of the held-out fold."""
    return fit(docs, labels, label_col, fold(F.col(id_col), FOLDS) != HELD_OUT, id_col, text_col, most)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = THRESHOLD, most: int = MOST) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Null texts count as empty; an empty text's score is that of a text without known n-grams. Labels
    other than 0 and 1 and labels of unknown rows are not used. Without labels of both kinds the score
    is the share of toxic labels. An empty table gives no rows; other columns are not read.
    """
    model = train(docs, labels, id_col, text_col, label_col, most)
    out = scored(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model, ["doc_id"])
    return out.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows predicted toxic; their columns as they were."""
    model = train(docs, labels, id_col, text_col, label_col)
    copy = docs.withColumn("_scored", F.col(text_col))
    return scored(copy, model, docs.columns, "_scored", "_toxicity").filter(F.col("_toxicity") < threshold).drop("_toxicity")
