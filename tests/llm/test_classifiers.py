"""Classifiers: held-out accuracy on texts whose label shows in some words, and the edge cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import chargrams, quality, toxicity
from tracewell.llm.chargrams import Model, hashed, regression


@pytest.fixture(scope="module")
def labelled(spark, tmp_path_factory):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        text = [rng.choice(words) for _ in range(rng.randrange(5, 40))]
        if bad:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(["nastyword", "vileword", "awfulword"]))
        rows.append((i, " ".join(text), "en", f"s{i % 3}", "clash"))
        labels.append((i, int(not bad), int(bad)))
    rows += [(1000, None, None, None, "x"), (1001, "", "en", "s0", "x"), (1002, "nastyword vileword " * 3, "fr", "s9", "x"), (1002, "nastyword vileword " * 3, "fr", "s9", "x")]
    labels += [(5000, 1, 1), (None, 1, 0), (1001, None, None)]
    path = str(tmp_path_factory.mktemp("labelled"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score string").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(labelled):
    docs, labels = labelled
    found = toxicity.toxicity(docs, labels).collect()
    assert len(found) == docs.count()
    held = [r for r in found if r["held_out"] and r["doc_id"] < 600]
    assert np.mean([r["predicted"] == (r["doc_id"] % 5 == 0) for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in found)
    assert all(r["predicted"] == 1 for r in found if r["doc_id"] == 1002)
    clean = toxicity.clean(docs, labels)
    assert clean.columns == docs.columns and clean.filter("doc_id = 1002").count() == 0
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_without_labels_the_score_is_their_share(labelled):
    docs, labels = labelled
    assert {round(r["score"], 3) for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.5}


def test_quality(labelled):
    docs, labels = labelled
    found = quality.quality(docs, labels, host=F.col("source"), path=F.col("lang")).collect()
    assert len(found) == docs.count()
    held = [r for r in found if r["held_out"] and r["doc_id"] < 600]
    assert np.mean([r["keep"] == (r["doc_id"] % 5 != 0) for r in held]) > 0.95
    assert quality.quality(docs.limit(0), labels, host=F.col("source"), path=F.col("lang")).count() == 0


def test_score_against_plain_loops(labelled, monkeypatch):
    """All of a document's score but the classifier's evidence, from sums over the other documents."""
    docs, labels = labelled
    parts = []
    real = quality.shrunk
    monkeypatch.setattr(quality, "shrunk", lambda e: parts.append((real(e), e)) or parts[-1][0])
    found = quality.quality(docs, labels, host=F.col("source"), path=F.concat(F.col("source"), (F.col("doc_id") % 50).cast("string"))).collect()
    strengths = parts[0][0].first()
    rows = [(r["host"], r["path"], r["evidence"]) for r in parts[0][1].collect()]
    prior = np.mean([e for _, _, e in rows])
    odds = lambda p: np.log(max(p, 1e-9) / max(1 - p, 1e-9))
    expected = []
    for i, (host, path, e) in enumerate(rows):
        host_others = [x for j, (h, _, x) in enumerate(rows) if h == host and j != i]
        path_others = [x for j, (h, p, x) in enumerate(rows) if h == host and p == path and j != i]
        at_host = (sum(host_others) + strengths["k_host"] * prior) / (len(host_others) + strengths["k_host"])
        at_path = (sum(path_others) + strengths["k_path"] * at_host) / (len(path_others) + strengths["k_path"])
        expected.append(1 / (1 + np.exp(-(odds(e) + odds(at_path) - odds(prior)))))
    assert sorted(r["score"] for r in found) == pytest.approx(sorted(expected), abs=1e-9)


def test_labels_that_clash_and_repeated_identifiers(spark):
    from tracewell.llm import chargrams

    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(2, "two"), (3, "three"), (4, "four")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 0), (2, 1), (3, 0), (3, 1), (None, 1), (4, 7)], "doc_id long, toxic int")
    assert {(r["_id"], r["_label"]) for r in chargrams.sample(labels, "doc_id", "toxic", F.lit(True), 10).collect()} == {(1, 0), (2, 1)}
    assert chargrams.fit(docs, labels, "toxic", F.lit(True), most=1).bias == pytest.approx(chargrams.fit(docs, labels, "toxic", F.lit(True)).bias)


def test_sparse_sites_are_drawn_to_the_prior(spark):
    rows = [("big", "a", 0.9 if i % 10 else 0.7) for i in range(200)] + [("poor", "a", 0.2 + 0.1 * (i % 3)) for i in range(200)] + [("tiny", "a", 0.1)]
    out = {r["host"]: r for r in quality.shrunk(spark.createDataFrame(rows, "host string, path string, evidence double")).collect()}
    prior = out["big"]["prior"]
    assert 0.1 < out["tiny"]["host_posterior"] < prior
    assert abs(out["big"]["host_posterior"] - 0.88) < 0.02


def test_slices_see_every_gram(monkeypatch):
    from tracewell.llm import chargrams

    data = bytes(range(97, 123)) * 4
    whole = sorted(np.concatenate(list(hashed(data))).tolist())
    monkeypatch.setattr(chargrams, "SLICE", 10)
    assert sorted(np.concatenate(list(hashed(data))).tolist()) == whole


def test_regression_separates():
    rows = [np.array([0]), np.array([1]), np.array([0, 2]), np.array([1, 2])] * 5
    w, b = regression(rows, np.array([1, 0, 1, 0] * 5), np.array([2.0, -2.0, 0.1]))
    assert b + w[0] > 0 > b + w[1]
    assert 0 < Model(bias=0.0).scorer()(None) < 1


def test_every_gram_that_stands_out_is_kept(spark):
    """Many words, each in a few toxic texts; texts with one of the rarer ones alone are found as well."""
    from tracewell.llm import chargrams

    rng = random.Random(6)
    plain, bad = [f"p{i:03}" for i in range(300)], ["".join(rng.choices("qxzjkvw", k=9)) for _ in range(150)]
    texts = [" ".join(rng.choices(plain, k=20) + ([bad[(i * 7 + k) % 150] for k in range(60)] if i % 2 else [])) for i in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    model = chargrams.fit(docs, labels, "toxic", F.lit(True))
    seen = np.zeros((2, 1 << chargrams.BITS))
    sets = [np.unique(np.concatenate(list(hashed(chargrams.prepared(t))))) for t in texts]
    for i, s in enumerate(sets):
        seen[i % 2, s] += 1
    ratio = np.log((seen[1] + 1) / 202) - np.log((seen[0] + 1) / 202)
    z = np.abs(ratio) / np.sqrt(1 / (seen[1] + 1) + 1 / (seen[0] + 1))
    out = np.nonzero((z > 2) & (seen.sum(axis=0) > 1))[0]
    ratio *= 1 - 4 / np.maximum(z, 1e-9) ** 2
    assert len(out) > 2000 and set(np.nonzero(z >= 4)[0]) <= set(out) and model.features.tolist() == out.tolist()
    # the sums of the tasks give what all rows at hand give
    w, b = regression([np.searchsorted(out, s[np.isin(s, out)]) for s in sets], np.arange(400) % 2, ratio[out])
    assert model.weights == pytest.approx(w, abs=1e-9) and model.bias == pytest.approx(b, abs=1e-9)
    score = model.scorer()
    assert np.mean([score(w) > score("p001") for w in bad]) == 1


def test_ten_labelled_rows_of_each_kind_give_more_than_one_score(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choices([f"w{k}" for k in range(60)], k=12) + (["vileword"] if i % 2 else [])) for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    model = chargrams.fit(docs, labels, "toxic", F.lit(True))
    score = model.scorer()
    assert len({score(t) for t in texts}) > 1
    assert min(score(t) for t in texts[21::2]) > max(score(t) for t in texts[20::2])


def test_scores_of_toxicity_by_plain_loops(labelled):
    """Each score again from the model's table, n-gram by n-gram, with Python's whole numbers."""
    docs, labels = labelled
    model = toxicity.train(docs, labels)
    weight = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))

    def plain(text):
        data, seen = f" {(text or '').lower()} ".encode(), set()
        for n in model.orders:
            for at in range(len(data) - n + 1):
                h = 0
                for b in data[at : at + n]:
                    h = (h * 0x100000001B3 + b) % 2**64
                seen.add((h ^ (h >> 29)) * 0x9E3779B97F4A7C15 % 2**64 >> (64 - chargrams.BITS))
        return 1 / (1 + math.exp(-(model.bias + sum(weight.get(x, 0.0) for x in seen))))

    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    found = toxicity.toxicity(docs, labels).filter("doc_id % 10 = 1 or doc_id >= 1000").collect()
    assert len(found) > 60
    for r in found:
        assert r["score"] == pytest.approx(plain(texts[r["doc_id"]]), abs=1e-9)
