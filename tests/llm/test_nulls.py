"""Null identifiers, texts and sources, repeated rows and columns named like the operators' own: every operator keeps all rows."""

import collections

import pytest
from pyspark.sql import functions as F

from tracewell.llm import ann, exact_dedup, line_dedup, lm_score, mixing, ngram_join, packing, quality, token_counts, toxicity

pytest.importorskip("tokenizers")
PATH = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
LONG = "one two three four five six seven\neight nine ten eleven\n" * 30
ROWS = [(None, "some text here", None), (None, None, "s"), (3, "some text here", "s"), (None, "some text here", None), (4, LONG, None), (None, LONG, "t"), (5, "", "t"), (6, None, None)]
NAMES = ["clean_text", "n_lines", "removed_lines", "score", "label", "copies", "taken", "h", "skey", "sig", "uid", "ids", "class_id", "links", "keep_id", "n_tokens", "evidence", "part", "rep"]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string").withColumn("lang", F.lit(None).cast("string"))
    return df.withColumns({n: F.lit(7) for n in NAMES}).repartition(3)


def ids(df):
    return collections.Counter(r["doc_id"] for r in df.select("doc_id").collect())


EXPECTED = collections.Counter(r[0] for r in ROWS)
LABELS = [(3, 1, 0), (4, 0, 1), (None, 1, 1), (5, None, None)]


def test_every_row_is_answered(spark, odd):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert ids(mixing.mix(odd)) == EXPECTED
    assert ids(lm_score.lm_score(odd)) == EXPECTED
    assert ids(ngram_join.ngram_join(odd)) == EXPECTED
    assert ids(quality.quality(odd, labels, host=F.col("source"), path=F.col("lang"))) == EXPECTED
    assert ids(token_counts.token_counts(odd, PATH)) == EXPECTED
    assert ids(toxicity.toxicity(odd, labels)) == EXPECTED


def test_equal_texts_without_identifiers(odd):
    found = exact_dedup.exact_dedup(odd)
    assert ids(found) == EXPECTED
    kept = collections.Counter(r["text_sha256"] for r in found.filter("kept").collect())
    assert len(kept) == 3 and set(kept.values()) == {1}
    left = exact_dedup.deduplicated(odd)
    assert left.columns == odd.columns and left.count() == 3
    assert left.filter("text = 'some text here'").first()["doc_id"] == 3


def test_lines_of_texts_without_identifiers(odd):
    found = line_dedup.line_dedup(odd)
    assert ids(found) == EXPECTED and all(r["n_lines"] >= 0 and r["removed_lines"] >= 0 for r in found.collect())


def test_pieces_of_texts_without_identifiers(odd):
    found = packing.pack(odd, PATH).collect()
    assert sum(r["start"] == 0 for r in found) == len(ROWS)
    assert sum(r["length"] for r in found) == sum(r["doc_tokens"] for r in found if r["start"] == 0)
    assert {r["doc_id"] for r in found} == set(EXPECTED)


def test_urls_as_host_and_path(spark):
    """Pages: a good site's documents score above those of a bad one with the same text; odd URLs have a host and path of their own."""
    good, bad = "calm river stone " * 4, "qqq zzz vvv " * 4
    rows = [(i, f"https://{'Good' if i % 2 else 'bad'}.example/{'a' if i % 4 < 2 else 'b'}/{i}", good if i % 2 else bad) for i in range(40)]
    rows += [(100, "https://good.example/a/x", "river zzz"), (101, "http://BAD.example/a/y", "river zzz"), (102, None, "river zzz"), (103, "no url at all", None)]
    docs = spark.createDataFrame(rows, "doc_id long, url string, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    out = quality.quality(docs, labels, host=quality.url_host(F.col("url")), path=quality.url_path(F.col("url")))
    found = {r["doc_id"]: r for r in out.collect()}
    assert len(found) == len(rows) and found[100]["score"] > found[102]["score"] > found[101]["score"]
    assert found[100]["n_path"] == 11 and found[101]["n_path"] == 11 and found[102]["n_path"] == 2
    assert found[100]["evidence"] == pytest.approx(found[101]["evidence"])


def test_nearest_ignores_rows_without_identifiers_and_breaks_ties(spark):
    rows = [(i, [float(i % 5), 1.0]) for i in range(60)] + [(None, [9.0, 9.0]), (100, None), (101, [None, 1.0]), (102, [float("nan"), 1.0]), (103, [0.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"score": F.lit(1), "rank": F.lit(2)})
    found = collections.defaultdict(list)
    for r in ann.nearest(table, F.col("vec_id") % 20 == 0).collect():
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == {0, 20, 40}
    for q, own in found.items():
        expected = sorted((-((q % 5) * (i % 5) + 1.0), i) for i in range(60) if i != q)[:20]
        assert [(v, s) for _, v, s in sorted(own)] == [(i, -s) for s, i in expected]
