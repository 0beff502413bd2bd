"""run() over small tables with planted toxic rows, copies and near copies; every stage against brute force on its own input."""

import collections
import random
import re

import numpy as np
import pytest

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
BLANK = re.compile(r"[\x20\x09-\x0D]")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    vocabulary = [f"word{i}" for i in range(300)]
    text = lambda k: " ".join(rng.choices(vocabulary, k=k))
    rows, labels = [], []
    for i in range(240):
        bad = i % 6 == 5
        body = text(rng.randrange(20, 60))
        if bad:
            body += " nastyword vileword nastyword awfulword"
        rows.append((i, body, "en", f"s{i % 4}"))
        labels.append((i, 1, int(bad)))
    rows += [(300 + i, rows[i][1].replace(" ", "\n", 2) if i % 2 else rows[i][1], "en", "s0") for i in range(5)]  # copies
    rows += [(400 + i, rows[10][1] + f" tail{i}", "en", "s1") for i in range(4)]  # near copies
    rows += [(500, rows[12][1], "en", "s2")] * 3  # a row three times
    rows += [(600, None, "en", None), (601, "", None, "s1"), (None, text(30), "en", "s3"), (602, text(3000), "en", "s2")]
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [(*r, len(r[1] or "")) for r in rows]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3, "n_chars").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_run(spark, folder, monkeypatch):
    import corpus_pipeline as pipeline

    between = []
    real = pipeline.staged
    monkeypatch.setattr(pipeline, "staged", lambda df, name: between.append(real(df, name)) or between[-1])
    pieces = pipeline.run(spark, folder).select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset").collect()
    tables = [[tuple(r) for r in t.collect()] for t in [spark.read.parquet(f"{folder}/documents.parquet"), *between]]
    start, clean, single, apart, mixed = tables
    assert all(t.columns == ["doc_id", "text", "lang", "source", "n_chars"] for t in between)

    # toxicity: all rows with the planted words go, all others stay as they were
    assert sorted(clean, key=str) == sorted((r for r in start if "nastyword" not in (r[1] or "")), key=str)

    # exact dedup: the longest original, then the smallest identifier of each group
    groups = collections.defaultdict(list)
    for r in clean:
        groups[BLANK.sub("", r[1] or "")].append(r)
    best = [min(g, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0)) for g in groups.values()]
    assert sorted((str(r[0]), BLANK.sub("", r[1] or "")) for r in single) == sorted((str(r[0]), BLANK.sub("", r[1] or "")) for r in best)

    # n-gram join: one of each connected group, the smallest identifier
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := words(r[1])) else frozenset() for r in single]
    root = list(range(len(single)))
    for i in range(len(single)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root = [root[j] if x == root[i] else x for x in root]
    lead = {}
    for i, r in enumerate(single):
        lead[root[i]] = min(lead.get(root[i], r), r, key=lambda x: (x[0] is None, x[0] or 0))
    assert sorted(apart, key=str) == sorted(lead.values(), key=str)

    # mixing: whole rows, at most twice, each source within one document of its target
    size = collections.Counter()
    for r in apart:
        size[r[3]] += len(words(r[1]))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight, full = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, set()
    while True:
        rest, free = 1.5 * sum(size.values()) - sum(2 * size[s] for s in full), [s for s in order if s not in full]
        target = {s: 2.0 * size[s] if s in full else rest * weight[s] / sum(weight[f] for f in free) for s in order}
        over = {s for s in free if target[s] >= 2 * size[s]}
        if not over:
            break
        full |= over
    times, taken = collections.Counter(mixed), collections.Counter()
    assert set(times) <= set(apart) and max(times.values()) <= 2
    for r in mixed:
        taken[r[3]] += len(words(r[1]))
    assert all(abs(taken[s] - target[s]) <= max(len(words(r[1])) for r in apart if r[3] == s) for s in order)

    # packing: every taken row's ids once, in full sequences without padding
    own = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    lengths = collections.Counter()
    for r in mixed:
        lengths[r[0]] += len(own.encode(r[1] or "", add_special_tokens=False).ids) + 1
    got, sequences = collections.Counter(), collections.defaultdict(list)
    for p in pieces:
        got[p["doc_id"]] += p["length"]
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    assert got == lengths
    for s in sequences.values():
        s.sort()
        assert [o for o, _ in s] == np.cumsum([0, *[n for _, n in s]])[:-1].tolist()
        n = sum(n for _, n in s)
        assert n == 2048 or (n < 2048 and n & (n - 1) == 0)


def test_stages_of_empty_tables(spark, folder):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == 0
        if name != "packing":
            assert out.columns == docs.columns


def test_registered():
    from __spark_entry__ import queries

    names = [n.split("_")[0] for n in queries() if n.startswith("op")]
    assert sorted(names) == sorted(f"op{n}" for n in range(1, 14)) and "pipeline" in queries()
