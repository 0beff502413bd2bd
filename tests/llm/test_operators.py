"""Each operator against brute force on small documents with nulls, blanks, copies, repeated rows and clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from tracewell.llm import ann, exact_dedup, line_dedup, lm_score, mixing, ngram_join, packing, token_counts
from tracewell.llm.common import fold

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
PATH = public.path("byte_bpe_50k.json")
BLANK = re.compile(r"[\x20\x09-\x0D]")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_fold_is_crc32_of_the_decimal_text(spark):
    found = spark.createDataFrame([(i,) for i in range(50)], "i long").select("i", fold(__import__("pyspark").sql.functions.col("i"), 7).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["i"]).encode()) % 7 for r in found)


def test_mixing(docs, rows, empty):
    found = mixing.mix(docs).collect()
    assert len(found) == len(rows)
    size = collections.Counter()
    for r in rows:
        size[r[3]] += len(words(r[1]))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, full = {}, set()
    while True:
        rest = 1.5 * sum(size.values()) - sum(2 * size[s] for s in full)
        free = [s for s in order if s not in full]
        target = {s: 2.0 * size[s] if s in full else rest * weight[s] / sum(weight[f] for f in free) for s in order}
        over = {s for s in free if target[s] >= 2 * size[s]}
        if not over:
            break
        full |= over
    taken, largest = collections.Counter(), collections.Counter()
    for r in found:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in order)
    again = {(r["doc_id"], r["size"], r["taken"]) for r in mixing.mix(docs.repartition(5)).collect()}
    assert again == {(r["doc_id"], r["size"], r["taken"]) for r in found}
    assert mixing.mix(empty).count() == 0
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in found)


def test_mixing_takes_less_of_less(docs):
    """A smaller budget takes a subset: thresholds are nested."""
    small = {r["doc_id"]: r["taken"] for r in mixing.mix(docs, budget=0.3).collect()}
    assert all(small[r["doc_id"]] <= r["taken"] for r in mixing.mix(docs, budget=0.6).collect())


@pytest.mark.parametrize("other", [None, "x"])
def test_mixing_among_rows_alike(spark, other):
    """Where a budget ends among rows of one identifier and text, as many are taken as come nearest."""
    rows = [(1, "one two three four", "hot", other)] * 1500 + [(k, "w " * (k % 7), f"s{k % 2}", other) for k in range(2, 200)] + [(None, None, None, other)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, h string").repartition(7)
    found = mixing.mix(docs).collect()
    assert len(found) == len(rows) and all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in found)
    for source in ("hot", "s0", "s1"):
        own = [r for r in found if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)
    copies = sorted(r["copies"] for r in found if r["source"] == "hot")
    assert copies[0] != copies[-1]  # some of the equal rows are taken once more, some are not
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and mixed.groupBy("source").count().orderBy("source").collect() == spark.createDataFrame([(s, sum(r["copies"] for r in found if r["source"] == s)) for s in ("hot", "s0", "s1", None)], "source string, count long").filter("count > 0").orderBy("source").collect()


def test_exact_dedup_of_a_text_in_many_partitions(spark, monkeypatch):
    """Texts that many partitions hold are merged in shares, then together; identifiers alone fill a budget as well."""
    monkeypatch.setattr(exact_dedup, "SHARES", 4)
    rows = [(k, "the same\ttext" if k % 3 else f"text {k // 6}", "s") for k in range(600)] + [(k, None, "s") for k in range(1000, 1400)] + [(None, "thesame text", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sha string").repartition(30)
    found = exact_dedup.exact_dedup(docs, budget=8000).collect()
    groups = collections.defaultdict(list)
    for i, text, _ in rows:
        groups[BLANK.sub("", text or "")].append((-len(text or ""), i is None, i or 0, i))
    expected = {i: (min(own)[3], len(own)) for own in groups.values() for *_, i in own}
    assert len(found) == len(rows) and all((r["keep_id"], r["group_size"]) == expected[r["doc_id"]] for r in found)
    assert sorted(r["keep_id"] for r in found if r["kept"]) == sorted(min(own)[3] for own in groups.values())


@pytest.mark.parametrize("budget", [exact_dedup.TRIE_BYTES, 3000])
def test_exact_dedup(docs, rows, empty, budget):
    found = exact_dedup.exact_dedup(docs, budget=budget).collect()
    groups = collections.defaultdict(list)
    for r in rows:
        groups[BLANK.sub("", r[1] or "")].append((-len(r[1] or ""), r[0]))
    assert len(found) == len(rows) and sum(r["kept"] for r in found) == len(groups)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): g for t, g in groups.items()}
    for r in found:
        g = by_sha[r["text_sha256"]]
        assert r["keep_id"] == min(g)[1] and r["group_size"] == len(g)
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert exact_dedup.exact_dedup(empty).count() == 0
    left = exact_dedup.deduplicated(docs)
    assert left.columns == docs.columns and left.count() == len(groups)


def test_trie_spills_and_keeps_everything():
    trie = exact_dedup.Trie(lambda a, b: a + b, budget=2000)
    texts = [f"{c}{i:03}{c * 20}".encode() for c in "abcdef" for i in range(40)] + [b"", b"a"]
    for t in texts * 2:
        trie.add(t, 1)
    assert trie.spills
    assert dict(trie.items()) == {t: 2 for t in texts}


@pytest.mark.parametrize(("small", "block"), [(64, 256), (2, 3)])
def test_ngram_join(docs, rows, empty, monkeypatch, small, block):
    monkeypatch.setattr(ngram_join, "SMALL", small)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    found = ngram_join.ngram_join(docs).collect()
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := words(r[1])) else frozenset() for r in rows]
    links, parent = collections.Counter(), list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                parent[top(i)] = top(j)
    least = {}
    for i, r in enumerate(rows):
        least[top(i)] = min(least.get(top(i), r[0]), r[0])
    expected = sorted((r[0], least[top(i)], links[i]) for i, r in enumerate(rows))
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in found) == expected
    if small == 64:
        assert ngram_join.ngram_join(empty).count() == 0
        left = ngram_join.one_of_each(docs)
        blank = [r for i, r in enumerate(rows) if not sets[i]]
        assert left.columns == docs.columns
        assert sorted(r["doc_id"] for r in left.collect()) == sorted([*(least[top(i)] for i in {top(k) for k in range(len(rows))} if sets[i]), *(r[0] for r in blank)])


def test_one_row_stays_of_rows_with_one_identifier(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a), (1, a), (1, a + " more"), (1, b), (2, b + " x"), (None, a + " y"), (3, None), (3, None), (4, " ")]
    left = ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in left) == [1, 1, 3, 3, 4]
    assert {(r["text"] or " ")[0] for r in left if r["doc_id"] == 1} == {"a", "b"}


def test_components_with_a_hub(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HUB", 3)
    edges = [(f"n{i:02}", "n00") for i in range(1, 30)] + [(f"m{i}", f"m{i + 1}") for i in range(6)] + [("z1", "z0")]
    found = {r["node"]: r["label"] for r in ngram_join.connected(spark.createDataFrame(edges, "key string, root string")).collect()}
    assert found == {x: x[0] + ("00" if x[0] == "n" else "0") for e in edges for x in e}


def test_token_counts(docs, rows, empty):
    own = tokenizers.Tokenizer.from_file(PATH)
    expected = sorted((r[0], len((r[1] or "").encode()), len(own.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)
    for chunk, overlap in ((32_768, 256), (200, 10)):  # the second has to widen overlaps, at last to the whole text
        found = token_counts.token_counts(docs, PATH, chunk=chunk, overlap=overlap).collect()
        assert sorted((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in found) == expected
        assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in found)
    assert token_counts.token_counts(empty, PATH).count() == 0


def test_pieces_equal_the_library():
    from tracewell.llm.encoding import ids

    own = tokenizers.Tokenizer.from_file(PATH)
    texts = ["", " ", "a  b", " a", "a ", "x.\nAnd  \n y", "don't <|endoftext|> stop<|endoftext|>", "é  b c", "tab\t x", "日本 語", "a᠎ b", "12 3.5 'll"]
    for _ in range(2):
        for t, (values, _) in zip(texts, ids(PATH).of(texts), strict=True):
            assert np.frombuffer(b"".join(values), "<u4").tolist() == own.encode(t, add_special_tokens=False).ids


def test_packing(docs, rows, empty):
    own = tokenizers.Tokenizer.from_file(PATH)
    found = packing.pack(docs, PATH, shard_tokens=6_000, with_ids=True).collect()
    ids = collections.Counter(tuple([*own.encode(r[1] or "", add_special_tokens=False).ids, 1]) for r in rows)
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in found:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    got = collections.Counter()
    for doc, p in pieces.items():
        if doc != 906:
            p.sort(key=lambda r: r["start"])
            assert [r["start"] for r in p] == np.cumsum([0, *[r["length"] for r in p]])[:-1].tolist()
            got[tuple(np.frombuffer(b"".join(r["ids"] for r in p), "<u4").tolist())] += 1
    assert all(ids[k] >= v for k, v in got.items()) and sum(got.values()) == len(rows) - 2
    for s in sequences.values():
        s.sort()
        assert [o for o, _ in s] == np.cumsum([0, *[n for _, n in s]])[:-1].tolist()
        n = sum(n for _, n in s)
        assert n == 2048 or n & (n - 1) == 0
    assert packing.pack(empty, PATH).count() == 0


def test_packing_follows_bm25_over_all_documents(docs, rows):
    """One shard against a plain greedy loop over BM25 with counts over all documents, copies kept apart."""
    docs = docs.coalesce(1)
    before = docs.sparkSession.conf.get("spark.sql.shuffle.partitions")
    docs.sparkSession.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        found = packing.pack(docs, PATH, shard_tokens=10**9, shard_docs=10**9, with_ids=True, window=256).collect()
    finally:
        docs.sparkSession.conf.set("spark.sql.shuffle.partitions", before)
    texts = collections.defaultdict(bytes)
    for r in sorted(found, key=lambda r: (r["doc_id"], r["start"])):
        texts[r["doc_id"]] += r["ids"]
    order = list(dict.fromkeys(r["doc_id"] for r in sorted(found, key=lambda r: (r["sequence_id"], r["offset"]))))
    assert 906 in order  # the row that occurs twice: left out of the comparison below
    ids = {d: np.frombuffer(texts[d], "<u4").tolist() for d in order if d != 906}
    seen = collections.Counter(t for d, x in ids.items() for t in set(x))
    twice = tokenizers.Tokenizer.from_file(PATH).encode("twice the same row here", add_special_tokens=False).ids + [1]
    seen.update(2 * list(set(twice)))
    n, mean = len(rows), (sum(map(len, ids.values())) + 2 * len(twice)) / len(rows)

    def bm25(a, b):
        tf = collections.Counter(b)
        return sum(math.log1p((n - seen[t] + 0.5) / (seen[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(b) / mean)) for t in set(a) if t in tf)

    # the documents after a window's seed fall in score until the window is full, and none that is left out scores more
    sequences = collections.defaultdict(list)
    for r in sorted(found, key=lambda r: (r["sequence_id"], r["offset"])):
        sequences[r["sequence_id"]].append(r)
    used, checked = set(), 0
    for s in sequences.values():
        inside = [r["doc_id"] for r in s]
        if 906 not in inside and sum(r["length"] for r in s) == 256:
            seed, rest = inside[0], inside[1:]
            scores = [bm25(ids[seed], ids[d]) for d in rest]
            assert all(a >= b - 1e-6 for a, b in zip(scores, scores[1:], strict=False))
            window = {texts[d] for d in inside}
            others = [bm25(ids[seed], ids[d]) for d in ids if d not in used and d not in inside and texts[d] not in window]
            if scores and min(scores) > 0:
                assert min(scores) >= max(others, default=0) - 1e-6
                checked += 1
        used |= set(inside)
    assert checked > 10


def test_documents_of_a_topic_meet_across_shards(spark):
    """Sixteen topics with words of their own, dealt over many shards: those in a window are of the topic of its first document."""
    rng = random.Random(12)
    name = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7))
    common, topics = [name() for _ in range(40)], [[name() for _ in range(50)] for _ in range(16)]
    texts = [" ".join(rng.choices(common, k=25) + rng.choices(topics[i % 16], k=25)) for i in range(1600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    found = packing.pack(docs, PATH, shard_tokens=12_000, window=1024).collect()
    windows = collections.defaultdict(list)
    for r in sorted(found, key=lambda r: r["offset"]):
        windows[r["sequence_id"]].append(r["doc_id"] % 16)
    same = [t == w[0] for w in windows.values() for t in w[1:]]
    assert len(windows) > 100 and np.mean(same) > 0.8


def test_copies_do_not_share_a_window():
    terms = [np.array([1, 2, 3]), np.array([1, 2, 3]), np.array([1, 2, 4]), np.array([1, 2, 3])]
    seen = np.array([0, 4, 4, 3, 1])
    cut = packing.order_and_cut(np.array([3] * 4), packing.Index(terms, seen, 4, 3.0), np.array([7, 7, 8, 7]), window=6)
    assert [[d for d, _, _ in s] for s in cut] == [[0, 2], [1], [3]] or [[d for d, _, _ in s] for s in cut][0] == [0, 2]
    many = packing.order_and_cut(np.ones(5000, np.int64), packing.Index([np.array([1])] * 5000, np.array([0, 5000]), 5000, 1.0), np.zeros(5000, np.int64))
    assert sum(len(s) for s in many) == 5000


def test_line_dedup(spark, docs, empty):
    import duckdb

    unique = docs.dropDuplicates(["doc_id"])
    documents = unique.toPandas()  # noqa: F841  read by name
    con = duckdb.connect()
    con.register("documents", documents)
    expected = sorted(con.execute(line_dedup.ORACLE).fetchall())
    out = line_dedup.line_dedup(unique)
    found = sorted((r["doc_id"], r["n_lines"], r["removed_lines"], hashlib.md5(r["clean_text"].encode()).hexdigest()) for r in out.collect())
    assert found == expected and any(r[2] for r in found)
    assert line_dedup.line_dedup(docs).count() == docs.count()
    assert line_dedup.line_dedup(empty).count() == 0


@pytest.mark.parametrize("head", [lm_score.HEAD, 30])
def test_lm_score(docs, rows, empty, monkeypatch, head):
    """All columns against plain loops over the trained weights, and against other splits of the input."""
    weights = []
    real = lm_score.trained
    monkeypatch.setattr(lm_score, "trained", lambda *a, **k: weights.append((real(*a, **k), a[2], a[3])) or weights[-1][0])
    monkeypatch.setattr(lm_score, "BLOCK_DOCS", 16)
    run = lambda df: sorted(tuple(r) for r in lm_score.lm_score(df, head=head, piece=700).collect())
    found = run(docs)
    table, bias, cls = weights[0]
    texts = [([w.lower() if w.isascii() else w for w in words(r[1])] + [""], zlib.crc32(str(r[0]).encode()) % 7 == 2, r[0]) for r in rows]
    c = collections.Counter(w for t, held, _ in texts if not held for w in t)
    n, v = sum(c.values()), len(c)
    base = [(i, held, len(t), sum(c[w] > 0 for w in t), n, pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t))) for t, held, i in texts]
    assert [r[:6] for r in found] == sorted(base, key=lambda r: r[:5])

    # the vocabulary's head: words with counts that fewer than ``head`` words reach
    ordered = sorted((w for w in c if w), key=lambda w: (-c[w], w.encode()))
    inside = [w for w in ordered if sum(x >= c[w] for x in c.values()) < head]
    ids = {"": 0} | {w: i for i, w in enumerate(inside, 1)}
    of = lambda w: ids.get(w, None) if w in ids else lm_score.slot_of(w.encode())
    sizes = collections.Counter()
    for w, k in c.items():
        sizes[of(w)] += k
    in_class = collections.defaultdict(set)
    for i in [*ids.values(), *range(lm_score.HEAD, lm_score.HEAD + lm_score.SLOTS)]:
        in_class[cls[i]].add(i)
    of_class = {k: sum(sizes[i] for i in s) for k, s in in_class.items()}
    share = lambda i: (sizes[i] + 1) / (of_class[cls[i]] + len(in_class[cls[i]]))
    pairs = collections.Counter()
    for t, held, _ in texts:
        if not held:
            pairs.update(zip([0, *map(of, t)], map(of, t), strict=False))
    follow, different = collections.Counter(), collections.Counter()
    for (h, w), k in pairs.items():
        follow[h, cls[w]] += k
        different[h, cls[w]] += 1

    def within(h, w):
        if cls[w] < lm_score.SINGLE:
            return 1.0
        k = follow[h, cls[w]]
        return (max(pairs[h, w] - 1, 0) + different[h, cls[w]] * share(w)) / k if k else share(w)

    def inside_slot(w):
        if w in ids:
            return 1.0
        own = [x for x in c if x not in ids and of(x) == of(w)]
        size, once = sum(c[x] for x in own), sum(c[x] == 1 for x in own)
        unseen = min((once + 0.5) / (size + 1), 0.5) if size else 1.0
        return (1 - unseen) * (c[w] + 1) / (size + len(own)) if c[w] else unseen

    logs = []
    for t, _, i in texts:
        own = np.array([of(w) for w in t])
        rows_ = lm_score.features(own, np.array([0]))
        total = 0.0
        for k, w in enumerate(own.tolist()):
            z = sum(table[r[k]].astype(float) for r in rows_) + bias
            total += math.log10(np.exp(z - z.max())[cls[w]] / np.exp(z - z.max()).sum()) + math.log10(within(own[k - 1] if k else 0, w)) + math.log10(inside_slot(t[k]))
        logs.append((i, total))
    assert [r[6] for r in found] == pytest.approx([x for _, x in sorted(logs)], rel=1e-4)
    # what may follow a context adds up to one
    for h in (0, of(ordered[0]), of(ordered[60])):
        for k in (lm_score.SINGLE, lm_score.CLASSES - 1):
            assert sum(within(h, i) for i in in_class[k]) == pytest.approx(1)
    again = run(docs.repartition(5))
    assert [r[:5] for r in again] == [r[:5] for r in found]
    assert [r[6] for r in again] == pytest.approx([r[6] for r in found], rel=1e-5)
    if head == lm_score.HEAD:
        assert lm_score.lm_score(empty).count() == 0


def test_lm_score_learns_word_order(spark):
    """Held-out texts of a fluent source score above their shuffled words, and above an interpolated bigram model."""
    rng = __import__("random").Random(8)
    follow = {f"w{i}": [f"w{rng.randrange(400)}" for _ in range(4)] for i in range(400)}
    texts = []
    for i in range(4000):
        w = [f"w{rng.randrange(400)}"]
        while len(w) < 40:
            w.append(rng.choice(follow[w[-1]]))
        texts.append((i, " ".join(w)))
    shuffled = [(i + 10_000, " ".join(rng.sample(t.split(), 40))) for i, t in texts if zlib.crc32(str(i).encode()) % 7 == 2]
    shuffled = [(next(k for k in range(i, 10**6) if zlib.crc32(str(k).encode()) % 7 == 2), t) for i, t in shuffled]
    found = lm_score.lm_score(spark.createDataFrame(texts + shuffled, "doc_id long, text string").repartition(4)).collect()
    held = [r for r in found if r["held_out"]]
    mean = lambda rows, c: sum(r[c] for r in rows) / sum(r["n_tokens"] for r in rows)
    fluent, mixed = [r for r in held if r["doc_id"] < 4000], [r for r in held if r["doc_id"] >= 4000]
    assert mean(fluent, "score") > mean(mixed, "score") + 0.3
    one, two, n = collections.Counter(), collections.Counter(), 0
    for i, t in texts:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            w = [*t.split(), ""]
            one.update(w)
            two.update(zip(["", *w], w, strict=False))
            n += len(w)
    bigram = tokens_ = 0
    for i, t in texts:
        if zlib.crc32(str(i).encode()) % 7 == 2:
            w = [*t.split(), ""]
            tokens_ += len(w)
            bigram += sum(math.log10(0.7 * two[a, b] / one[a] + 0.3 * (one[b] + 1) / (n + len(one) + 1)) for a, b in zip(["", *w], w, strict=False))
    assert mean(fluent, "score") > bigram / tokens_


def test_ann(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[250:280] = x[5]  # copies
    data = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(300, None), (301, [0.0] * 8), (302, [float("nan")] * 8), (303, [1.0, None] * 4), (304, [1.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    found = ann.nearest(df, F.col("vec_id") % 20 == 0).collect()
    s = x.astype(np.float64) @ x.astype(np.float64).T
    hit = 0
    for q in range(0, 300, 20):
        best = sorted((i for i in range(300) if i != q), key=lambda i: (-s[q, i], i))[:20]
        got = sorted((r["rank"], r["vec_id"], r["score"]) for r in found if r["query_id"] == q)
        assert [g[0] for g in got] == list(range(1, 21))
        assert [g[2] for g in got] == pytest.approx([s[q, g[1]] for g in got])
        hit += len(set(best) & {g[1] for g in got})
    assert hit >= 0.95 * 20 * 15
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_ann_by_descent(spark):
    """Blocks far smaller than the table: the descent and the search bring the recall. Identifiers with two vectors, other lengths, clashing columns."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(11)
    n = 3000
    x = (rng.normal(size=(60, 24))[rng.integers(0, 60, n)] + 0.7 * rng.normal(size=(n, 24))).astype(np.float32).astype(np.float64)
    data = [(i, v.tolist(), 1, "a") for i, v in enumerate(x)]
    data += data[:40]  # repeated rows
    data += [(20 * i, (x[20 * i] + 0.5).astype(np.float32).astype(float).tolist(), 2, "b") for i in range(5)]
    data += [(5000 + i, [float(i), 1.0], 3, "c") for i in range(60)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, id int, x string")
    found = ann.nearest(df, F.col("vec_id") % 20 == 0, tables=2, leaf=100).collect()
    vectors = {(r[0], tuple(r[1])) for r in data if r[0] < 5000}
    ids, every = np.array([v[0] for v in vectors]), np.array([v[1] for v in vectors])
    got = collections.Counter((r["query_id"], r["vec_id"], round(r["score"], 6)) for r in found)
    hit = total = 0
    for i in np.nonzero(ids % 20 == 0)[0]:
        s = every @ every[i]
        best = sorted((j for j in range(len(ids)) if ids[j] != ids[i]), key=lambda j: (-s[j], ids[j]))[:20]
        hit += sum(got[int(ids[i]), int(ids[j]), round(float(s[j]), 6)] > 0 for j in best)
        total += 20
    assert hit >= 0.9 * total
    ranks = collections.Counter((r["query_id"], r["rank"]) for r in found)
    assert all(ranks[0, k] == 2 and ranks[200, k] == 1 for k in range(1, 21))
    small = [r for r in found if r["query_id"] == 5000]
    assert [r["vec_id"] for r in sorted(small, key=lambda r: r["rank"])] == list(range(5001, 5021)) and len(small) == 20


def test_ann_with_some_long_vectors(spark):
    """Vectors of 10 to 1000 times the usual norm are found, and the others still are told apart."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(5)
    x = rng.normal(size=(1200, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    for i, times in zip(range(7, 1200, 200), (10, 30, 100, 300, 1000, 1000), strict=True):
        x[i] *= times
    x = x.astype(np.float32).astype(np.float64)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = ann.nearest(df, F.col("vec_id") % 20 == 0).collect()
    s, hit = x @ x.T, 0
    for q in range(0, 1200, 20):
        best = sorted((i for i in range(1200) if i != q), key=lambda i: (-s[q, i], i))[:20]
        hit += len(set(best) & {r["vec_id"] for r in found if r["query_id"] == q})
    assert hit >= 0.95 * 20 * 60
