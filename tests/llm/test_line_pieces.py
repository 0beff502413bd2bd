import random

from pyspark.sql import functions as F

from tracewell.llm import line_dedup

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def line(rng, k):
    return " ".join("".join(rng.choices(LETTERS, k=6)) for _ in range(k))


def test_repeated_passages_go_whole(spark):
    """Passages of two to five lines and over 50 words, each in two documents of lines of their own: nearly all words of
    those of three lines and more go from the second, none from the first or from documents without any."""
    rng = random.Random(5)
    rows, planted = [], {}
    for p in range(200):
        n = 2 + p % 4
        passage = [line(rng, 60 // n + 1) for _ in range(n)]
        for copy in range(2):
            before, after = ([line(rng, 12) for _ in range(rng.randrange(0, 6))] for _ in range(2))
            i = p + 1000 * copy
            rows.append((i, "\n".join(before + passage + after)))
            planted[i] = passage
    rows += [(5000 + i, "\n".join(line(rng, 12) for _ in range(8))) for i in range(50)]
    found = {r["doc_id"]: r for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    gone = dict.fromkeys(range(2, 6), 0)
    for i, text in rows:
        r = found[i]
        if i < 1000 or i >= 5000:
            assert r["clean_text"] == text and r["removed_lines"] == 0
            continue
        lines, clean = text.split("\n"), r["clean_text"].split("\n")
        left = [x for x in lines if x not in clean]
        assert all(x in planted[i] for x in left) and len(left) == r["removed_lines"]
        assert [x for x in lines if x in clean] == clean or r["removed_lines"] == len(lines)
        gone[len(planted[i])] += len(left) / len(planted[i]) / 50
    assert gone[2] > 0.6 and gone[3] >= 0.85 and gone[4] >= 0.9 and gone[5] >= 0.9


def test_blank_lines_single_lines_and_long_runs(spark):
    """Blank lines and a single repeated line stay; a run of one line keeps its first; null identifiers, and rows alike, are one document each."""
    one = "a line by itself that stands in both of these documents"
    rows = [(1, f"x1\n{one}\ny1"), (2, f"x2\n{one}\ny2"), (3, "p\n\n\n\nq"), (4, "r\n\n\n\ns"), (5, None), (6, ""), (None, "m\nn\no"), (None, "m\nn\no")]
    rows += [(7, "\n".join(["same"] * 5000))]
    rows += [(8, "\n".join(f"row {i}" for i in range(300))), (9, "\n".join(f"row {i}" for i in range(300)))]
    out = line_dedup.line_dedup(spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, n_lines string"))
    assert sorted(out.columns) == ["clean_text", "doc_id", "n_lines", "removed_lines", "text"]
    found = out.collect()
    assert len(found) == len(rows)
    for r in found:
        if r["doc_id"] not in (7, 9):
            assert r["clean_text"] == (r["text"] or "") and r["removed_lines"] == 0
    run = next(r for r in found if r["doc_id"] == 7)
    assert set(run["clean_text"].split("\n")) == {"same"} and run["n_lines"] == 5000 and run["removed_lines"] + len(run["clean_text"].split("\n")) == 5000
    assert next(r for r in found if r["doc_id"] == 9)["removed_lines"] >= 298


def test_pieces_of_one_hash_and_different_bytes_stay(spark, monkeypatch):
    """With a hash of a few values nearly every hash is shared by different bytes, and nothing of those goes."""
    rng = random.Random(6)
    shared = [line(rng, 9) for _ in range(6)]
    rows = [(i, "\n".join([line(rng, 5), *shared, line(rng, 5)] if i % 10 == 0 else [line(rng, 5) for _ in range(8)])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert any(r["removed_lines"] for r in line_dedup.line_dedup(docs).collect())
    monkeypatch.setattr(line_dedup, "key_of", lambda h: F.substring(F.md5(h), 1, 1))
    assert not any(r["removed_lines"] for r in line_dedup.line_dedup(docs).collect())
