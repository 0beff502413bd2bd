import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, skey string, key string, h long"


def made(seed=3, n=60):
    """Small documents: copies, near copies, blank and null texts, null identifiers and sources, repeated rows, one long text."""
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu"]
    text = lambda k: " ".join(rng.choice(words) + str(rng.randrange(30)) for _ in range(k))
    rows = []
    for i in range(n):
        rows.append([i, "\n".join(text(rng.randrange(3, 30)) for _ in range(rng.randrange(1, 5))), "en", f"s{i % 4}"])
    for i in range(n, n + 12):
        base = rows[i % 3][1]
        rows.append([i, base if i % 2 else base.replace(" ", "\t", 1), "en", "s0"])
    for i in range(n + 12, n + 24):
        w = rows[3][1].split(" ")
        w[rng.randrange(len(w))] = f"new{i}"
        rows.append([i, " ".join(w) + " " + " ".join(f"tail{k}" for k in range(60)), None, "s1"])
    rows.append([900, None, "en", "s0"])
    rows.append([901, "", "en", None])
    rows.append([902, " \n\t ", "en", None])
    rows.append([903, "one two", None, "s9"])
    rows.append([904, text(4000), "en", "s2"])
    rows.append([905, "no space " + "x" * 3000, "en", "s2"])
    rows += [[906, "twice the same row here", "en", "s3"]] * 2
    return [(*r, len(r[1] or ""), "a", "b", 1) for r in rows]


@pytest.fixture(scope="session")
def rows():
    return made()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame(rows, SCHEMA).repartition(3, "lang", "n_chars").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
