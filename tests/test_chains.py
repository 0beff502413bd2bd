"""Chains over small graphs: lines `source>target`, a node is table.column, no table is a SELECT's output."""

import csv
import random

import pytest

from tracewell.operators import chains
from tracewell.operators.cut import checkpointed

RECORD = "source_table string, source_column string, target_table string, target_column string"
GRAPHS = {
    "linear": ("a.c>b.c b.c>c.c c.c>.f", 3),
    "many_to_one": ("a.1>.m b.2>.m c.3>.m", 3),
    "one_to_many": ("a.c>.t1 a.c>.t2 a.c>.t3", 3),
    "tree": ("r.c>a.1 r.c>b.1 a.1>.f a.1>.g b.1>.h", 6),
    "deep": ("1.c>2.c 2.c>3.c 3.c>4.c 4.c>5.c 5.c>.f", 5),
    "cycle": ("a.c>b.c b.c>c.c c.c>a.c x.d>.d", 1),
    "diamond": ("s.c>l.c s.c>r.c l.c>.f r.c>.f", 4),
    "constants": (".>.k d.1>.v", 1),
    "mixed": ("x.1>i.c y.2>i.c i.c>.f i.c>.g z.3>.h", 7),
    "half_empty": ("s.1>.t .2>.u s.>.v", 3),
    "wide": (" ".join([f"s.b>i{k}.c" for k in range(10)] + [f"i{k}.c>.f{k}{j}" for k in range(10) for j in range(10)]), 110),
    "self": ("b.c>t.c t.c>t.c t.c>.f", 2),
}


def parse(text):
    pair = lambda n: (n.rpartition(".")[0], n.rpartition(".")[2])
    return [(*pair(a), *pair(b)) for a, b in (line.split(">") for line in text.split())]


def brute(rows):
    """Steps by walking every simple path."""
    created = {t for _, _, t, _ in rows if t}
    base = {s for s, _, _, c in rows if s and c and s not in created}
    above = {}
    for st, sc, tt, tc in rows:
        if tc and (st or sc):
            above.setdefault((tt, tc), set()).add((st, sc))
    used = {(st, sc) for st, sc, _, tc in rows if tc and st in created}
    finals = {(tt, tc) for _, _, tt, tc in rows if tc and (not tt or (tt, tc) not in used)}

    def up(at, path):
        if at[0] in base:
            yield path
        elif at not in above:
            if not at[0]:
                yield path
        else:
            for s in above[at]:
                if s not in path:
                    yield from up(s, (s, *path))

    out = set()
    for f in finals:
        for p in up(f, (f,)) if f in above else ():
            for i in range(len(p) - 1):
                out.add((*p[i], *p[i + 1], *p[0], *p[-1], i + 1, len(p) - 1 - i))
    return out


@pytest.mark.parametrize("name", GRAPHS)
def test_steps(spark, name):
    rows = parse(GRAPHS[name][0])
    df = spark.createDataFrame(rows, RECORD)
    steps = {tuple(r) for r in chains.chain_steps(df).collect()}
    assert steps == brute(rows)
    if name not in ("mixed", "wide"):
        assert len(steps) == GRAPHS[name][1]


def test_levels_of_a_line(spark):
    df = spark.createDataFrame(parse(GRAPHS["deep"][0]), RECORD)
    for r in chains.chain_steps(df).collect():
        assert r["level_bottom_to_top"] == 6 - r["level_top_to_bottom"]


def test_random_graphs_and_recursive_sql(spark):
    rng = random.Random(5)
    for _ in range(2):
        rows = [(t := rng.choice(["", "a", "b", "c", "d"]), rng.choice("xy"), rng.choice(["", "b", "c", "d"]), rng.choice("xy")) for _ in range(9)]
        df = spark.createDataFrame(rows, RECORD)
        assert {tuple(r) for r in chains.chain_steps(df).collect()} == brute(rows)
        df.createOrReplaceTempView("random_records")
        paths = spark.sql(chains.recursive_sql("random_records"))
        own = {tuple((n["table"], n["column"]) for n in r["path"]) for r in chains.chain_paths(df).collect()}
        assert {tuple(tuple(n.split("\t")) for n in r["path"]) for r in paths.collect()} == own


def tarjan(rows):
    """Nodes of components of two or more, or with an edge to themselves, by depth-first search."""
    below = {}
    for a, b in rows:
        below.setdefault(a, set()).add(b)
        below.setdefault(b, set())
    index, low, stack, out = {}, {}, [], set()

    def visit(v):
        index[v] = low[v] = len(index)
        stack.append(v)
        for w in below[v]:
            if w not in index:
                visit(w)
                low[v] = min(low[v], low[w])
            elif w in stack:
                low[v] = min(low[v], index[w])
        if low[v] == index[v]:
            at = stack.index(v)
            if len(stack) - at > 1 or v in below[v]:
                out.update(stack[at:])
            del stack[at:]

    for v in below:
        if v not in index:
            visit(v)
    return out


def test_components_of_random_graphs(spark):
    rng = random.Random(11)
    rows = []
    for part in range(12):  # sparse and dense graphs side by side, so that all are decided in one run
        n = rng.randrange(4, 14)
        rows += [(f"p{part}", str(rng.randrange(n)), f"p{part}", str(rng.randrange(n))) for _ in range(rng.randrange(n // 2, 2 * n))]
    rows += [("line", str(k), "line", str(k + 1)) for k in range(8)]
    found = {tuple(r) for r in chains.cycle_nodes(spark.createDataFrame(rows, RECORD)).collect()}
    assert found == tarjan([((a, b), (c, d)) for a, b, c, d in rows])


def test_counts_on_a_ladder_of_diamonds(spark):
    """2**20 paths and more, none of them followed: fanout by bitmaps, summary by the two sides of each edge."""
    text = " ".join(f"n{k}.c>l{k}.c n{k}.c>r{k}.c l{k}.c>n{k + 1}.c r{k}.c>n{k + 1}.c" for k in range(20))
    df = spark.createDataFrame(parse(text + " n20.c>.f n20.c>.g"), RECORD)
    assert [tuple(r) for r in chains.fanout(df).collect()] == [("n0", "c", 2)]
    assert chains.summary(df).first().asDict() == {"steps": 2 * 80 + 2, "sources": 1, "targets": 2, "multi_level_steps": 162, "deepest": 41}


def test_summary_and_fanout_are_those_of_the_steps(spark):
    rng = random.Random(3)
    rows = []
    for part in range(6):
        rows += [(f"{part}{rng.choice('abcd')}", rng.choice("xy"), "" if (t := rng.choice(" bcde")) == " " else f"{part}{t}", f"{part}{rng.choice('xyz')}") for _ in range(8)]
    rows = [r for r in rows if r[0] < r[2] or not r[2]]  # no cycles
    df = spark.createDataFrame(rows, RECORD)
    steps = spark.createDataFrame(sorted(brute(rows)), chains.chain_steps(df).schema)
    assert {tuple(r) for r in chains.chain_steps(df).collect()} == brute(rows)
    assert chains.summary(df).first() == chains.chain_summary(steps).first()
    assert {tuple(r) for r in chains.fanout(df).collect()} == {tuple(r) for r in chains.chain_fanout(steps).collect()}


def test_trace_of_columns(spark):
    df = spark.createDataFrame(parse("a.c>b.c b.c>c.c c.c>b.c b.c>.f g.c>b.d h.x>g.c .o>.p q.c>.o g.z>.w"), RECORD)
    targets = spark.createDataFrame([("b", "c"), (" b ", "c"), ("", "f"), ("c", "c"), ("a", "c"), (None, "lonely"), ("nobody", "x"), ("b", "d"), (None, "p"), ("", "w")], "table_name string, column_name string")
    found = sorted(">".join(f"{n['table']}.{n['column']}" for n in r["path"]) for r in chains.trace(df, targets).collect())
    assert found == sorted(["a.c>b.c", "a.c>b.c>.f", "a.c>b.c>c.c", "a.c", ".lonely", "h.x>g.c>b.d", "q.c>.o>.p"])


def test_cycles(spark):
    found = {tuple(r) for r in chains.cycle_nodes(spark.createDataFrame(parse(GRAPHS["cycle"][0]), RECORD)).collect()}
    assert found == {("a", "c"), ("b", "c"), ("c", "c")}
    assert chains.cycle_nodes(spark.createDataFrame(parse(GRAPHS["tree"][0]), RECORD)).count() == 0


def test_summary_and_fanout(spark):
    steps = chains.chain_steps(spark.createDataFrame(parse(GRAPHS["one_to_many"][0]), RECORD))
    assert chains.chain_summary(steps).first().asDict() == {"steps": 3, "sources": 1, "targets": 3, "multi_level_steps": 0, "deepest": 1}
    assert [tuple(r) for r in chains.chain_fanout(steps).collect()] == [("a", "c", 3)]


def test_csv_round_trip(spark, tmp_path):
    from tracewell import sinks
    from tracewell.sources.scripts import read_lineage

    path = tmp_path / "lineage.csv"
    with open(path, "w", newline="") as f:
        out = csv.writer(f)
        out.writerow(["source_table", "source_column", "expression", "target_column", "target_table", "file"])
        out.writerow([" a ", "c", 'f("x, y")', "c", "", "one.sql"])
    records = read_lineage(spark, str(path))
    assert [tuple(r) for r in records.collect()] == [("a", "c", 'f("x, y")', "c", "", "one.sql")]
    written = sinks.write_csv(chains.chain_steps(records), str(tmp_path / "steps"), chains.STEP)
    assert written == 1
    assert spark.read.csv(str(tmp_path / "steps"), header=True).first()["ultimate_source_table"] == "a"


def test_paths_write_no_more_than_their_edges_a_few_times(spark):
    """One root, ten middles, 2000 leaves, five outputs: rows that are cut, the records and edges among them; and 36 hops in segments."""
    text = " ".join([f"r.0>m.{k} " + " ".join(f"m.{k}>l.{j}" for j in range(k, 2000, 10)) for k in range(10)] + [f"l.{j}>.{j % 5}" for j in range(2000)])
    rows = parse(text)
    written = []

    def cut(df):
        df = checkpointed(df)
        written.append(df.count())
        return df

    found = {tuple((n["table"], n["column"]) for n in r["path"]) for r in chains.chain_paths(spark.createDataFrame(rows, RECORD), cut).collect()}
    assert found == {(("r", "0"), ("m", str(j % 10)), ("l", str(j)), ("", str(j % 5))) for j in range(2000)}
    assert sum(written) < 4 * len(rows)
    line = " ".join(f"{k}.c>{k + 1}.c" for k in range(36)) + " 20.c>.x 36.c>.y 36.c>.z"
    found = sorted([n["table"] + n["column"] for n in r["path"]] for r in chains.chain_paths(spark.createDataFrame(parse(line), RECORD)).collect())
    assert found == sorted([[f"{k}c" for k in range(21)] + ["x"], [f"{k}c" for k in range(37)] + ["y"], [f"{k}c" for k in range(37)] + ["z"]])


def test_paths_in_short_segments_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(chains, "SEGMENT", 2)
    monkeypatch.setattr(chains, "FEW", 0)
    for name in ("deep", "cycle", "self", "tree"):
        rows = parse(GRAPHS[name][0])
        assert {tuple(r) for r in chains.explode_steps(chains.chain_paths(spark.createDataFrame(rows, RECORD))).collect()} == brute(rows)
