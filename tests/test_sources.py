"""Catalogs, statement splitting, the command line and the stream of scripts."""

import json

from tracewell import cli
from tracewell.engine import LineageEngine
from tracewell.operators import chains
from tracewell.plans.walk import Walker
from tracewell.sources.catalog import catalog_from_csv, catalog_from_json, catalog_of, overlaid
from tracewell.sources.scripts import split_statements
from tracewell.streaming import follow_scripts
from tracewell.streaming.chains import ChainStore, follow_chains


def names(df):
    return sorted((r["table_name"], r["column_name"], r["ordinal"]) for r in df.collect())


def test_nested_and_flat_schemas(spark):
    raw = {"T": ["A", "`b`"], "cat": {"db": {"u": {"x": "INT", "y": "string"}}}, "none": {}}
    assert names(catalog_from_json(spark, raw)) == [("cat.db.u", "x", 0), ("cat.db.u", "y", 1), ("t", "a", 0), ("t", "b", 1)]


def test_schema_csv_is_positional(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text("w,x,y,z\ndb, T ,A,INT\n,u,b\n\ndb,,c,int\ndb,T,B,\n")
    assert names(catalog_from_csv(spark, str(path))) == [("db.t", "a", 0), ("db.t", "b", 1), ("u", "b", 0)]


def test_overlay_hides_all_below_its_first_keys(spark):
    base, local = catalog_from_json(spark, {"t": ["a", "b"], "u": ["c"], "a": {"b": {"v": {"x": "int"}}, "k": {"w": {"y": "int"}}}}), catalog_from_json(spark, {"t": ["z"], "a": {"n": {"q": {"r": "int"}}}}, "f")
    assert names(overlaid(base, local)) == [("a.n.q", "r", 0), ("t", "z", 0), ("u", "c", 0)]


def test_script_schema_hides_general_tables_below_its_keys(spark):
    general = catalog_from_json(spark, {"a": {"b": {"v": ["x"], "w": ["y"]}}, "u": ["c"]})
    engine = LineageEngine(spark, general.unionByName(catalog_from_json(spark, {"a": {"b": {"w": ["z"]}}}, "own.sql")))
    text = "SELECT * FROM a.b.v; SELECT * FROM a.b.w; SELECT * FROM u"
    found = engine.extract(spark.createDataFrame([("own.sql", text), ("other.sql", text)], "file string, text string")).collect()
    assert [(r["file"], r["stmt"], r["source_column"]) for r in found] == [("other.sql", 0, "x"), ("other.sql", 1, "y"), ("other.sql", 2, "c"), ("own.sql", 1, "z"), ("own.sql", 2, "c")]


def test_each_text_is_parsed_once_and_kept(spark, tmp_path):
    """400 scripts of 8 different statements; little is held on the driver; a second engine finds all in the store."""
    texts = [f"SELECT c{k} FROM t JOIN u ON true" for k in range(7)] + ["nonsense here"]
    scripts = spark.createDataFrame([(f"s{i}", f"{texts[i % 8]}; {texts[(i + 1) % 8]}") for i in range(400)], "file string, text string")
    plain = LineageEngine(spark)
    expected = sorted(map(tuple, plain.extract(scripts).collect()))
    assert plain.parsed == 8 and len(expected) == 700
    held = LineageEngine(spark, store=str(tmp_path / "store"), held=5)
    assert sorted(map(tuple, held.extract(scripts).collect())) == expected and held.parsed == 8
    again = LineageEngine(spark, store=str(tmp_path / "store"))
    assert sorted(map(tuple, again.extract(scripts.limit(100).unionByName(scripts).distinct()).collect())) == expected and again.parsed == 0


def test_what_a_walker_holds_does_not_grow_with_the_texts(spark):
    """The rows of parsed statements leave the driver as they become many."""
    engine = LineageEngine(spark, held=200)
    scripts = spark.createDataFrame([(f"s{i}", f"SELECT a, b, c FROM t{i}") for i in range(300)], "file string, text string")
    sizes, take = [], Walker.take
    try:
        Walker.take = lambda self: (sizes.append(self.held()), take(self))[1]
        relations = engine.statements(scripts)
    finally:
        Walker.take = take
    assert len(sizes) > 10 and max(sizes) < 220 and relations["statements"].count() == 300


def test_levels_of_queries_named_in_reverse_order(spark):
    """2,000 queries, each of the one behind it: no recursion."""
    n = 2000
    walker = Walker(spark)
    walker.statement("k", "WITH " + ", ".join(f"q{k} AS (SELECT a FROM {'q' + str(k + 1) if k + 1 < n else 't'})" for k in range(n)) + " SELECT a FROM q0")
    assert sorted(r[4] for r in walker.rows["branches"]) == list(range(n + 1))


def test_waves_follow_needs(spark):
    """Created tables that need nothing of each other share a wave; a statement sees the columns a table had when it ran."""
    text = ";".join(f"CREATE TABLE m{k} AS SELECT a AS c{k} FROM t" for k in range(30)) + "; SELECT * FROM m3; CREATE TABLE m3 AS SELECT b AS later FROM m4; SELECT * FROM m3"
    engine = LineageEngine(spark)
    scripts = spark.createDataFrame([("f", text)], "file string, text string")
    relations = engine.statements(scripts)
    mentioned = relations["sources"].select("file", "stmt", "table_name")
    level = engine._levels(relations["statements"], mentioned)
    assert {r["stmt"]: r["wave"] for r in level.collect()} == {k: 0 for k in range(30)} | {30: 1, 31: 1, 32: 2}
    found = {(r["stmt"], r["target_column"]): (r["source_table"], r["source_column"]) for r in engine.extract(scripts, relations).collect()}
    assert found[30, "c3"] == ("m3", "c3") and found[32, "later"] == ("m3", "later") and (32, "c3") not in found and found[31, "later"] == ("m4", "b")


def test_stream_of_chains(spark, tmp_path):
    """After three batches, of which the last replaces a file, and after that batch ran again, the steps are those of a run over all files."""
    store, engine = ChainStore(spark, str(tmp_path / "store")), LineageEngine(spark)
    batches = [
        {"a.sql": "CREATE TABLE m AS SELECT x, y FROM base", "b.sql": "SELECT x FROM m; SELECT k FROM other"},
        {"c.sql": "CREATE TABLE n AS SELECT y AS z FROM m; SELECT z FROM n", "d.sql": "CREATE TABLE base AS SELECT x FROM root"},
        {"a.sql": "CREATE TABLE m AS SELECT y FROM base2"},
    ]
    frame = lambda files: spark.createDataFrame(sorted(files.items()), "file string, text string")
    for number, files in enumerate(batches):
        store.apply(frame(files), number)
    expected = sorted(chains.chain_steps(engine.extract(frame(batches[0] | batches[1] | batches[2]))).collect())
    assert sorted(store.steps().collect()) == expected and len(expected) > 4
    store.apply(frame(batches[2]), 2)
    assert sorted(store.steps().collect()) == expected


def test_follow_chains(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.sql").write_text("SELECT a FROM x")
    follow_chains(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert [(r["source_table"], r["target_column"]) for r in ChainStore(spark, str(tmp_path / "out")).steps().collect()] == [("x", "a")]


def test_catalog_of_frames(spark):
    assert names(catalog_of({"Numbers": spark.range(1)})) == [("numbers", "id", 0)]


def test_statements():
    assert [s.strip() for s in split_statements("SELECT ';' AS a; -- no; \n SELECT 2 /* ; */;\n;")] == ["SELECT ';' AS a", "-- no; \n SELECT 2 /* ; */"]


def test_command_line(spark, tmp_path):
    sql = tmp_path / "sql"
    sql.mkdir()
    assert cli.main(["lineage", "--sql-folder", str(sql), "--schema", "{}", "--output", str(tmp_path / "o")]) == 2
    (sql / "one.sql").write_text("CREATE TABLE t AS SELECT * FROM x; SELECT a FROM t")
    (sql / "one_schema.json").write_text(json.dumps({"x": ["a"]}))
    assert cli.main(["lineage", "--sql-folder", str(sql), "--schema", "{", "--output", str(tmp_path / "o")]) == 1
    assert cli.main(["lineage", "--sql-folder", str(sql), "--schema", "{}", "--output", str(tmp_path / "o")]) == 0
    assert cli.main(["chains", str(tmp_path / "o"), str(tmp_path / "c")]) == 0
    steps = spark.read.csv(str(tmp_path / "c"), header=True).collect()
    assert {(r["source_table"], r["target_table"], r["level_top_to_bottom"]) for r in steps} == {("x", "t", "1"), ("t", None, "2")}
    assert cli.main(["chains", str(tmp_path / "o"), str(tmp_path / "steps.csv")]) == 0
    lines = (tmp_path / "steps.csv").read_text().splitlines()
    assert len(lines) == 1 + len(steps) and lines[0].startswith("source_table,source_column")
    assert cli.main(["chains"]) == 1


def test_stream_of_scripts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.sql").write_text("SELECT a FROM x")
    for n in (1, 2):
        follow_scripts(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
        assert spark.read.parquet(str(tmp_path / "out")).count() == n
        (tmp_path / "in" / "b.sql").write_text("SELECT b FROM y")
