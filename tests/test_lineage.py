"""Lineage of statements over the tables of a lending library, each by a rule; all extracted in one batch for each mode.

A case is a script and its lines `target.column = source.column`, several for several origins; `.x` has no table,
`.` neither. Cases of MODAL give other lines in each mode.
"""

import pytest

from tracewell.engine import LineageEngine
from tracewell.sources.catalog import SCHEMA as CATALOG
from tracewell.sources.catalog import flatten

TABLES = {
    "books": ["isbn", "title", "writer", "price"],
    "writers": ["wid", "surname", "born"],
    "loans": ["loan", "isbn", "reader", "fee"],
    "readers": ["reader", "town"],
    "vault.old.shelf": ["row_no", "box"],
    "meters": ["meter", "kind", "amount", "cost"],
    "web_sales": ["ws_price"],
    "item": ["i_brand"],
    "fines": ["loan", "sum"],
}

CASES = {
    # projections
    "columns": ("SELECT isbn, title FROM books", "isbn = books.isbn; title = books.title"),
    "renamed": ("SELECT title AS heading FROM books", "heading = books.title"),
    "star": ("SELECT * FROM readers", "reader = readers.reader; town = readers.town"),
    "star_of_alias": ("SELECT r.*, l.fee FROM loans l JOIN readers r ON l.reader = r.reader", "reader = readers.reader; town = readers.town; fee = loans.fee"),
    "star_of_all": ("SELECT * FROM readers, writers", "reader = readers.reader; town = readers.town; wid = writers.wid; surname = writers.surname; born = writers.born"),
    "star_and_again": ("WITH r AS (SELECT town FROM readers) SELECT town, *, town FROM r", "town = readers.town"),
    "expression": ("SELECT price * 2 + length(title) AS v FROM books", "v = books.price; v = books.title"),
    "constant": ("SELECT 'x' AS mark, town FROM readers", "mark = .; town = readers.town"),
    "count_rows": ("SELECT COUNT(*) AS n FROM loans", "n = ."),
    "filters_give_nothing": ("SELECT title FROM books WHERE price > 3 GROUP BY title HAVING max(price) > 4 ORDER BY max(price) LIMIT 5", "title = books.title"),
    "distinct": ("SELECT DISTINCT town FROM readers", "town = readers.town"),
    "case": ("SELECT CASE WHEN fee > 1 THEN isbn ELSE reader END AS c FROM loans", "c = loans.fee; c = loans.isbn; c = loans.reader"),
    "window": ("SELECT loan, rank() OVER (PARTITION BY reader ORDER BY fee) AS place FROM loans", "loan = loans.loan; place = loans.reader; place = loans.fee"),
    "aggregate_filter": ("SELECT sum(fee) FILTER (WHERE isbn = 'a') AS s FROM loans", "s = loans.fee; s = loans.isbn"),
    "grouping_sets": ("SELECT reader, isbn, sum(fee) AS s FROM loans GROUP BY GROUPING SETS ((reader), (isbn))", "reader = loans.reader; isbn = loans.isbn; s = loans.fee"),
    "array_functions": ("SELECT transform(array(price), x -> 1) AS a FROM books", "a = books.price"),
    # names
    "by_alias": ("SELECT b.title, w.surname FROM books b JOIN writers w ON b.writer = w.wid", "title = books.title; surname = writers.surname"),
    "only_one_has_it": ("SELECT surname, price FROM books JOIN writers ON writer = wid", "surname = writers.surname; price = books.price"),
    "several_have_it": ("SELECT isbn FROM books JOIN loans ON books.isbn = loans.isbn", "isbn = books.isbn"),
    "nobody_has_it": ("SELECT strange FROM books JOIN writers ON writer = wid", "strange = books.strange"),
    "prefix": ("SELECT ws_new, i_new FROM web_sales JOIN item ON true", "ws_new = web_sales.ws_new; i_new = item.i_new"),
    "unknown_table": ("SELECT x FROM mist", "x = mist.x"),
    "unknown_star": ("SELECT * FROM mist", ""),
    "long_table_name": ("SELECT shelf.box FROM vault.old.shelf", "box = vault.old.shelf.box"),
    "using": ("SELECT town, fee FROM loans JOIN readers USING (reader)", "town = readers.town; fee = loans.fee"),
    "semi_and_anti": ("SELECT title FROM books LEFT SEMI JOIN loans ON books.isbn = loans.isbn", "title = books.title"),
    "no_equality": ("SELECT l.fee, b.price FROM loans l JOIN books b ON l.fee > b.price", "fee = loans.fee; price = books.price"),
    "lateral_view": ("SELECT town, e FROM readers LATERAL VIEW explode(array(1)) v AS e", "town = readers.town; e = readers.e"),
    # nested queries
    "derived": ("SELECT t FROM (SELECT title AS t FROM books) d", "t = books.title"),
    "derived_deep": ("SELECT * FROM (SELECT * FROM (SELECT * FROM readers) a) b", "reader = readers.reader; town = readers.town"),
    "derived_expression": ("SELECT double FROM (SELECT price * 2 AS double FROM books) d", "double = books.price"),
    "values": ("SELECT k FROM (VALUES (1), (2)) v(k)", "k = .k"),
    "union": ("SELECT t FROM (SELECT title AS t FROM books UNION ALL SELECT surname FROM writers) u", "t = books.title"),
    "union_at_top": ("SELECT town FROM readers UNION SELECT surname AS town FROM writers", "town = readers.town; town = writers.surname"),
    "intersect": ("SELECT isbn FROM books INTERSECT SELECT isbn FROM loans", "isbn = books.isbn; isbn = loans.isbn"),
    "with": ("WITH a AS (SELECT isbn, fee FROM loans), b AS (SELECT isbn AS k, fee + 1 AS f FROM a) SELECT k, f FROM b", "k = loans.isbn; f = loans.fee"),
    "with_hides_a_table": ("WITH readers AS (SELECT surname AS town FROM writers) SELECT town FROM readers", "town = writers.surname"),
    "with_unused": ("WITH a AS (SELECT * FROM books), b AS (SELECT * FROM loans) SELECT title FROM a", "title = books.title"),
    "with_joined_stars": ("WITH j AS (SELECT * FROM loans l JOIN books b ON l.isbn = b.isbn) SELECT isbn, title FROM j", "isbn = loans.isbn; title = books.title"),
    # pivots
    "pivot_key": ("SELECT meter FROM meters PIVOT (sum(amount) FOR kind IN ('day', 'night'))", "meter = meters.meter"),
    "pivot_made": ("SELECT day AS d FROM (SELECT kind, amount FROM meters) PIVOT (sum(amount) FOR kind IN ('day', 'night'))", "d = meters.amount"),
    "pivot_of_join": ("SELECT town, day AS d, loan FROM readers r JOIN loans l ON r.reader = l.reader PIVOT (sum(fee) FOR isbn IN ('day', 'night'))", "town = readers.town; d = loans.fee; loan = loans.loan"),
    "pivot_of_two": ("SELECT day_total AS d FROM meters PIVOT (sum(amount) AS total, avg(cost) FOR kind IN ('day' AS day))", "d = meters.amount; d = meters.cost"),
    # targets
    "create": ("CREATE TABLE cheap AS SELECT isbn, price / 2 AS half FROM books", "cheap.isbn = books.isbn; cheap.half = books.price"),
    "create_star": ("CREATE OR REPLACE TABLE copy AS SELECT * FROM readers", "copy.reader = readers.reader; copy.town = readers.town"),
    "create_with": ("WITH b AS (SELECT title FROM books) CREATE TABLE heads AS SELECT title FROM b", "heads.title = books.title"),
    "create_view": ("CREATE VIEW towns AS SELECT town FROM readers", "towns.town = readers.town"),
    "create_then_read": ("CREATE TABLE c AS SELECT * FROM readers; SELECT town FROM c; INSERT INTO fines (loan) SELECT loan FROM loans", "c.reader = readers.reader; c.town = readers.town; town = c.town; fines.loan = loans.loan"),
    "insert_list": ("INSERT INTO fines (loan, sum) SELECT l.loan, l.fee AS sum FROM loans l", "fines.loan = loans.loan; fines.sum = loans.fee"),
    "insert_values": ("INSERT INTO fines VALUES (1, 2)", ""),
    "update": ("UPDATE loans SET fee = fee * 2, reader = 'none'", "loans.fee = loans.fee; loans.reader = ."),
    "broken": ("SELEC town FRM readers", ""),
}

MODAL = {
    "update_from": ("UPDATE loans SET fee = books.price FROM books WHERE loans.isbn = books.isbn", "loans.fee = books.price", "loans.fee = books.price"),
    "update_from_alias": ("UPDATE loans SET fee = b.price FROM books b WHERE loans.isbn = b.isbn", "loans.fee = books.price", "loans.fee = books.price"),
    "update_alias_of_same_name": ("UPDATE loans l SET isbn = b.isbn FROM books b WHERE l.isbn = b.isbn", "loans.isbn = loans.isbn", "loans.isbn = books.isbn"),
    "merge": ("MERGE INTO loans t USING books s ON t.isbn = s.isbn WHEN MATCHED THEN UPDATE SET fee = s.price, isbn = s.isbn WHEN NOT MATCHED THEN INSERT (isbn, fee) VALUES (s.isbn, s.price)", "loans.fee = .price; loans.isbn = loans.isbn", "loans.fee = books.price; loans.isbn = books.isbn"),
    "merge_both_sides": ("MERGE INTO loans t USING books s ON t.isbn = s.isbn WHEN MATCHED THEN UPDATE SET fee = t.fee + s.price", "loans.fee = loans.fee; loans.fee = .price", "loans.fee = loans.fee; loans.fee = books.price"),
    "merge_query": ("MERGE INTO loans USING (SELECT wid AS k, born + 1 AS b FROM writers) q ON reader = k WHEN MATCHED THEN UPDATE SET fee = q.b WHEN NOT MATCHED THEN INSERT (reader) VALUES (k)", "loans.fee = .b; loans.reader = .k", "loans.fee = writers.born; loans.reader = writers.wid"),
    "merge_unknown_source": ("MERGE INTO loans t USING mist m ON t.loan = m.loan WHEN MATCHED THEN UPDATE SET fee = m.fee, reader = haze", "loans.fee = loans.fee; loans.reader = .haze", "loans.fee = mist.fee; loans.reader = mist.haze"),
    "merge_created_source": ("CREATE TABLE news AS SELECT isbn, price AS fee FROM books; MERGE INTO loans t USING news n ON t.isbn = n.isbn WHEN MATCHED THEN UPDATE SET fee = n.fee", "news.isbn = books.isbn; news.fee = books.price; loans.fee = loans.fee", "news.isbn = books.isbn; news.fee = books.price; loans.fee = news.fee"),
    "insert_by_place": ("INSERT INTO fines SELECT isbn, price FROM books", "fines.isbn = books.isbn; fines.price = books.price", "fines.loan = books.isbn; fines.sum = books.price"),
    "insert_list_by_place": ("INSERT INTO fines (sum) SELECT price FROM books", "", "fines.sum = books.price"),
    "scalar": ("SELECT (SELECT max(fee) FROM loans) AS top, town FROM readers", "top = loans.fee; top = readers.fee; town = readers.town", "top = loans.fee; town = readers.town"),
    "with_nested": ("SELECT x FROM (WITH q AS (SELECT box AS x FROM vault.old.shelf) SELECT x FROM q) z", "x = q.x", "x = vault.old.shelf.box"),
    "view_with_list": ("CREATE VIEW v (p, q) AS SELECT isbn, price FROM books", "isbn = books.isbn; price = books.price", "v.p = books.isbn; v.q = books.price"),
}


def lines(text):
    out = set()
    for line in filter(None, (x.strip() for x in text.split(";"))):
        (_, *table, column), source = ["", *line.split(" = ")[0].split(".")], line.split(" = ")[1]
        name, _, own = source.rpartition(".")
        out.add((".".join(table), column, name, own))
    return out


def run(spark, cases, mode):
    catalog = spark.createDataFrame([r for name in cases for r in flatten(TABLES, name)], CATALOG)
    engine = LineageEngine(spark, catalog, mode=mode)
    scripts = spark.createDataFrame([(name, case[0]) for name, case in cases.items()], "file string, text string")
    relations = engine.statements(scripts)
    found = [r.asDict() for r in engine.extract(scripts, relations).collect()]
    return found, {(r["file"], r["stmt"]): r["status"] for r in engine.status(relations).collect()}


@pytest.fixture(scope="module")
def compat(spark):
    return run(spark, CASES | MODAL, "compat")


@pytest.fixture(scope="module")
def resolved(spark):
    return run(spark, CASES | MODAL, "resolved")


def of(found, name):
    return {(r["target_table"] or "", r["target_column"] or "", r["source_table"] or "", r["source_column"] or "") for r in found[0] if r["file"] == name}


@pytest.mark.parametrize("name", CASES)
def test_case(compat, resolved, name):
    assert of(compat, name) == lines(CASES[name][1])
    assert of(resolved, name) == lines(CASES[name][1])


@pytest.mark.parametrize("name", MODAL)
def test_modes(compat, resolved, name):
    assert of(compat, name) == lines(MODAL[name][1])
    assert of(resolved, name) == lines(MODAL[name][2])


def test_status_tells_of_rejected_statements(compat):
    assert compat[1]["broken", 0] != "ok" and compat[1]["columns", 0] == "ok"


def test_expressions_are_the_text_as_written(compat):
    texts = {(r["file"], r["target_column"]): r["expression"] for r in compat[0]}
    assert texts["create", "half"] == "price / 2"
    assert texts["update", "fee"] == "fee * 2"
    assert texts["star", "town"] == "*"


def test_a_mode_is_one_of_two(spark):
    with pytest.raises(ValueError, match="compat, resolved"):
        LineageEngine(spark, mode="other")
