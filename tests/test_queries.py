"""Every registered query with an oracle gives the oracle's rows on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from tracewell.queries import ORACLES, QUERIES, TABLES, flagship

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no test data here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> list:
    plain = lambda v: None if pd.isna(v) else (float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v))
    return sorted([tuple(plain(v) for v in row) for row in df[sorted(df.columns)].astype(object).itertuples(index=False)], key=str)


@pytest.mark.parametrize("name", QUERIES)
def test_matches_oracle(spark, duck, name):
    own, other = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(own.columns) == sorted(other.columns)
    assert canonical(own) == canonical(other)


def test_flagship_has_rows(spark, duck):
    assert flagship(spark, SF).count() > 0


def test_recursion_goes_over_the_sessions_limit_of_rows(spark, duck):
    """More rows than the session allows a recursion; the limit holds again afterwards."""
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "100")
    try:
        found = QUERIES["exec_recursive"](spark, SF).toPandas()
        assert spark.conf.get(limit) == "100"
    finally:
        spark.conf.set(limit, before)
    assert canonical(found) == canonical(duck.execute(ORACLES["exec_recursive"]).df())
