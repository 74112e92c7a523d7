"""Every registered query beside its SQL twin on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from gridcast.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def norm(df: pd.DataFrame) -> list:
    def cell(x):
        if x is None or x != x or x is pd.NA:
            return ""
        return f"{float(x):.6f}" if isinstance(x, float) else str(x)

    columns = sorted(df.columns)
    numeric = {c for c in columns if pd.api.types.is_numeric_dtype(df[c]) and not pd.api.types.is_bool_dtype(df[c])}
    rows = zip(*(df[c].astype("float64") if c in numeric else df[c] for c in columns))
    return [columns, sorted(tuple(map(cell, r)) for r in rows)]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    assert norm(QUERIES[name](spark, SF).toPandas()) == norm(con.execute(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_have_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_scanned_entities_are_the_written_ones(spark):
    got = QUERIES["scan_institution_csv"](spark, SF)
    want = QUERIES["resample_hour"](spark, SF)
    total = lambda df, c: {str(k): float(v) for k, v in df.groupBy(df.columns[0]).sum(c).collect()}
    assert total(got, "n_bytes") == total(want, "nb")
