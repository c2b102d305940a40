"""Every registered query of the symbol engine against its oracle, on the smallest tables."""

import os

import duckdb
import pytest

from debuglens.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def rows(df):
    def plain(v):
        if v is None or v != v:
            return None
        return float(f"{v:.9g}") if isinstance(v, float) else int(v) if hasattr(v, "__index__") and not isinstance(v, bool) else v

    df = df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None)
    return sorted(repr(tuple(float(x) if isinstance(x, int) and not isinstance(x, bool) else x for x in map(plain, r))) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, oracle, name):
    got, want = catalogue.queries()[name](spark, SF).toPandas(), oracle.execute(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_flagship(spark):
    df = catalogue.flagship(spark, SF)
    assert df.columns == ["o", "ln", "a", "function", "name", "n"] and df.count() > 0
