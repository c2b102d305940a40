"""Queries over whole tables against their oracles, on tables beyond the bounds that their namesakes have."""

import os

import duckdb
import pytest

from debuglens.plans import catalogue
from test_queries import rows

SF = "/root/testdata/sf0.01"
#: What only the whole tables have.
BEYOND = {
    "j05_whole": lambda df: (df["type"] > 400).any(),
    "d05_whole": lambda df: ((df["s"] % 11 == 0) & (df["s"] >= 50)).any(),
    "f01_whole": lambda df: (df["text"].str.len() > 120).any(),
}


@pytest.mark.parametrize("name", sorted(BEYOND))
def test_whole_query(spark, name):
    con = duckdb.connect()
    for t in ("part", "supplier", "conversations"):
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    got, want = catalogue.queries()[name](spark, SF).toPandas(), con.execute(catalogue.oracle_sql()[name]).df()
    assert BEYOND[name](got)
    assert rows(got) == rows(want)
