"""Steps whose cost must grow no faster than their input: how they are dealt out, and what they hold or send."""

import duckdb
import pytest
from pyspark.sql import functions as F

from debuglens.operators import graph, lookup, types
from debuglens.operators.importer import import_files
from debuglens.operators.printing import distinct_types, functions_text, globals_text
from debuglens.plans import catalogue, imports, printing
from debuglens.plans.registry import Bridge
from debuglens.sources import decode, forge, tables
from debuglens.sources.layout import Malformed
from test_queries import rows

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_names_of_types_follow_each_other_in_batches(spark):
    tree = lambda size: f'{{"kind": "struct", "size": {size}}}'
    rows = [(m, f"T{k}", 2 * k + d, f"{d}", tree(4 + d * (k % 2))) for m in (0, 1) for k in range(40) for d in (0, 1)]
    found = types.deduplicated(spark.createDataFrame(rows, "m long, name string, seq long, file string, tree string"), ("m",))
    assert "FlatMapGroups" not in plan(found)
    got = sorted((r["m"], int(r["name"][1:]), r["representative"], r["files"], r["reason"]) for r in found.collect())
    want = [(m, k, 2 * k, ["0", "1"], None) if k % 2 == 0 else None for m in (0, 1) for k in range(40)]
    assert [g for g in got if g[1] % 2 == 0] == [w for w in want if w]
    assert len([g for g in got if g[1] % 2]) == 2 * 20 * 2 and all(g[4] == "differs: size" for g in got if g[1] % 2 and g[2] == 2 * g[1])


@pytest.mark.parametrize("made", [imports._files, printing._files])
def test_forging_is_dealt_out(spark, made):
    assert made(Bridge(spark, SF)).rdd.getNumPartitions() > 1


def test_imports_deal_out_their_joins(spark):
    """Spark guesses the sizes of what Python makes far too small, and would broadcast it."""
    files = imports._files(Bridge(spark, SF))
    db = import_files(files)
    for kind in ("functions", "global_variables", "local_variables", "parameter_variables", "data_types", "source_files", "faults"):
        assert "Broadcast" not in plan(db[kind])
    for made in (functions_text(db), globals_text(db), distinct_types(db)):
        assert "Broadcast" not in plan(made)
    assert "Broadcast" not in plan(imports._with_path(db, "data_types"))


def test_open_ranges_are_dealt_out(spark):
    """Ranges that contain most symbols: no task gives most of the pairs."""
    symbols = spark.range(0, 8192, 1, 1).selectExpr("id AS handle", "id * 64 AS address")
    ranges = spark.range(30).selectExpr("id AS r", "id * 640 AS low", "CAST(NULL AS BIGINT) AS high")
    given = [r["count"] for r in lookup.in_ranges(ranges, symbols).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(given) == sum(8192 - 10 * k for k in range(30)) and 2 * max(given) < sum(given)


def test_few_intervals_go_to_their_probes(spark):
    intervals = spark.createDataFrame([(0, 300, "a"), (400, 600, "b")], "lo_ long, hi_ long, name string")
    found = lookup.interval_join(spark.range(700).selectExpr("id AS at"), intervals, "at", "left")
    assert "Exchange hash" not in plan(found)
    assert {r["name"]: r["count"] for r in found.groupBy("name").count().collect()} == {"a": 300, "b": 200, None: 200}


def beyond(spark, tmp_path, name, keys):
    """Whether a query equals its SQL on parts of the given keys alone."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT k AS p_partkey, 'n' || k % 7 AS p_name, 'Brand#' || k % 3 AS p_brand, 'T' || k % 5 AS p_type, CAST(k % 50 + 1 AS INTEGER) AS p_size FROM ({keys}) t(k)) TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    return rows(catalogue.queries()[name](spark, str(tmp_path)).toPandas()) == rows(con.execute(catalogue.oracle_sql()[name]).df())


def test_keys_beyond_the_bits_of_an_index(spark, tmp_path):
    assert beyond(spark, tmp_path, "a17", "SELECT 1048570 + 3 * i FROM range(9) r(i) UNION ALL SELECT 7199999")


@pytest.mark.parametrize("name", ["import_functions", "import_globals"])
def test_keys_whose_addresses_met_in_other_areas(spark, tmp_path, name):
    assert beyond(spark, tmp_path, name, "SELECT 279616 + i FROM range(64) r(i) UNION ALL SELECT 699008 + i FROM range(128) r(i) UNION ALL SELECT 7199960")


def test_small_rows_are_dealt_out_before_python(spark):
    stabs = spark.range(0, 100, 1, 1).select("id", F.concat(F.lit("T:T(1,"), F.col("id").cast("string"), F.lit(")=s4;")).alias("stab"))
    assert types.trees(stabs).rdd.getNumPartitions() > 1


def test_debug_sections_are_read_as_they_go(spark):
    """Entries are handed on one by one, and built from rows that come one by one."""
    unit = lambda name, children: ("compile_unit", [("name", "string", name)], children)
    data = forge.debug(unit(f"u{k}", (("subroutine", [("name", "string", f"f{k}{j}")], ()) for j in range(3))) for k in range(2))
    assert data == forge.debug([unit(f"u{k}", [("subroutine", [("name", "string", f"f{k}{j}")], []) for j in range(3)]) for k in range(2)])
    read = decode.walked(data + b"\x08\0\0\0\xff\xff\0\0")
    got = [next(read) for _ in range(24)]
    assert [r["depth"] for part, r in got if part == "entry"] == [0, 1, 1, 1] * 2
    with pytest.raises(Malformed):
        next(read)
    bad = tables.decoded(spark.createDataFrame([(1, data), (2, data + b"\x08\0\0\0\xff\xff\0\0")], "k long, content binary"), lambda c: (r for _, r in decode.walked(c)), tables.DIES, strict=False)
    assert {r["k"] for r in bad.collect()} == {1}


def test_bases_are_dealt_out(spark):
    edges = spark.createDataFrame([(k, k // 2, k) for k in range(2, 64)], "type long, base long, base_offset long")
    fields = spark.createDataFrame([(k, 0, 0) for k in range(1, 64)], "type long, ord int, offset long")
    found = graph.flat_fields(edges, fields)
    assert "Broadcast" not in plan(found)
    assert sorted((r["level"], r["offset"]) for r in found.collect() if r["type"] == 63) == [(0, 0), (1, 63), (2, 94), (3, 109), (4, 116), (5, 119)]
