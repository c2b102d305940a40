"""Lookups and changes of the symbol database against plain loops over random rows."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from debuglens.operators import lookup
from debuglens.operators.database import SymbolDb, live_nodes
from debuglens.operators.graph import flat_fields, roots, sizes
from debuglens.operators.passes import duplicate_functions, fake_functions, islands

FUNCTIONS = "handle long, address long, size long, name string"


@pytest.fixture(scope="module")
def tens(spark):
    return spark.createDataFrame([(i, 10 + i, 1, f"f{i}") for i in range(10)], FUNCTIONS)


def random_symbols(seed, n=120, top=4000):
    r = random.Random(seed)
    return [(k, r.choice([None, *[r.randrange(top)] * 9]), r.choice([0, 1, 7, 40, 900, 3000]), f"f{k}") for k in range(n)]


@pytest.mark.parametrize("seed", range(2))
def test_address_ranges(spark, seed):
    """Random ranges, wide and narrow, open and turned round, against a scan of all symbols."""
    r = random.Random(100 + seed)
    symbols = random_symbols(seed)
    ends = lambda: r.choice([None, 0, *[r.randrange(-50, 4100)] * 6])
    ranges = [(k, low := ends(), r.choice([ends(), (low or 0) + r.randrange(30)])) for k in range(200)]
    got = lookup.in_ranges(spark.createDataFrame(ranges, "r long, low long, high long"), spark.createDataFrame(symbols, FUNCTIONS).select("handle", "address"))
    want = [(k, h) for k, low, high in ranges if (low, high) != (None, None) for h, a, _, _ in symbols if a is not None and (low is None or a >= low) and (high is None or a < high)]
    assert sorted((x["r"], x["handle"]) for x in got.collect()) == sorted(want)


@pytest.mark.parametrize("seed", range(2))
def test_overlapping(spark, seed):
    """The nearest start at or below the probe, the last of equal ones, if it reaches over it."""
    symbols = random_symbols(seed)
    probes = list(range(0, 4100, 13))
    want = {}
    for a in probes:
        below = [(x, h, size) for h, x, size, _ in symbols if x is not None and x <= a]
        start, handle, size = max(below, default=(0, None, 0))
        want[a] = handle if handle is not None and a < start + size else None
    got = lookup.overlapping(spark.createDataFrame([(a,) for a in probes], "a long"), spark.createDataFrame(symbols, FUNCTIONS), "a").collect()
    assert {x["a"]: x["handle"] for x in got} == want and len(got) == len(probes)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_points_in_wide_and_narrow_intervals(spark, how):
    """Intervals of very different lengths that overlap each other."""
    r = random.Random(7)
    intervals = [(k, low := r.randrange(100_000), low + r.choice([0, 1, 3, 50, 4000, 90_000])) for k in range(400)]
    points = [(k, r.choice([None, *[r.randrange(110_000)] * 9])) for k in range(300)] + [(1, 5), (1, 5)]
    want = []
    for k, at in points:
        hits = [i for i, low, high in intervals if at is not None and low <= at < high]
        want += [(k, at, i) for i in hits] or ([(k, at, None)] if how == "left" else [])
    got = lookup.interval_join(spark.createDataFrame(points, "k long, at long"), spark.createDataFrame(intervals, "i long, lo_ long, hi_ long"), "at", how)
    assert sorted(((x["k"], x["at"], x["i"]) for x in got.collect()), key=str) == sorted(want, key=str)


def test_overlapping_takes_the_last_of_equal_starts_and_after_the_first(spark):
    symbols = spark.createDataFrame([(1, 8, 4, "x"), (2, 8, 4, "y"), (3, None, 4, "z")], FUNCTIONS)
    probes = spark.createDataFrame([(7,), (9,)], "a long")
    assert {r["a"]: r["name"] for r in lookup.overlapping(probes, symbols, "a").collect()} == {7: None, 9: "y"}
    after = lookup.after(probes, symbols.select("handle", "address"), "a")
    assert {r["a"]: r["handle"] for r in after.collect()} == {7: 1, 9: None}


def test_lookups_in_empty_lists(spark):
    none = spark.createDataFrame([], FUNCTIONS)
    probes = spark.createDataFrame([(7,)], "a long")
    assert [r["name"] for r in lookup.overlapping(probes, none, "a").collect()] == [None]
    assert [r["handle"] for r in lookup.after(probes, none.select("handle", "address"), "a").collect()] == [None]


def test_names_moves_and_renames(spark):
    r = random.Random(3)
    rows = [(k, k * 4, 4, r.choice("pqrstu")) for k in range(40)]
    db = SymbolDb({"functions": spark.createDataFrame(rows, FUNCTIONS)})
    assert {x["name"]: x["n"] for x in lookup.by_name(db["functions"]).collect()} == Counter(n for *_, n in rows)
    moves = {k: r.choice([None, 10_000 + k]) for k in range(0, 40, 3)}
    moved = db.move("functions", spark.createDataFrame(list(moves.items()), "handle long, new_address long"))
    assert {x["handle"]: x["address"] for x in moved["functions"].collect()} == {k: moves.get(k, a) for k, a, _, _ in rows}
    names = {k: f"new{k}" for k in range(1, 40, 5)}
    renamed = db.rename("functions", spark.createDataFrame(list(names.items()), "handle long, new_name string"))
    assert {x["handle"]: x["name"] for x in renamed["functions"].collect()} == {k: names.get(k, n) for k, _, _, n in rows}


def test_merge_joins_sources_of_one_name(spark):
    def db(shift, names):
        return SymbolDb({"symbol_sources": spark.createDataFrame([(shift + k, n) for k, n in enumerate(names)], "handle long, name string"), "functions": spark.createDataFrame([(shift + k, shift + k, f"f{shift + k}") for k in range(len(names))], "handle long, source_handle long, name string")})

    sides = ((0, ["x", "y", "z"]), (10, ["y", "w"]), )
    merged = db(*sides[0]).merge(db(*sides[1]))
    names = {x["handle"]: x["name"] for x in merged["symbol_sources"].collect()}
    assert sorted(names.values()) == ["w", "x", "y", "z"] and names[1] == "y"
    assert {x["name"]: names[x["source_handle"]] for x in merged["functions"].collect()} == {f"f{shift + k}": n for shift, ns in sides for k, n in enumerate(ns)}


def test_destroying_cascades(spark):
    db = SymbolDb(
        {
            "source_files": spark.createDataFrame([(1,), (2,)], "handle long"),
            "functions": spark.createDataFrame([(10, 1), (11, 2)], "handle long, source_file long"),
            "parameter_variables": spark.createDataFrame([(100, 10), (101, 11)], "handle long, function long"),
            "local_variables": spark.createDataFrame([(200, 10), (201, None)], "handle long, function long"),
        }
    )
    after = db.destroy("source_files", spark.createDataFrame([(1,)], "handle long"))
    assert {k: [r["handle"] for r in after[k].collect()] for k in db.tables} == {"source_files": [2], "functions": [11], "parameter_variables": [101], "local_variables": [201]}


def test_node_references_fail_after_a_new_type(spark):
    db = SymbolDb({"functions": spark.createDataFrame([(1, 0), (2, 0)], "handle long, generation int")})
    references = db["functions"].withColumn("node_id", F.lit(7))
    after = db.set_type("functions", spark.createDataFrame([(1,)], "handle long"))
    assert [r["handle"] for r in live_nodes(references, after["functions"]).collect()] == [2]


def test_failed_changes_leave_the_database_alone(spark, tens):
    db = SymbolDb({"functions": tens})
    with pytest.raises(Exception):
        db.create("functions", tens.select("nothing"))
    assert db["functions"].count() == 10


def test_fake_and_duplicate_functions(spark):
    rows = [(1, 8, "a", True), (2, 8, "b", True), (3, 16, "c", True), (4, 16, "d", True), (5, 24, "e", True)]
    functions = spark.createDataFrame(rows, "handle long, address long, name string, in_group boolean")
    externals = spark.createDataFrame([(8, "b")], "address long, name string")
    got = {r["handle"]: r["address"] for r in fake_functions(functions, externals).collect()}
    assert got == {1: None, 2: 8, 3: None, 4: 16, 5: 24}
    twice = functions.withColumn("name", F.lit("x"))
    got = {r["handle"]: r["address"] for r in duplicate_functions(twice, spark.createDataFrame([(4,)], "address long")).collect()}
    assert got == {1: 8, 2: None, 3: 16, 4: None, 5: 24}
    got = {r["handle"]: r["address"] for r in duplicate_functions(twice, spark.createDataFrame([(99,)], "address long")).collect()}
    assert all(got.values())


def test_chains_sizes_and_fields(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(150)] + [(500, 501), (501, 500)], "src long, dst long")
    got = {r["node"]: (r["root"], r["hops"]) for r in roots(chain).collect()}
    assert got[150] == (150, 0) and got[50] == (150, 100) and got[49] == (None, None) and got[500] == (None, None)
    nodes = spark.createDataFrame([(1, 0), (2, 4), (3, None), (4, 0), (5, 8), (6, 1), (7, 1)], "node long, own long")
    edges = spark.createDataFrame([(1, 2), (1, 5), (4, 3), (6, 7), (7, 6)], "parent long, child long")
    assert {r["node"]: r["size"] for r in sizes(nodes, edges).collect()} == {1: 12, 2: 4, 3: None, 4: None, 5: 8, 6: None, 7: None}
    bases = spark.createDataFrame([(1, 2, 16), (2, 3, 4)], "type long, base long, base_offset long")
    fields = spark.createDataFrame([(1, 0, 0), (2, 0, 2), (3, 0, 1)], "type long, ord int, offset long")
    assert sorted((r["level"], r["offset"]) for r in flat_fields(bases, fields).filter("type = 1").collect()) == [(0, 0), (1, 18), (2, 21)]


def test_islands(spark):
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate(["a", "a", None, None, "b", "a"])], "g long, o long, v string")
    assert [r["island"] for r in islands(rows, ["g"], "o", "v").orderBy("o").collect()] == [0, 0, 1, 1, 2, 3]
