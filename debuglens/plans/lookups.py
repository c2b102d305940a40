"""Lookup, join and database queries (D, G, H, K, C rows of the inventory)."""

from __future__ import annotations

from pyspark.sql import functions as F

from debuglens.functions import columns as C
from debuglens.operators import database, lookup, passes
from debuglens.operators.database import SymbolDb
from debuglens.plans.registry import FN, GV, PR, SF, Bridge, query


@query("d01", f"WITH {PR}, {FN} SELECT o, ln, name FROM pr JOIN fn ON part = handle")
def d01(b: Bridge):
    return lookup.by_handle(b.probes, b.functions, "part").select("o", "ln", "name")


LISTS = "lists AS (SELECT l_orderkey AS o, list_append(list(l_partkey ORDER BY l_partkey, l_linenumber), -1) AS hs FROM lineitem GROUP BY l_orderkey)"


@query("d02", f"WITH {LISTS}, {FN}, u AS (SELECT o, unnest(hs) AS handle, unnest(range(0, len(hs))) AS pos FROM lists) SELECT o, CAST(pos AS INTEGER) AS pos, u.handle, name FROM u JOIN fn ON u.handle = fn.handle")
def d02(b: Bridge):
    sorted_ = F.transform(F.array_sort(F.collect_list(F.struct("l_partkey", "l_linenumber"))), lambda s: s["l_partkey"])
    lists = b.table("lineitem").groupBy(F.col("l_orderkey").alias("o")).agg(F.concat(sorted_, F.array(F.lit(-1).cast("long"))).alias("hs"))
    return lookup.by_handle_list(lists, b.functions, "hs").select("o", "pos", "handle", "name")


@query("d03", f"WITH {PR}, {GV} SELECT o, ln, a, handle FROM pr JOIN gv ON a = address")
def d03(b: Bridge):
    return lookup.starting_at(b.probes, b.globals, "a").select("o", "ln", "a", "handle")


def _coarse(b: Bridge):
    return b.functions.withColumn("address", F.floor(F.col("address") / 256) * 256)


@query("d04", f"WITH {FN} SELECT CAST(address // 256 * 256 AS BIGINT) AS address, min(handle) AS handle FROM fn GROUP BY 1")
def d04(b: Bridge):
    return lookup.first_starting_at(_coarse(b))


WHOLE_RANGES = "rg AS (SELECT s_suppkey AS s, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_suppkey * 640 END AS low, CASE WHEN s_suppkey % 11 = 0 THEN NULL WHEN s_suppkey % 5 = 0 THEN s_suppkey * 640 - 10 ELSE s_suppkey * 640 + 2000 END AS high FROM supplier)"


WHOLE = f"WITH {FN}, {WHOLE_RANGES} SELECT s, handle FROM rg JOIN fn ON (low IS NOT NULL OR high IS NOT NULL) AND (low IS NULL OR address >= low) AND (high IS NULL OR address < high)"


@query("d05", WHOLE)
@query("d05_whole", WHOLE)
def d05(b: Bridge):
    """The ranges of all suppliers, open above or below."""
    return _in_ranges(b, b.table("supplier"))


def _in_ranges(b: Bridge, suppliers):
    s = F.col("s_suppkey")
    low = F.when(s % 7 != 0, s * 640)
    high = F.when(s % 11 == 0, None).when(s % 5 == 0, s * 640 - 10).otherwise(s * 640 + 2000)
    ranges = suppliers.select(s.alias("s"), low.alias("low"), high.alias("high"))
    return lookup.in_ranges(ranges, b.functions.select("handle", "address")).select("s", "handle")


@query("d06", f"WITH {PR}, {FN} SELECT o, ln, (SELECT min(p_partkey) FROM part WHERE p_partkey = a // 64 + 1) AS h FROM pr")
def d06(b: Bridge):
    return lookup.after(b.probes, b.functions.select("handle", "address"), "a").select("o", "ln", F.col("handle").alias("h"))


@query("d07", f"WITH {PR}, {FN} SELECT o, ln, CASE WHEN a < address + size THEN handle END AS h FROM pr ASOF LEFT JOIN fn ON a >= address")
def d07(b: Bridge):
    return lookup.overlapping(b.probes, b.functions, "a").select("o", "ln", F.col("handle").alias("h"))


@query("d08", f"WITH {FN} SELECT name, count(*) AS n, min(handle) AS first_handle FROM fn GROUP BY name")
def d08(b: Bridge):
    return lookup.by_name(b.functions)


def _kinds(b: Bridge):
    return {"function": b.functions, "global": b.globals, "file": b.source_files}


KINDS = f"{FN}, {GV}, {SF}, al AS (SELECT 0 AS r, 'function' AS kind, handle, address, size, name FROM fn UNION ALL SELECT 1, 'global', handle, address, size, name FROM gv UNION ALL SELECT 2, 'file', handle, address, size, name FROM sf)"


@query("d09", f"WITH {KINDS} SELECT address, kind, handle FROM (SELECT *, row_number() OVER (PARTITION BY address ORDER BY r, handle) AS k FROM al) q WHERE k = 1")
def d09(b: Bridge):
    return lookup.kind_starting_at(_kinds(b))


@query("d10", f"WITH {KINDS}, {PR}, st AS (SELECT address, kind, handle FROM (SELECT *, row_number() OVER (PARTITION BY address ORDER BY r, handle) AS k FROM al) q WHERE k = 1) SELECT o, ln, kind, handle FROM pr ASOF LEFT JOIN st ON a < address")
def d10(b: Bridge):
    return lookup.kind_after(b.probes, _kinds(b), "a").select("o", "ln", "kind", "handle")


@query("d11", f"""WITH {KINDS}, {PR}, p1 AS (SELECT o, ln, min(a) AS a FROM pr GROUP BY o, ln), h AS (
SELECT o, ln, 0 AS r, 'function' AS kind, handle, a < address + size AS ok FROM p1 ASOF JOIN fn ON a >= address UNION ALL
SELECT o, ln, 1, 'global', handle, a < address + size FROM p1 ASOF JOIN gv ON a >= address UNION ALL
SELECT o, ln, 2, 'file', handle, a < address + size FROM p1 ASOF JOIN sf ON a >= address)
SELECT o, ln, kind, handle FROM (SELECT *, row_number() OVER (PARTITION BY o, ln ORDER BY r) AS k FROM h WHERE ok) q WHERE k = 1""")
def d11(b: Bridge):
    return lookup.kind_overlapping(b.probes.groupBy("o", "ln").agg(F.min("a").alias("a")), _kinds(b), "a", ["o", "ln"])


@query("d12", f"WITH {KINDS} SELECT name, kind, handle FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY r, handle) AS k FROM al) q WHERE k = 1")
def d12(b: Bridge):
    return lookup.kind_with_name(_kinds(b))


@query("d13", f"WITH {FN}, {GV}, x AS (SELECT handle, address // 1280 * 1280 AS a, handle % 3 <> 0 AS creates FROM gv), y AS (SELECT * FROM x WHERE NOT EXISTS (SELECT 1 FROM fn WHERE fn.address = x.a AND fn.handle % 7 = 0)), z AS (SELECT *, min(CASE WHEN creates THEN handle END) OVER (PARTITION BY a) AS f FROM y) SELECT handle, CAST(a AS BIGINT) AS address FROM z WHERE f IS NULL OR handle <= f")
def d13(b: Bridge):
    rows = b.globals.select(F.col("handle").alias("idx"), (F.floor(F.col("address") / 1280) * 1280).alias("address"), (F.col("handle") % 3 != 0).alias("creates"))
    out = passes.symbols_not_yet_there(rows, b.functions.filter("handle % 7 = 0"))
    return out.select(F.col("idx").alias("handle"), "address")


@query("d14", f"WITH {PR}, {SF} SELECT o, ln, CASE WHEN a < address + size AND handle % 2 = 0 THEN 'function' WHEN a < address + size THEN 'global' ELSE 'label' END AS class FROM pr ASOF LEFT JOIN sf ON a >= address")
def d14(b: Bridge):
    sections = b.source_files.withColumn("section", F.when(F.col("handle") % 2 == 0, ".text").otherwise(".data"))
    hit = lookup.overlapping(b.probes, sections.select("handle", "address", "size", "section"), "a")
    return hit.select("o", "ln", F.when(C.contains_code(F.col("section")), "function").when(C.contains_data(F.col("section")), "global").otherwise("label").alias("class"))


@query("d15", f"WITH {FN}, x AS (SELECT p_name AS name, arg_max(p_partkey * 8, p_partkey) AS address FROM part WHERE p_partkey % 3 = 0 GROUP BY p_name) SELECT fn.handle, fn.name, x.address FROM fn LEFT JOIN x ON fn.name = x.name")
def d15(b: Bridge):
    external = passes.last_of(b.functions.filter("handle % 3 = 0").select("name", "handle", (F.col("handle") * 8).alias("address")), ["name"], "handle", "address")
    return b.functions.select("handle", "name").join(external, "name", "left")


@query("d16", """WITH r AS (SELECT p_partkey AS ref, p_partkey % 10 AS file, CASE WHEN p_partkey % 2 = 0 THEN p_partkey + p_partkey % 3 * 10 ELSE -p_partkey END AS number, CASE WHEN p_partkey % 4 = 1 THEN p_name ELSE 'missing' || (p_partkey % 50) END AS name, p_partkey % 8 = 3 AS is_this FROM part),
n AS (SELECT p_partkey % 10 AS file, p_partkey AS number, p_partkey * 2 AS handle FROM part), t AS (SELECT p_name AS name, min(p_partkey) AS m FROM part GROUP BY p_name)
SELECT ref, CASE WHEN handle IS NOT NULL THEN 1 WHEN m IS NOT NULL THEN 2 WHEN is_this THEN 3 ELSE 4 END AS tier, coalesce(handle, m) AS target FROM r LEFT JOIN n ON r.file = n.file AND r.number = n.number LEFT JOIN t ON r.name = t.name""")
def d16(b: Bridge):
    h = F.col("handle")
    name = F.when(h % 4 == 1, F.col("name")).otherwise(F.concat(F.lit("missing"), (h % 50).cast("string")))
    refs = b.functions.select(h.alias("ref"), (h % 10).alias("file"), F.when(h % 2 == 0, h + h % 3 * 10).otherwise(-h).alias("number"), name.alias("name"), (h % 8 == 3).alias("is_this"))
    numbers = b.functions.select((h % 10).alias("file"), h.alias("number"), (h * 2).alias("handle"))
    return passes.resolve_type_names(refs, numbers, b.functions.select("handle", "name")).select("ref", "tier", "target")


@query("d17", """WITH d AS (SELECT p_partkey AS fn, p_brand || '::f' || p_size AS name FROM part), s AS (SELECT fn, split_part(name, '::', 1) AS ty, split_part(name, '::', 2) AS f FROM d),
m AS (SELECT p_brand AS ty, 'f' || p_size AS f, min(p_partkey) AS decl FROM part WHERE p_partkey % 2 = 0 GROUP BY 1, 2) SELECT fn, decl FROM s JOIN m ON s.ty = m.ty AND s.f = m.f""")
def d17(b: Bridge):
    part = b.table("part")
    defs = part.select(F.col("p_partkey").alias("fn"), F.concat("p_brand", F.lit("::f"), F.col("p_size").cast("string")).alias("name"))
    pieces = defs.select("fn", F.regexp_extract("name", r"^(?:.*::)?(.*?)::([^:]*)$", 1).alias("ty"), F.regexp_extract("name", r"^(?:.*::)?(.*?)::([^:]*)$", 2).alias("f"))
    decls = part.filter("p_partkey % 2 = 0").groupBy(F.col("p_brand").alias("ty"), F.concat(F.lit("f"), F.col("p_size").cast("string")).alias("f")).agg(F.min("p_partkey").alias("decl"))
    return pieces.join(decls, ["ty", "f"]).select("fn", "decl")


@query("d18", "SELECT p_brand AS cls, arg_max(p_size, p_partkey) AS file FROM part GROUP BY p_brand")
def d18(b: Bridge):
    return passes.last_of(b.table("part").select(F.col("p_brand").alias("cls"), "p_partkey", F.col("p_size").alias("file")), ["cls"], "p_partkey", "file")


@query("d19", f"WITH {FN}, {GV}, p AS (SELECT l_orderkey AS o, l_linenumber AS ln, CASE WHEN l_orderkey % 9 = 0 THEN 0 ELSE l_suppkey * 64 + l_orderkey % 2 END AS p FROM lineitem) SELECT o, ln, CASE WHEN p = 0 THEN 'NULL' WHEN fn.name IS NOT NULL THEN '&' || fn.name WHEN gv.name IS NOT NULL AND gv.handle % 2 = 0 THEN gv.name WHEN gv.name IS NOT NULL THEN '&' || gv.name ELSE '0x' || lower(to_hex(p)) END AS text FROM p LEFT JOIN fn ON p = fn.address AND fn.handle % 4 = 0 LEFT JOIN gv ON p = gv.address")
def d19(b: Bridge):
    p = F.when(F.col("l_orderkey") % 9 == 0, 0).otherwise(F.col("l_suppkey") * 64 + F.col("l_orderkey") % 2)
    pointers = b.table("lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("ln"), p.cast("long").alias("p"))
    fn = lookup.first_starting_at(b.functions.filter("handle % 4 = 0")).join(b.functions.select("handle", F.col("name").alias("f")), "handle").select(F.col("address").alias("p"), "f")
    gv = b.globals.select(F.col("address").alias("p"), F.col("name").alias("g"), (F.col("handle") % 2 == 0).alias("is_array"))
    text = F.when(F.col("p") == 0, "NULL").when(F.col("f").isNotNull(), F.concat(F.lit("&"), "f")).when(F.col("is_array"), F.col("g")).when(F.col("g").isNotNull(), F.concat(F.lit("&"), "g")).otherwise(F.concat(F.lit("0x"), C.hex_plain(F.col("p"))))
    return pointers.join(fn, "p", "left").join(gv, "p", "left").select("o", "ln", text.alias("text"))


@query("d20", f"WITH {SF}, {GV} SELECT gv.name AS section, sf.name AS file FROM gv JOIN sf ON sf.address >= gv.address AND sf.address < gv.address + 50000")
def d20(b: Bridge):
    sections = b.globals.select(F.col("name").alias("section"), F.col("address").alias("from"))
    files = b.source_files.select(F.col("name").alias("file"), "address")
    return lookup.contained(files, sections, "address", F.col("from"), F.col("from") + 50000).select("section", "file")


@query("d22", f"WITH {FN} SELECT handle, CAST(row_number() OVER (ORDER BY handle) - 1 AS BIGINT) AS idx FROM fn WHERE handle % 3 <> 0")
def d22(b: Bridge):
    return lookup.dense_index(b.functions.filter("handle % 3 <> 0")).select("handle", F.col("idx").cast("long").alias("idx"))


@query("d23", f"WITH {FN} SELECT fn.handle, s_name AS body FROM fn LEFT JOIN supplier ON fn.address = s_suppkey * 640")
def d23(b: Bridge):
    bodies = b.table("supplier").select((F.col("s_suppkey") * 640).alias("address"), F.col("s_name").alias("body"))
    return b.functions.join(bodies, "address", "left").select("handle", "body")


@query("d24", "SELECT l_partkey AS member, max(l_orderkey) AS owner FROM lineitem GROUP BY l_partkey")
def d24(b: Bridge):
    owners = b.table("lineitem").groupBy(F.col("l_orderkey").alias("handle")).agg(F.collect_list("l_partkey").alias("members"))
    return database.derived_owner(owners, "members")


@query("d25", "SELECT DISTINCT c_name AS file, o_orderstatus AS sub FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus <> substr(c_mktsegment, 1, 1)")
def d25(b: Bridge):
    files = b.table("orders").groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("subs"))
    rows = b.table("customer").join(files, F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_name").alias("file"), F.substring("c_mktsegment", 1, 1).alias("own"), F.explode("subs").alias("sub"))
    return rows.filter("sub <> own").select("file", "sub")


@query("d26", "SELECT a.n_nationkey AS die, b.n_name AS name FROM nation a JOIN nation b ON b.n_nationkey = a.n_regionkey")
def d26(b: Bridge):
    dies = b.table("nation")
    return dies.select(F.col("n_nationkey").alias("die"), "n_regionkey").join(dies.select(F.col("n_nationkey").alias("n_regionkey"), F.col("n_name").alias("name")), "n_regionkey").select("die", "name")


# Sorts and limits.


@query("g01", f"WITH {FN} SELECT handle, address FROM fn ORDER BY address DESC, handle LIMIT 100")
def g01(b: Bridge):
    return b.functions.orderBy(F.desc("address"), "handle").limit(100).select("handle", "address")


@query("g02", f"WITH {FN} SELECT handle, name FROM fn ORDER BY handle")
def g02(b: Bridge):
    return b.functions.orderBy("handle").select("handle", "name")


@query("g04", "SELECT file, h FROM (SELECT p_brand AS file, p_partkey AS h, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part) q WHERE k <= 10")
def g04(b: Bridge):
    return passes.capped_warnings(b.functions.select("file", F.col("handle").alias("h")), "file", "h")


@query("g05", "SELECT p_brand AS file, min(p_partkey) AS h FROM part GROUP BY p_brand")
def g05(b: Bridge):
    return passes.first_of(b.functions.select("file", "handle", F.col("handle").alias("h")), ["file"], "handle", "h")


# Set operations and changes.


def _db(b: Bridge, keep: str = "true") -> SymbolDb:
    sources = b.table("region").selectExpr("CAST(r_regionkey AS BIGINT) AS handle", "r_name AS name")
    files = b.source_files.filter(keep)
    functions = b.functions.filter(keep).withColumn("source_file", F.col("handle") % 25)
    globals_ = b.globals.filter(keep).withColumn("source_file", F.col("handle") % 25)
    parameters = b.table("lineitem").groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("handle")).agg(F.min("l_partkey").alias("function")).withColumn("source_handle", F.col("function") % 5).filter(keep)
    return SymbolDb({"functions": functions, "global_variables": globals_, "source_files": files, "parameter_variables": parameters, "symbol_sources": sources})


@query("h01", f"WITH {FN} SELECT handle, source_handle FROM fn")
def h01(b: Bridge):
    left, right = _db(b, "handle % 2 = 0"), _db(b, "handle % 2 = 1")
    other = right.with_table("symbol_sources", right["symbol_sources"].withColumn("handle", F.col("handle") + 100))
    other = other.with_table("functions", other["functions"].withColumn("source_handle", F.col("source_handle") + 100))
    return left.merge(SymbolDb({k: other[k] for k in ("functions", "symbol_sources")}))["functions"].select("handle", "source_handle")


@query("h02", "SELECT name, CAST(handle AS BIGINT) AS handle FROM (SELECT r_name AS name, r_regionkey AS handle FROM region UNION ALL SELECT name, 99 + row_number() OVER (ORDER BY name) FROM (SELECT DISTINCT p_brand AS name FROM part) q) z")
def h02(b: Bridge):
    return _db(b).get_or_create_sources(b.functions.select(F.col("file").alias("name")).unionByName(b.table("region").select(F.col("r_name").alias("name"))), 100)["symbol_sources"].select("name", "handle")


@query("h03", f"WITH {FN} SELECT handle FROM fn WHERE source_handle <> 3")
def h03(b: Bridge):
    return _db(b).destroy_from("source_handle", 3)["functions"].select("handle")


@query("h04", f"WITH {FN} SELECT handle FROM fn WHERE source_handle IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%')")
def h04(b: Bridge):
    chosen = b.table("region").filter("r_name LIKE 'A%'").select(F.col("r_regionkey").cast("long").alias("source_handle"))
    return b.functions.join(chosen, "source_handle", "left_semi").select("handle")


@query("h05", "SELECT DISTINCT p_type AS value FROM part")
def h05(b: Bridge):
    return b.table("part").select(F.col("p_type").alias("value")).distinct()


@query("k01", f"WITH {FN} SELECT handle, address FROM fn UNION ALL SELECT handle + 1000000, CASE WHEN handle % 2 = 0 THEN address + 4096 END FROM fn")
def k01(b: Bridge):
    new = b.functions.withColumn("handle", F.col("handle") + 1_000_000).withColumn("address", F.when(F.col("handle") % 2 == 0, F.col("address")))
    return SymbolDb({"functions": b.functions}).create("functions", new, F.lit(4096))["functions"].select("handle", "address")


@query("k02", f"WITH {FN} SELECT handle, CASE WHEN handle % 10 = 0 THEN NULL WHEN handle % 10 = 1 THEN address + 8 ELSE address END AS address FROM fn")
def k02(b: Bridge):
    moves = b.functions.filter("handle % 10 < 2").select("handle", F.when(F.col("handle") % 10 == 1, F.col("address") + 8).alias("new_address"))
    return _db(b).move("functions", moves)["functions"].select("handle", "address")


@query("k03", f"WITH {FN} SELECT handle, CASE WHEN handle % 10 = 0 THEN 'new' || handle ELSE name END AS name FROM fn")
def k03(b: Bridge):
    names = b.functions.filter("handle % 10 = 0").select("handle", F.concat(F.lit("new"), F.col("handle").cast("string")).alias("new_name"))
    return _db(b).rename("functions", names)["functions"].select("handle", "name")


@query("k04", "SELECT handle FROM (SELECT l_orderkey * 10 + l_linenumber AS handle, min(l_partkey) AS f FROM lineitem GROUP BY 1) q WHERE (f % 25) % 2 = 1 OR NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = f)")
def k04(b: Bridge):
    return _db(b).destroy("source_files", b.source_files.filter("handle % 2 = 0"))["parameter_variables"].select("handle")


@query("k05", f"WITH {FN}, {GV}, {SF} SELECT 'functions' AS kind, count(*) AS n FROM fn WHERE source_handle <> 1 UNION ALL SELECT 'global_variables', count(*) FROM gv WHERE source_handle <> 1 UNION ALL SELECT 'source_files', count(*) FROM sf WHERE source_handle <> 1 UNION ALL SELECT 'parameter_variables', count(*) FROM (SELECT min(l_partkey) AS f FROM lineitem GROUP BY l_orderkey * 10 + l_linenumber) q WHERE f % 5 <> 1 UNION ALL SELECT 'symbol_sources', count(*) FROM region")
def k05(b: Bridge):
    return _db(b).destroy_from("source_handle", 1, cascade=False).counts()


@query("k06", f"WITH {KINDS} SELECT kind, handle, CASE WHEN kind = 'global' THEN address + 1 ELSE address END AS address FROM al")
def k06(b: Bridge):
    every = lookup.union_of(_kinds(b))
    return every.select("kind", "handle", F.when(F.col("kind") == "global", F.col("address") + 1).otherwise(F.col("address")).alias("address"))


@query("k07", f"WITH {FN} SELECT handle, CAST(CASE WHEN handle % 4 = 0 THEN 1 ELSE 0 END AS INTEGER) AS generation FROM fn")
def k07(b: Bridge):
    db = SymbolDb({"functions": b.functions.withColumn("generation", F.lit(0))})
    return db.set_type("functions", b.functions.filter("handle % 4 = 0"))["functions"].select("handle", "generation")


@query("k08", f"WITH {FN} SELECT count(*) AS n FROM fn")
def k08(b: Bridge):
    """An import that fails leaves the database as it was: the new one is only put in place when it is whole."""
    before = SymbolDb({"functions": b.functions})
    after = before
    try:
        after = before.create("functions", b.functions.select("no_such_column"))
    except Exception:
        after = before
    return after["functions"].agg(F.count("*").alias("n"))


@query("k09", f"WITH {FN} SELECT handle FROM fn WHERE handle % 10 <> 0")
def k09(b: Bridge):
    return b.functions.withColumn("address", F.when(F.col("handle") % 10 != 0, F.col("address"))).filter("address IS NOT NULL").select("handle")


@query("k10", "SELECT p_name AS name, p_partkey AS handle FROM part")
def k10(b: Bridge):
    return SymbolDb({}).create("data_types", b.functions.select("name", "handle"))["data_types"]


@query("c01", "SELECT s_suppkey AS h FROM supplier WHERE s_suppkey % 7 <> 0 AND s_nationkey % 4 = 0")
def c01(b: Bridge):
    rows = b.table("supplier").selectExpr("s_suppkey AS h", "s_suppkey % 7 AS address", "s_nationkey AS other")
    return rows.filter((F.col("address") != 0) & (F.col("other").bitwiseAND(F.lit(3)) == 0)).select("h")


@query("c02", "SELECT p_partkey AS h, CASE WHEN p_partkey % 6 = 0 THEN 'label' WHEN p_partkey % 6 = 1 AND p_size % 3 <> 0 THEN 'global' WHEN p_partkey % 6 = 1 THEN 'label' WHEN p_partkey % 6 = 2 THEN 'function' WHEN p_partkey % 6 = 4 THEN 'file' END AS goes FROM part WHERE p_partkey % 6 IN (0, 1, 2, 4)")
def c02(b: Bridge):
    rows = b.table("part").select(F.col("p_partkey").alias("h"), passes.route_elf_symbol(F.col("p_partkey") % 6, F.col("p_size") % 3).alias("goes"))
    return rows.filter("goes IS NOT NULL")


@query("c05", "SELECT p_partkey AS h, p_partkey * 8 + CASE WHEN p_size % 2 = 0 THEN 0 ELSE 65536 END AS address FROM part WHERE p_size % 5 <> 0")
def c05(b: Bridge):
    part = b.table("part").filter("p_size % 5 <> 0")
    return part.select(F.col("p_partkey").alias("h"), (F.col("p_partkey") * 8 + F.when(F.col("p_size") % 2 == 0, 0).otherwise(65536)).alias("address"))


@query("c06", f"WITH {FN} SELECT handle FROM fn WHERE source_handle = 2")
def c06(b: Bridge):
    rows = b.functions
    return rows.filter(database.in_group(F.lit(2), F.lit(None), rows)).select("handle")


@query("c07", "SELECT n_nationkey AS h, n_nationkey % 2 = 0 AS code, n_nationkey % 2 = 1 AND n_nationkey % 3 = 0 AS data FROM nation")
def c07(b: Bridge):
    name = F.when(F.col("n_nationkey") % 2 == 0, ".text").when(F.col("n_nationkey") % 3 == 0, ".sdata").otherwise(".comment")
    return b.table("nation").select(F.col("n_nationkey").alias("h"), C.contains_code(name).alias("code"), C.contains_data(name).alias("data"))


@query("c09", "SELECT p_name AS name, arg_max(p_size, p_partkey) AS value FROM part WHERE p_partkey % 3 = 1 GROUP BY p_name")
def c09(b: Bridge):
    rows = b.table("part").filter("p_partkey % 3 = 1").select(F.col("p_name").alias("name"), "p_partkey", F.col("p_size").alias("value"))
    return passes.last_of(rows, ["name"], "p_partkey", "value")


@query("c19", "SELECT p_partkey AS h FROM (SELECT *, bool_and(p_size % 2 = 0) OVER (PARTITION BY p_name) AS all_special FROM part) q WHERE NOT all_special")
def c19(b: Bridge):
    from pyspark.sql import Window

    special = F.col("p_size") % 2 == 0
    rows = b.table("part").withColumn("all_", F.bool_and(special).over(Window.partitionBy("p_name")))
    return rows.filter(~F.col("all_")).select(F.col("p_partkey").alias("h"))


@query("c22", "SELECT p_partkey AS h, CASE WHEN p_size % 3 <> 1 THEN 'lost+found' WHEN p_size % 2 = 0 THEN 'source' ELSE 'header' END AS goes FROM part")
def c22(b: Bridge):
    rows = b.table("part")
    return rows.select(F.col("p_partkey").alias("h"), F.when(F.col("p_size") % 3 != 1, "lost+found").when(F.col("p_size") % 2 == 0, "source").otherwise("header").alias("goes"))


@query("c23", "SELECT l_orderkey AS o, l_linenumber AS ln, CASE WHEN l_linenumber % 3 = 0 THEN l_returnflag WHEN l_linenumber % 3 = 1 THEN l_linestatus ELSE '' END AS name, CASE WHEN l_linenumber % 2 = 0 THEN l_partkey - l_suppkey END AS size FROM lineitem")
def c23(b: Bridge):
    ln = F.col("l_linenumber")
    mangled, name, high = F.when(ln % 3 == 0, F.col("l_returnflag")), F.when(ln % 3 == 1, F.col("l_linestatus")), F.when(ln % 2 == 0, F.col("l_partkey"))
    return b.table("lineitem").select(F.col("l_orderkey").alias("o"), ln.alias("ln"), F.coalesce(mangled, name, F.lit("")).alias("name"), (high - F.col("l_suppkey")).alias("size"))


@query("c24", f"WITH {FN} SELECT handle, address AS low, coalesce(address, 0) + size AS high FROM fn")
def c24(b: Bridge):
    return b.functions.select("handle", F.col("address").alias("low"), (C.or_zero(F.col("address")) + F.col("size")).alias("high"))
