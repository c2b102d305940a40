"""Aggregates, order-dependent passes and recursion (E, F, J rows of the inventory)."""

from __future__ import annotations

from pyspark.sql import functions as F

from debuglens.operators import graph, passes
from debuglens.plans.registry import FN, GV, OP, SF, Bridge, query


def _kinds(b: Bridge):
    return {"function": b.functions, "global": b.globals, "file": b.source_files}


@query("e01", f"WITH {FN}, {GV}, {SF} SELECT CAST((SELECT count(*) FROM fn) + (SELECT count(*) FROM gv) + (SELECT count(*) FROM sf) AS BIGINT) AS n")
def e01(b: Bridge):
    from debuglens.operators.database import SymbolDb

    return SymbolDb(_kinds(b)).counts().agg(F.sum("n").alias("n"))


@query("e02", f"WITH {FN}, {GV}, {SF} SELECT 'function' AS kind, count(*) AS n, count(*) = 0 AS is_empty FROM fn UNION ALL SELECT 'global', count(*), count(*) = 0 FROM gv UNION ALL SELECT 'file', count(*), count(*) = 0 FROM sf")
def e02(b: Bridge):
    from debuglens.operators.database import SymbolDb

    return SymbolDb(_kinds(b)).counts().withColumn("is_empty", F.col("n") == 0)


HASH = f'WITH {OP} SELECT "user", CAST(list_reduce(list_prepend(CAST(0 AS HUGEINT), list(CAST(opcode AS HUGEINT) ORDER BY seq)), lambda h, x: (h * 31 + x) % 4294967296) AS BIGINT) AS hash FROM op GROUP BY "user"'


@query("e03", HASH)
def e03(b: Bridge):
    return passes.opcode_hash(b.opcodes, "user", "seq", "opcode")


@query("e03_combined", HASH)
def e03_combined(b: Bridge):
    return passes.opcode_hash(b.opcodes, "user", "seq", "opcode", 1000)


@query("e04", "SELECT p_brand AS source_file, count(*) FILTER (WHERE p_size % 7 <> 0 AND p_size % 2 = 0) >= count(*) FILTER (WHERE p_size % 7 <> 0 AND p_size % 2 <> 0) AS matches FROM part GROUP BY p_brand")
def e04(b: Bridge):
    size = F.col("p_size")
    rows = b.table("part").select(F.col("p_brand").alias("source_file"), F.when(size % 7 == 0, 0).otherwise(5).alias("original_hash"), F.when(size % 2 == 0, 5).otherwise(6).alias("current_hash"))
    return passes.functions_match(rows)


@query("e05", "SELECT f.kind, count(p_partkey) AS n FROM (VALUES ('ELF', 0), ('SNDLL', 1), ('mdebug', 2), ('never', 9), ('unknown', 3)) f(kind, k) LEFT JOIN part ON p_partkey % 4 = k GROUP BY f.kind")
def e05(b: Bridge):
    formats = b.spark.createDataFrame([("ELF", 0), ("SNDLL", 1), ("mdebug", 2), ("never", 9), ("unknown", 3)], "kind string, k long")
    counts = b.table("part").groupBy((F.col("p_partkey") % 4).alias("k")).count()
    return formats.join(counts, "k", "left").select("kind", F.coalesce("count", F.lit(0)).alias("n"))


@query("e06", "SELECT DISTINCT o_orderpriority AS value FROM orders ORDER BY 1")
def e06(b: Bridge):
    return b.table("orders").select(F.col("o_orderpriority").alias("value")).distinct().orderBy("value")


@query("e07", "SELECT DISTINCT CASE WHEN p_size % 2 = 0 THEN p_type ELSE 'unknown' END AS value FROM part")
def e07(b: Bridge):
    files = b.table("part").select(F.when(F.col("p_size") % 2 == 0, F.array("p_type")).otherwise(F.array().cast("array<string>")).alias("info"))
    return files.select(F.explode_outer("info").alias("v")).select(F.coalesce("v", F.lit("unknown")).alias("value")).distinct()


@query("e08", "SELECT DISTINCT p_type AS name, p_brand AS class FROM part")
def e08(b: Bridge):
    return b.table("part").select(F.col("p_type").alias("name"), F.col("p_brand").alias("class")).distinct()


CHAIN = "SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey // 2 > 0 AND p_partkey % 5 <> 3"
REACH = f"WITH RECURSIVE ed AS ({CHAIN}), r(node, target, hops) AS (SELECT p_partkey, p_partkey, 0 FROM part UNION ALL SELECT r.node, ed.dst, r.hops + 1 FROM r JOIN ed ON r.target = ed.src WHERE r.hops < 30)"


def _chain(b: Bridge):
    key = F.col("p_partkey")
    return b.table("part").filter((F.floor(key / 2) > 0) & (key % 5 != 3)).select(key.alias("src"), F.floor(key / 2).cast("long").alias("dst"))


@query("e09", f"{REACH} SELECT target AS type, p_brand AS file, count(*) AS n FROM r JOIN part ON p_partkey = node WHERE hops > 0 GROUP BY 1, 2")
def e09(b: Bridge):
    """References to each type from each file, through chains of type names."""
    files = b.table("part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("file"))
    return graph.reach_counts(_chain(b), files, "file", 30).withColumnRenamed("node", "type")


@query("e10", f"{REACH}, c AS (SELECT target AS type, p_brand AS file, count(*) AS n FROM r JOIN part ON p_partkey = node WHERE hops > 0 GROUP BY 1, 2) SELECT type, file, n FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY n DESC, file) AS k FROM c) q WHERE k = 1")
def e10(b: Bridge):
    return passes.best_file(e09(b).withColumn("pos", F.col("file")))


@query("e11", "WITH x AS (SELECT user_id, event_id, event_type, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS c FROM events), y AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS g FROM x) SELECT user_id AS module, CAST(g AS BIGINT) AS grp, min(event_id) AS lo, max(event_id) AS hi FROM y GROUP BY 1, 2")
def e11(b: Bridge):
    """Consecutive units of one name merge into one with the extent of all."""
    rows = passes.islands(b.table("events").select(F.col("user_id").alias("module"), "event_id", "event_type"), ["module"], "event_id", "event_type")
    return rows.groupBy("module", F.col("island").cast("long").alias("grp")).agg(F.min("event_id").alias("lo"), F.max("event_id").alias("hi"))


@query("e12", "SELECT p_name AS name, count(DISTINCT p_type || p_size % 3) AS shapes, count(DISTINCT p_brand) AS files FROM part GROUP BY p_name")
def e12(b: Bridge):
    """Types of one name and shape merge and gather their files; each further shape of a name is a type of its own."""
    shape = F.xxhash64("p_type", F.col("p_size") % 3)
    merged = b.table("part").groupBy(F.col("p_name").alias("name"), shape.alias("shape")).agg(F.collect_set("p_brand").alias("files"))
    return merged.groupBy("name").agg(F.count("*").alias("shapes"), F.size(F.array_distinct(F.flatten(F.collect_list("files")))).cast("long").alias("files"))


@query("e14", "SELECT l_orderkey AS o, l_linenumber AS ln, CAST(list_min(list_filter([l_partkey % 3 - 1, l_suppkey % 5 - 2, l_linenumber - 3], lambda v: v > 0)) AS BIGINT) AS least FROM lineitem")
def e14(b: Bridge):
    """The least of the positive offsets."""
    positive = [F.nullif(F.greatest(c.cast("long"), F.lit(0)), F.lit(0)) for c in (F.col("l_partkey") % 3 - 1, F.col("l_suppkey") % 5 - 2, F.col("l_linenumber") - 3)]
    return b.table("lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("ln"), F.least(*positive).alias("least"))


@query("e15", f"WITH {GV} SELECT gv.handle, coalesce(CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS BIGINT) END, gv.size) AS size FROM gv LEFT JOIN part ON p_partkey = gv.handle")
def e15(b: Bridge):
    """A variable takes its type's size where that is known."""
    types = b.table("part").select(F.col("p_partkey").alias("handle"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_size").cast("long")).alias("type_size"))
    return b.globals.join(types, "handle", "left").select("handle", F.coalesce("type_size", "size").alias("size"))


CONTINUED = "WITH x AS (SELECT conv_id AS file, turn, CASE WHEN turn % 3 <> 2 THEN coalesce(text, '') || chr(92) ELSE coalesce(text, '') END AS t FROM conversations), y AS (SELECT *, CASE WHEN coalesce(lag(t LIKE '%' || chr(92)) OVER (PARTITION BY file ORDER BY turn), false) THEN 0 ELSE 1 END AS s FROM x), z AS (SELECT *, sum(s) OVER (PARTITION BY file ORDER BY turn) AS seg FROM y) SELECT file, CAST(seg AS BIGINT) AS seg, string_agg(rtrim(t, chr(92)), '' ORDER BY turn) AS text FROM z GROUP BY file, seg"


@query("f01", CONTINUED)
@query("f01_whole", CONTINUED)
def f01(b: Bridge):
    """Whole turns, however long they are."""
    return _continued(b, F.coalesce("text", F.lit("")))


def _continued(b: Bridge, text):
    lines = b.table("conversations").select(F.col("conv_id").alias("file"), "turn", F.when(F.col("turn") % 3 != 2, F.concat(text, F.lit("\\"))).otherwise(text).alias("t"))
    return passes.continued(lines, "file", "turn", "t").select("file", F.col("seg").cast("long").alias("seg"), "text")


@query("f02", "SELECT user_id AS file, event_id AS seq, max(CASE WHEN event_id % 50 = 7 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) = 0 AS strict FROM events")
def f02(b: Bridge):
    """A truncated symbol ends strict mode for the rest of its file."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return b.table("events").select(F.col("user_id").alias("file"), F.col("event_id").alias("seq"), (F.max((F.col("event_id") % 50 == 7).cast("int")).over(w) == 0).alias("strict"))


@query("f03", "SELECT p_partkey AS h, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) > 1 AS duplicate FROM part")
def f03(b: Bridge):
    """Of the definitions of a type number in a file the first one counts."""
    from pyspark.sql import Window

    w = Window.partitionBy("p_brand", "p_size").orderBy("p_partkey")
    return b.table("part").select(F.col("p_partkey").alias("h"), (F.row_number().over(w) > 1).alias("duplicate"))


@query("f04", "WITH f AS (SELECT p_partkey AS h, (p_partkey % 700) * 8 AS a, p_name AS name, p_partkey % 5 <> 0 AS g FROM part), e AS (SELECT (p_partkey % 700) * 8 AS a, min(p_name) AS x FROM part WHERE p_partkey % 3 = 0 GROUP BY 1), j AS (SELECT f.*, coalesce(x = name, false) AS m FROM f LEFT JOIN e ON f.a = e.a), w AS (SELECT *, count(*) OVER (PARTITION BY a) AS n, bool_or(m OR NOT g) OVER (PARTITION BY a) AS keep, row_number() OVER (PARTITION BY a, g ORDER BY h DESC) AS rn FROM j) SELECT h AS handle, CASE WHEN g AND n > 1 AND NOT m AND (keep OR rn > 1) THEN NULL ELSE a END AS address FROM w")
def f04(b: Bridge):
    functions = b.table("part").select(F.col("p_partkey").alias("handle"), (F.col("p_partkey") % 700 * 8).alias("address"), F.col("p_name").alias("name"), (F.col("p_partkey") % 5 != 0).alias("in_group"))
    externals = functions.filter("handle % 3 = 0").groupBy("address").agg(F.min("name").alias("name"))
    return passes.fake_functions(functions, externals).select("handle", "address")


@query("f06", "WITH f AS (SELECT p_partkey AS h, (p_partkey % 300) * 8 AS a, p_brand AS name, p_partkey % 5 <> 0 AS g FROM part), w AS (SELECT *, row_number() OVER (PARTITION BY a, name, g ORDER BY h) AS rn, (SELECT min(s_suppkey * 64) FROM supplier) AS least FROM f) SELECT h AS handle, CASE WHEN g AND rn > 1 AND a > least THEN NULL ELSE a END AS address FROM w")
def f06(b: Bridge):
    functions = b.table("part").select(F.col("p_partkey").alias("handle"), (F.col("p_partkey") % 300 * 8).alias("address"), F.col("p_brand").alias("name"), (F.col("p_partkey") % 5 != 0).alias("in_group"))
    files = b.table("supplier").select((F.col("s_suppkey") * 64).alias("address"))
    return passes.duplicate_functions(functions, files).select("handle", "address")


@query("f07", f"WITH {FN} SELECT handle, name FROM fn ORDER BY handle")
def f07(b: Bridge):
    """Two databases merge in order of their handles."""
    return b.functions.filter("handle % 3 = 0").unionByName(b.functions.filter("handle % 3 <> 0")).orderBy("handle").select("handle", "name")


@query("f08", "SELECT user_id AS file, event_id AS h, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) IS DISTINCT FROM event_type AS is_break FROM events")
def f08(b: Bridge):
    return passes.breaks(b.table("events"), ["user_id"], "event_id", "event_type").select(F.col("user_id").alias("file"), F.col("event_id").alias("h"), "is_break")


@query("j01", "WITH RECURSIVE r(node, depth) AS (SELECT CAST(1 AS BIGINT), 0 UNION ALL SELECT p_partkey, depth + 1 FROM r JOIN part ON p_partkey // 2 = node AND p_partkey > 1 WHERE node % 7 <> 6) SELECT node, CAST(depth AS BIGINT) AS depth FROM r")
def j01(b: Bridge):
    """Pre-order over the tree p -> p div 2 with whole subtrees pruned below nodes that are 6 modulo 7."""
    key = F.col("p_partkey")
    up = b.table("part").filter((key > 1) & (F.floor(key / 2) % 7 != 6)).select(key.alias("src"), F.floor(key / 2).cast("long").alias("dst"))
    found = graph.roots(up).filter("root = 1").select("node", F.col("hops").alias("depth"))
    return found


@query("j02", f"{REACH} SELECT node, arg_max(target, hops) AS root, CAST(max(hops) AS BIGINT) AS hops FROM r GROUP BY node")
def j02(b: Bridge):
    edges = _chain(b)
    found = graph.roots(edges)
    alone = b.table("part").select(F.col("p_partkey").alias("node")).join(found.select("node"), "node", "left_anti").select("node", F.col("node").alias("root"), F.lit(0).cast("long").alias("hops"))
    return found.unionByName(alone)


@query("j03", "WITH RECURSIVE r(node, target) AS (SELECT p_partkey, p_partkey FROM part UNION ALL SELECT r.node, p_partkey FROM r JOIN part ON p_partkey // 2 = r.target AND p_partkey > 1) SELECT node, CASE WHEN bool_or(target % 97 = 0) THEN NULL ELSE CAST(sum(p_size) AS BIGINT) END AS size FROM r JOIN part ON p_partkey = target GROUP BY node")
def j03(b: Bridge):
    """Sizes rolled up a tree; a part of unknown size makes everything above it unknown."""
    part = b.table("part")
    nodes = part.select(F.col("p_partkey").alias("node"), F.when(F.col("p_partkey") % 97 != 0, F.col("p_size").cast("long")).alias("own"))
    edges = part.filter("p_partkey > 1").select(F.floor(F.col("p_partkey") / 2).cast("long").alias("parent"), F.col("p_partkey").alias("child"))
    return graph.sizes(nodes, edges)


@query("j04", f"{REACH} SELECT node, target, CAST(hops AS BIGINT) AS hops FROM r WHERE hops > 0")
def j04(b: Bridge):
    return graph.closure(_chain(b), 30).filter("hops > 0")


FLAT = "WITH RECURSIVE r(ty, cur, shift, level) AS (SELECT p_partkey, p_partkey, CAST(0 AS BIGINT), 0 FROM part UNION ALL SELECT ty, cur // 2, shift + cur % 16 * 4, level + 1 FROM r WHERE cur // 2 > 0) SELECT ty AS type, CAST(level AS BIGINT) AS level, f AS ord, shift + f * 4 AS \"offset\" FROM r, (VALUES (0), (1), (2)) v(f) WHERE f <= cur % 3"


@query("j05", FLAT)
@query("j05_whole", FLAT)
def j05(b: Bridge):
    """Fields of all types, whatever their number."""
    return _flat_fields(b.table("part"))


def _flat_fields(part):
    key = F.col("p_partkey")
    types = part.select(key.alias("type"))
    bases = types.filter("type > 1").select("type", F.floor(F.col("type") / 2).cast("long").alias("base"), (F.col("type") % 16 * 4).alias("base_offset"))
    fields = types.select("type", F.explode(F.sequence(F.lit(0), (F.col("type") % 3).cast("int"))).alias("ord")).withColumn("offset", F.col("ord").cast("long") * 4)
    return graph.flat_fields(bases, fields)


@query("j06", "SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_linenumber <> 2")
def j06(b: Bridge):
    nodes = b.table("lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.lit("reference").alias("kind"), (F.col("l_linenumber") == 2).alias("is_forward_declared"))
    return graph.dependencies(nodes)
