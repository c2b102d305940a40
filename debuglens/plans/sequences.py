"""Symbol sequences made from the driver's tables and analysed (L rows of the inventory)."""

from __future__ import annotations

from pyspark.sql import functions as F

from debuglens.operators.analyser import STABS_BASE, analyse
from debuglens.plans.registry import Bridge, query

#: What each function of a file consists of: (type, class, index, text, value), f being its name and k its key.
STEPS = (
    ("0", "0", STABS_BASE + 0x84, "concat('src/', ty, '.c')", "0"),
    ("IF(k % 3 = 0, 14, 6)", "1", 0, "f", "k * 64"),
    ("5", "1", 7, "'$LM7'", "k * 64 + 4"),
    ("0", "0", STABS_BASE + 0x24, "concat(f, ':F(0,1)')", "k * 64"),
    ("0", "0", STABS_BASE + 0xA0, "'a:p(0,1)'", "size"),
    ("0", "0", STABS_BASE + 0x40, "'this:P(1,2)'", "4"),
    ("8", "1", 0, "f", "size"),
    ("0", "0", STABS_BASE + 0x80, "'x:\\\\'", "0"),
    ("0", "0", STABS_BASE + 0x80, "'(0,1)'", "16"),
    ("0", "0", STABS_BASE + 0xC0, "''", "8"),
    ("0", "0", STABS_BASE + 0x40, "'y:r(0,2)'", "17"),
    ("0", "13", STABS_BASE + 0x26, "'z:V(0,3)'", "k * 8"),
    ("0", "0", STABS_BASE + 0xC0, "''", "12"),
    ("0", "0", STABS_BASE + 0xE0, "''", "size + 12"),
    ("0", "0", STABS_BASE + 0xE0, "''", "size + 20"),
    ("0", "0", STABS_BASE + 0x24, "''", "0"),
    ("0", "14", STABS_BASE + 0x28, "concat('g', k, ':S(0,1)')", "k * 4"),
    ("0", "0", STABS_BASE + 0x80, "concat('T', k, ':T(1,', k, ')=s', size, 'm:(0,1),0,32;;')", "0"),
)


def _symbols(b: Bridge):
    rows = b.table("part").selectExpr("CAST(substring(p_brand, 7) AS BIGINT) AS file", "p_partkey AS k", "CAST(p_size AS BIGINT) AS size", "concat('f', p_partkey) AS f", "p_type AS ty")
    steps = F.array(*[F.struct(F.lit(n).alias("n"), F.expr(f"CAST({t} AS BIGINT)").alias("symbol_type"), F.expr(f"CAST({c} AS BIGINT)").alias("symbol_class"), F.lit(i).cast("long").alias("index"), F.expr(text).alias("string"), F.expr(f"CAST({v} AS BIGINT)").alias("value")) for n, (t, c, i, text, v) in enumerate(STEPS)])
    one = rows.select("file", "k", F.explode(steps).alias("s"))
    return one.select("file", (F.col("k") * 100 + F.col("s.n")).alias("sym_idx"), "s.value", "s.symbol_type", "s.symbol_class", "s.index", "s.string", F.lit(1000).cast("long").alias("base"), F.when(F.col("s.n") == 1, 32).cast("long").alias("frame_size"))


P = "p AS (SELECT CAST(substr(p_brand, 7) AS BIGINT) AS file, p_partkey AS k, CAST(p_size AS BIGINT) AS size, p_type AS ty FROM part)"


def _only(b: Bridge, entity: str, *columns):
    return analyse(_symbols(b)).filter(F.col("entity") == entity).select("file", *columns)


@query("l01", f"WITH {P} SELECT file, e.entity, count(*) * e.n AS n FROM p, (VALUES ('function', 1), ('parameter', 2), ('local', 3), ('global', 1), ('data_type', 1), ('line_number', 1)) e(entity, n) GROUP BY file, e.entity, e.n")
def l01(b: Bridge):
    return analyse(_symbols(b)).groupBy("file", "entity").agg(F.count("*").alias("n"))


@query("l02", f"WITH {P} SELECT file, 'T' || k AS name, size, CAST(1 AS BIGINT) AS file_no, k AS type_no FROM p")
def l02(b: Bridge):
    return _only(b, "data_type", "name", "size", "file_no", "type_no")


@query("l03", f"WITH {P} SELECT file, 'f' || k AS name, k * 64 AS address, size, CAST(32 AS BIGINT) AS frame, k % 3 = 0 AS is_static FROM p")
def l03(b: Bridge):
    return _only(b, "function", "name", "address", "size", F.col("number").alias("frame"), "is_static")


@query("l04", f"WITH {P} SELECT file, 'f' || k AS function, CAST(6 AS BIGINT) AS n FROM p")
def l04(b: Bridge):
    """What belongs to each function, by the boundaries that names make."""
    rows = analyse(_symbols(b))
    names = rows.filter("entity = 'function'").select("file", F.col("seq").alias("owner"), F.col("name").alias("function"))
    return rows.filter("owner IS NOT NULL").join(names, ["file", "owner"]).groupBy("file", "function").agg(F.count("*").alias("n"))


@query("l05", f"WITH {P} SELECT file, k, v.name, CAST(1000 + v.low AS BIGINT) AS low, 1000 + size + v.high AS high FROM p, (VALUES ('x', 8, 20), ('y', 12, 12), ('z', 12, 12)) v(name, low, high)")
def l05(b: Bridge):
    """Live ranges: a block opens for the variables before it and closes for them."""
    return _only(b, "local", F.floor(F.col("seq") / 100).cast("long").alias("k"), "name", "low", "high")


@query("l06", f"WITH {P} SELECT file, k, v.name, v.storage, CASE v.name WHEN 'x' THEN 16 WHEN 'y' THEN 17 END AS number, CASE WHEN v.name = 'z' THEN k * 8 END AS address FROM p, (VALUES ('x', 'stack'), ('y', 'register'), ('z', 'sdata')) v(name, storage)")
def l06(b: Bridge):
    return _only(b, "local", F.floor(F.col("seq") / 100).cast("long").alias("k"), "name", "storage", "number", "address")


@query("l10", f"WITH {P} SELECT file, 'f' || k AS name, 'src/' || ty || '.c' AS path FROM p")
def l10(b: Bridge):
    """A sub-source file before a function is that function's path."""
    return _only(b, "function", "name", "path")


@query("l11", f"WITH {P} SELECT file, 'g' || k AS name, k * 4 AS address, 'sbss' AS storage, true AS is_static FROM p")
def l11(b: Bridge):
    return _only(b, "global", "name", "address", "storage", "is_static")


@query("l12", f"WITH {P} SELECT file, v.name, v.storage, CASE v.name WHEN 'a' THEN size ELSE 4 END AS number FROM p, (VALUES ('a', 'stack'), ('this', 'register')) v(name, storage)")
def l12(b: Bridge):
    return _only(b, "parameter", "name", "storage", "number")


@query("i17_lines", f"WITH {P} SELECT file, k * 64 + 4 AS address, CAST(7 AS BIGINT) AS line FROM p")
def i17_lines(b: Bridge):
    return _only(b, "line_number", "address", F.col("number").alias("line"))
