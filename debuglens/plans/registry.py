"""Registration of queries with their oracles."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Registers a function of (tables) under name; oracle is the same result in DuckDB SQL."""

    def keep(f):
        QUERIES[name] = lambda spark, sf_dir: f(Bridge(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return keep


class Bridge:
    """The driver's tables seen as symbol tables."""

    def __init__(self, spark, sf_dir):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name):
        from debuglens.session import table

        return table(self.spark, self.sf_dir, name)

    @property
    def functions(self):
        """Functions from part: 64 bytes apart, as long as p_size."""
        return self.table("part").selectExpr("p_partkey AS handle", "p_partkey * 64 AS address", "CAST(p_size AS BIGINT) AS size", "p_name AS name", "p_brand AS file", "p_partkey % 5 AS source_handle", "CAST(NULL AS BIGINT) AS module_handle")

    @property
    def globals(self):
        """Global variables from supplier: 640 bytes apart, 32 long."""
        return self.table("supplier").selectExpr("s_suppkey AS handle", "s_suppkey * 640 AS address", "CAST(32 AS BIGINT) AS size", "s_name AS name", "s_suppkey % 5 AS source_handle", "CAST(NULL AS BIGINT) AS module_handle")

    @property
    def source_files(self):
        return self.table("nation").selectExpr("CAST(n_nationkey AS BIGINT) AS handle", "CAST(n_nationkey AS BIGINT) * 4096 AS address", "CAST(1024 AS BIGINT) AS size", "n_name AS name", "CAST(n_nationkey % 5 AS BIGINT) AS source_handle", "CAST(NULL AS BIGINT) AS module_handle")

    @property
    def probes(self):
        return self.table("lineitem").selectExpr("l_orderkey AS o", "l_linenumber AS ln", "l_partkey AS part", "l_partkey * 64 + l_orderkey % 80 AS a")

    @property
    def opcodes(self):
        return self.table("events").selectExpr("user_id AS user", "event_id AS seq", "event_id % 64 AS opcode")


#: The same views for the oracles.
FN = "fn AS (SELECT p_partkey AS handle, p_partkey * 64 AS address, CAST(p_size AS BIGINT) AS size, p_name AS name, p_brand AS file, p_partkey % 5 AS source_handle FROM part)"
GV = "gv AS (SELECT s_suppkey AS handle, s_suppkey * 640 AS address, CAST(32 AS BIGINT) AS size, s_name AS name, s_suppkey % 5 AS source_handle FROM supplier)"
SF = "sf AS (SELECT CAST(n_nationkey AS BIGINT) AS handle, CAST(n_nationkey AS BIGINT) * 4096 AS address, CAST(1024 AS BIGINT) AS size, n_name AS name, CAST(n_nationkey % 5 AS BIGINT) AS source_handle FROM nation)"
PR = "pr AS (SELECT l_orderkey AS o, l_linenumber AS ln, l_partkey AS part, l_partkey * 64 + l_orderkey % 80 AS a FROM lineitem)"
OP = 'op AS (SELECT user_id AS "user", event_id AS seq, event_id % 64 AS opcode FROM events)'
