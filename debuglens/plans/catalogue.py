"""Every registered query of the symbol engine with its oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from debuglens.operators import lookup
from debuglens.plans import aggregates, details, formats, imports, lookups, printing, reports, scalars, sequences  # noqa: F401
from debuglens.plans.registry import ORACLES, QUERIES, Bridge


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The function around each probed address and how many functions share its name."""
    b = Bridge(spark, sf_dir)
    hits = lookup.overlapping(b.probes, b.functions.select("handle", "address", "size", "name"), "a", "inner")
    return hits.join(lookup.by_name(b.functions), "name").select("o", "ln", "a", F.col("handle").alias("function"), "name", "n")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
