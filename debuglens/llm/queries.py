"""The registered queries of the training-data operators and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from debuglens.llm import bpe, ctph, exact_dedup, langid, licenses, linededup, mixing, quality, simhash, substrings
from debuglens.llm.common import documents, table


def op1_langid(spark, sf_dir):
    docs = documents(spark, sf_dir)
    third = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))
    model = langid.fit(docs, F.coalesce(third != 1, F.lit(False)))
    return langid.predict(docs, model, F.coalesce(third == 1, F.lit(False)))


def bpe_path() -> str:
    """The byte-level vocabulary of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def op3_bpe(spark, sf_dir):
    return bpe.digests(documents(spark, sf_dir), bpe_path())


def op4_ctph(spark, sf_dir):
    return ctph.fingerprints(documents(spark, sf_dir))


def op5_substrings(spark, sf_dir):
    return substrings.digests(documents(spark, sf_dir))


def op6_mixing(spark, sf_dir):
    out = mixing.shares(documents(spark, sf_dir))
    return out.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), "taken")


def op7_simhash(spark, sf_dir):
    return simhash.near_groups(documents(spark, sf_dir))


def op8_quality(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op9_licenses(spark, sf_dir):
    return licenses.scan(documents(spark, sf_dir))


def op10_line_dedup(spark, sf_dir):
    return linededup.digests(documents(spark, sf_dir))


def queries():
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql():
    return {"op2_exact_dedup": exact_dedup.ORACLE, "op6_mixing": mixing.ORACLE, "op9_licenses": licenses.ORACLE}
