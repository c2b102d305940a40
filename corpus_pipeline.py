"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from debuglens.llm import bpe, exact_dedup, mixing, nearsets, quality
from debuglens.llm.common import documents, table
from debuglens.llm.queries import bpe_path
from debuglens.session import dropped, lean, stored


# Every stage returns the columns of docs, whatever their names are, and of an empty table an empty
# one. A null text counts as empty. Rows are told apart by doc_id and text, so decisions about one
# row never reach another that shares its doc_id or has none.


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the co-trained classifier accepts; it learns from labels.

    Each row is scored by itself, repeated ones too. Without labels of both classes every row stays.
    """
    lean(spark)
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of equal texts: most code points, then smallest doc_id (null last), then digest."""
    lean(spark)
    return exact_dedup.survivors(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row of the smallest doc_id (null last) of each component of texts that share 0.8 of their five-word shingles.

    SimHash finds the candidates, whole sets decide. Texts without words are one component.
    """
    lean(spark)
    return nearsets.survivors(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, as often as the mix of sources takes them, in the order of the mix.

    A null source is a source of its own; texts without words are not taken.
    """
    return mixing.mixed(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, decoded_sha256 of each row: what a trainer reads, and the proof of its round trip."""
    lean(spark)
    return bpe.digests(docs, bpe_path(), with_ids=True)


STAGES = [
    ("quality_classifier", quality_stage),
    ("exact_dedup", exact_stage),
    ("simhash_near_dedup", near_stage),
    ("mixing_sources", mixing_stage),
    ("bpe_encoding", encoding_stage),
]

#: The classifier is fitted, which SQL can't express; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; a stage's table is removed once the next one is written."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        path = stored(stage(spark, docs, sf_dir), name)
        docs = spark.read.parquet(path)
        if before is not None:
            dropped(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
