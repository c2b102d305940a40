"""Follow mode: symbol files that arrive in a folder, decoded as they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType, TimestampType

FILES = StructType([StructField("path", StringType()), StructField("modificationTime", TimestampType()), StructField("length", LongType()), StructField("content", BinaryType())])


def arriving(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """(path, content) of files as they arrive; a batch takes a bounded number of them."""
    return spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_per_batch).load(folder).select("path", "content")


def follow(spark: SparkSession, folder: str, decode: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = False):
    """Starts a query that decodes arriving files and appends the rows to a table of Parquet files.

    decode is one of the readers of ``debuglens.sources.tables``; files are independent, so no
    state is kept between batches. once ends the query when what is there has been read.
    """
    rows = decode(arriving(spark, folder))
    writer = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
