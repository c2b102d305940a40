"""Session helpers shared by every part of the library."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, wherever the driver was started.

    On a cluster the package is shipped with ``--py-files``; the environment entry only
    matters where workers share the driver's file system (local modes).
    """
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    return spark


#: Bytes of an Arrow batch that a task hands to its Python worker; both sides hold it, and the next one.
BATCH_BYTES = 4 << 20


def lean(spark: SparkSession) -> SparkSession:
    """Bound the session's Arrow batches, by rows alone 10,000 whole texts, to BATCH_BYTES; a smaller bound stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    bound = int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch())
    if not 0 < bound <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all executors share.

    ``spark.checkpoint.dir`` names it. Only a local master may do without: it gets a temporary
    folder, which nobody but this machine could read.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="debuglens-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the session's shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def by_key(df: DataFrame) -> DataFrame:
    """df as the right side of a join that deals out both sides by key.

    Without a word Spark broadcasts what it takes to be small, and it guesses that from Parquet's
    bytes and from columns: what Python or a checkpoint has made may be a thousand times as large.
    """
    return df.hint("merge")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df in four partitions for each core, by keys or in turn.

    For rows that are few bytes but much work in Python: by their bytes alone Spark reads or
    coalesces them into one task.
    """
    spark = df.sparkSession
    return df.repartition(min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *keys)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables, read through Spark only."""
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> str:
    """The path of df, written as a Parquet table in the session's shared folder."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the session's shared folder, read again."""
    return df.sparkSession.read.parquet(stored(df, name))


def dropped(spark: SparkSession, path: str) -> None:
    """Removes a table that stored() wrote, once nothing reads it any more."""
    if not path.startswith(f"{shared_folder(spark)}/"):
        raise ValueError(f"{path} is no table of this session")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def cancellable(spark: SparkSession, tag: str, run):
    """run() under a job tag; ``spark.interruptTag(tag)`` from another thread ends its jobs between files."""
    spark.addTag(tag)
    try:
        return run()
    finally:
        spark.removeTag(tag)
