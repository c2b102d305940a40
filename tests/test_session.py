"""The shared folder: checkpoints and written tables."""

import pytest

from debuglens import session


def test_stored_tables_can_be_dropped(spark):
    path = session.stored(spark.range(10), "numbers")
    assert spark.read.parquet(path).count() == 10
    session.dropped(spark, path)
    with pytest.raises(Exception):
        spark.read.parquet(path)


def test_only_tables_of_the_session_are_dropped(spark):
    with pytest.raises(ValueError):
        session.dropped(spark, "/root/testdata/sf0.001/region.parquet")


class Cluster:
    """What shared_folder() asks of a session on a cluster without a shared folder."""

    class sparkContext:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None

    class conf:
        @staticmethod
        def get(key, default):
            return default


def test_clusters_need_a_shared_folder():
    with pytest.raises(RuntimeError):
        session.shared_folder(Cluster)
