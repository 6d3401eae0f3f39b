import pytest

from quire.session import Stage, hadoop_path, shared_dir, ship


class Fake:
    """A session on a cluster without the setting."""

    class sparkContext:  # noqa: N801
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None

    class conf:  # noqa: N801
        @staticmethod
        def get(name, default=None):
            return default


def test_no_local_folder_on_a_cluster():
    with pytest.raises(RuntimeError):
        shared_dir(Fake())


def test_stage_writes_drops_and_keeps_the_schema(spark):
    stage = Stage(spark, "test")
    a = stage.write(spark.createDataFrame([(1, None), (2, "x")], "id BIGINT, v STRING"), "a")
    empty = stage.write(a.limit(0), "b")
    assert a.count() == 2 and empty.count() == 0 and empty.schema == a.schema
    fs, p = hadoop_path(spark, a._quire_path)
    assert fs.exists(p)
    stage.drop(a)
    assert not fs.exists(p)
    stage.drop(empty.select("id"))  # what wasn't written is left alone


def test_ship_once(spark):
    ship(spark)
    n = len(spark.sparkContext._python_includes)
    ship(spark)
    assert len(spark.sparkContext._python_includes) == n
