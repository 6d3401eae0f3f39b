import pytest
from pyspark.sql import functions as F

from quire.sources import stores as S
from quire.streaming import logs


def test_a_failed_replace_keeps_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    S.replace(spark.range(5), path)
    with pytest.raises(Exception, match="boom"):
        S.replace(spark.range(9).select(F.when(F.col("id") == 7, F.raise_error(F.lit("boom"))).otherwise(F.col("id")).cast("bigint").alias("id")), path)
    assert spark.read.parquet(path).count() == 5
    S.replace(spark.read.parquet(path).filter("id < 3"), path)  # from itself
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [0, 1, 2]
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_a_log_is_numbered_over_appends(spark, tmp_path):
    path = str(tmp_path / "log")
    first = spark.range(100, numPartitions=7).select((F.col("id") * 37 % 100).alias("at"))
    S.append_log(first, path, "at")
    S.append_log(first, path, "at")
    S.append_log(first.limit(0), path, "at")
    S.append_log(first.limit(1), path, "at")
    rows = sorted((r.sequence, r.at) for r in spark.read.json(path).collect())
    assert [n for n, _ in rows] == list(range(1, 202))
    assert [at for _, at in rows[:200]] == [*range(100), *range(100)]


@pytest.mark.parametrize("mode", ["append", "complete"])
def test_a_stream_goes_on_where_it_stopped(spark, tmp_path, mode):
    source, folder = str(tmp_path / "in"), str(tmp_path / "state")
    rows = lambda a, b: spark.range(a, b).select("id", F.timestamp_seconds(F.lit(1_000_000_000) + F.col("id")).alias("at"))

    def once():
        s = spark.readStream.schema("id BIGINT, at TIMESTAMP").parquet(source)
        if mode == "append":
            return sorted(r.id for r in logs.run(logs.unique(s, "id", "at").select("id"), "t", mode, folder).collect())
        w = logs.windowed(s, "at", "1 hour", F.count(F.lit(1)).alias("n"))
        return [r.n for r in logs.run(w, "t", mode, folder).collect()]

    rows(0, 10).write.parquet(source)
    assert once() == (list(range(10)) if mode == "append" else [10])
    rows(5, 20).write.mode("append").parquet(source)
    assert once() == (list(range(20)) if mode == "append" else [25])
    assert once() == (list(range(20)) if mode == "append" else [25])
