"""Streams over append-only logs: event-time windows and removal of repeats.

The reference only appends to its logs; windows and watermarks are additions.  A stream reads what is
there and ends; with a folder of its own it leaves its progress there, and the next run goes on from it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import Stage, hadoop_path


def read_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files, whether it is one file or a folder."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    fs, p = hadoop_path(spark, path)
    reader = spark.readStream.schema(schema)
    if fs.isDirectory(p):
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def run(stream: DataFrame, name: str, mode: str, folder: str | None = None) -> DataFrame:
    """The result of a stream over all that is there; mode 'append' writes new rows, 'complete' the last state.

    ``folder`` keeps progress and results: a later run of the same stream reads only what came since, and
    gives all results.  A run that was broken off is taken up where it stopped, each row once.  Without
    it the run stands alone and its tables go when the process ends."""
    spark = stream.sparkSession
    base = folder.rstrip("/") if folder else Stage(spark, f"stream-{name}").base
    out = f"{base}/{name}-out"

    fs, p = hadoop_path(spark, out)

    def done() -> list[int]:
        return sorted(int(x.getPath().getName().split("=")[1]) for x in fs.listStatus(p) if "=" in x.getPath().getName())

    def put(batch: DataFrame, n: int) -> None:  # each batch has a folder, so a batch that is run again replaces itself
        batch.write.mode("overwrite").parquet(f"{out}/batch={n}")
        for old in done() if mode == "complete" else ():  # the last state holds all; the one before stays until the next
            if old < n - 1:
                fs.delete(hadoop_path(spark, f"{out}/batch={old}")[1], True)

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/{name}-progress").trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()
    if not fs.exists(p):
        return spark.createDataFrame([], stream.schema)
    last = f"{out}/batch={done()[-1]}" if mode == "complete" else out
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(last)


def unique(stream: DataFrame, key: str, at: str, late: str = "30 days") -> DataFrame:
    """Each key once; a repeat is known for as long as it is no later than ``late`` behind the newest event."""
    return stream.filter(F.col(at).isNotNull()).withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", late).dropDuplicatesWithinWatermark([key]).drop("__at")


def windowed(stream: DataFrame, at: str, length: str, *aggregates, late: str = "30 days", slide: str | None = None) -> DataFrame:
    """Aggregates by window of event time (tumbling, or sliding with ``slide``)."""
    t = stream.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", late)
    w = F.window("__at", length, slide) if slide else F.window("__at", length)
    return t.groupBy(w.alias("w")).agg(*aggregates).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[a for a in _names(aggregates)])


def sessions(stream: DataFrame, key: str, at: str, gap: str, late: str = "30 days") -> DataFrame:
    """(key, session_start, events): runs of a key's events with no gap as long as ``gap``."""
    t = stream.filter(F.col(at).isNotNull()).withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", late)
    return t.groupBy(key, F.session_window("__at", gap).alias("w")).agg(F.count(F.lit(1)).alias("events")).select(key, F.col("w.start").alias("session_start"), "events")


def _names(aggregates) -> list[str]:
    return [a._jc.toString().rsplit(" AS ", 1)[1].strip("`") for a in aggregates]
