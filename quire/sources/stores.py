"""Reading and writing of logs, caches, plans and older workspaces."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.operators.state import latest
from quire.session import Stage, hadoop_path

USAGE = "prompt_tokens BIGINT, cache_hit_tokens BIGINT, cache_miss_tokens BIGINT, completion_tokens BIGINT, requests BIGINT, failures BIGINT"


def discover(spark: SparkSession, root: str, glob: str = "*.pdf", recursive: bool = True, results: tuple[str, ...] = (".results", ".translation")) -> DataFrame:
    """(path, bytes, modified) of files, without those inside folders of results, which end so."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(root)
    inside = F.exists(F.split("path", "/"), lambda x: x.rlike("(" + "|".join(re.escape(e) for e in results) + ")$"))
    return f.filter(~inside).select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    """Usage reports, one JSON object a file, with the file's path; a corrupt one has nulls and corrupt = true."""
    raw = spark.read.option("wholetext", "true").text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    j = raw.withColumn("j", F.from_json("value", USAGE, {"mode": "PERMISSIVE"}))
    ok = F.try_parse_json("value").isNotNull()
    return j.select("path", *[F.when(ok, F.col(f"j.{c.split()[0]}")).alias(c.split()[0]) for c in USAGE.split(", ")], (~ok).alias("corrupt"))


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log of one JSON object a line; a line that is none has nulls and stays in _corrupt."""
    return spark.read.schema(schema + ", _corrupt STRING").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def count_lines(spark: SparkSession, path: str) -> DataFrame:
    """(lines): lines of a log that aren't blank."""
    return spark.read.text(path).filter(F.trim("value") != "").agg(F.count(F.lit(1)).alias("lines"))


def append_log(df: DataFrame, path: str, order: str) -> None:
    """Append rows to a log, numbered by ``sequence`` from the log's last number on, without gaps, in the order of ``order``.

    Rows with equal order values come in any order; an empty table appends nothing.  One writer at a time."""
    spark = df.sparkSession
    stage = Stage(spark, "append")
    place = F.monotonically_increasing_id()
    rows = df.repartitionByRange(order).sortWithinPartitions(order).withColumn("__task", F.shiftright(place, 33)).withColumn("__at", place.bitwiseAND(F.lit((1 << 33) - 1)))
    rows = stage.write(rows, "rows")
    fs, p = hadoop_path(spark, path)
    last = spark.read.schema("sequence BIGINT").json(path).agg(F.max("sequence")).first()[0] if fs.exists(p) else None
    # one row for each task
    counts = rows.groupBy(F.col("__task").alias("__t")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__t").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("__t", F.coalesce(before, F.lit(0)).alias("__before"))
    sequence = F.col("__at") + F.col("__before") + F.lit((last or 0) + 1)
    out = rows.join(F.broadcast(counts), F.col("__task") == F.col("__t")).select(*df.columns, sequence.alias("sequence"))
    out.write.mode("append").json(path)


def write_new(df: DataFrame, path: str) -> None:
    """Write where nothing is yet; an existing target is an error and stays as it is."""
    df.write.mode("errorifexists").parquet(path)


def replace(df: DataFrame, path: str) -> None:
    """Replace a table whole.  The new one is written beside the old and takes its name when it is complete,
    so a failed job leaves the old as it was; ``df`` may read from ``path`` itself."""
    spark = df.sparkSession
    mark = uuid.uuid4().hex
    fs, target = hadoop_path(spark, path)
    _, new = hadoop_path(spark, f"{path.rstrip('/')}.new-{mark}")
    _, old = hadoop_path(spark, f"{path.rstrip('/')}.old-{mark}")
    try:
        df.write.parquet(new.toString())
    except Exception:
        fs.delete(new, True)
        raise
    had = fs.exists(target)
    if had and not fs.rename(target, old):
        fs.delete(new, True)
        raise OSError(f"can't move {path} aside")
    if not fs.rename(new, target):
        if had:
            fs.rename(old, target)
        fs.delete(new, True)
        raise OSError(f"can't put the new table at {path}")
    if had:
        fs.delete(old, True)


def store_cache(new: DataFrame, cache: DataFrame | None) -> DataFrame:
    """The cache with new entries (key, translation): the first translation of a key stays, empty ones don't go in."""
    fresh = new.filter((F.trim("translation") != "") & F.col("key").isNotNull())
    fresh = fresh.groupBy("key").agg(F.min("translation").alias("translation"))
    return fresh if cache is None else cache.unionByName(fresh.join(cache.select("key"), "key", "left_anti"))


def look_up(units: DataFrame, cache: DataFrame) -> DataFrame:
    """The units with the cached translation of their key; a corrupt or empty entry is a miss."""
    good = cache.filter(F.trim("translation") != "").groupBy(F.col("key").alias("c_key")).agg(F.min("translation").alias("cached"))
    return units.join(good, F.col("key") == F.col("c_key"), "left").drop("c_key").withColumn("hit", F.col("cached").isNotNull())


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    """(bucket, position, ratio): stored samples, those that are no positive numbers left out, the rest within 0.2 and 8."""
    raw = spark.read.option("wholetext", "true").text(path).select(F.explode(F.from_json(F.get_json_object("value", "$.buckets"), "map<string,array<double>>")).alias("bucket", "ratios"))
    r = raw.select("bucket", F.posexplode("ratios").alias("position", "ratio"))
    return r.filter(F.col("ratio").isNotNull() & ~F.isnan("ratio") & (F.col("ratio") > 0) & (F.col("ratio") < float("inf"))).withColumn("ratio", F.least(F.greatest("ratio", F.lit(0.2)), F.lit(8.0)))


def import_workspace(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(file, units) of an older workspace: state.json and the texts of its chunks; a chunk counts as done,
    failed or pending by its status, with the translation that its file holds."""
    chunk = "id STRING, source_file STRING, translated_file STRING, source_sha256 STRING, status STRING"
    schema = f"source_pdf STRING, source_pdf_sha256 STRING, completed BOOLEAN, chunks ARRAY<STRUCT<{chunk.replace(' STRING', ': STRING')}>>"
    state = spark.read.schema(schema).option("multiLine", "true").json(f"{path}/state.json")
    file = state.select(
        F.col("source_pdf").alias("source_path"), F.col("source_pdf_sha256").alias("source_sha256"), F.element_at(F.split("source_pdf", "/"), -1).alias("display_name"),
        F.when(F.col("completed"), "translation_complete").otherwise("translation_running").alias("status"),
    )
    texts = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(path).select(F.col("_metadata.file_path").alias("p"), "value")
    name = F.regexp_extract("p", r"([^/]+/[^/]+)$", 1)
    texts = texts.select(name.alias("t_name"), "value")
    c = state.select(F.posexplode("chunks").alias("n", "c")).select((F.col("n") + 1).alias("sequence_index"), "c.*")
    c = c.withColumn("unit_key", F.coalesce("id", F.concat(F.lit("b"), F.lpad(F.col("sequence_index").cast("string"), 5, "0"))))
    c = c.withColumn("source_file", F.coalesce("source_file", F.concat(F.lit("chunks/"), "unit_key", F.lit(".source.md")))).withColumn("translated_file", F.coalesce("translated_file", F.concat(F.lit("chunks/"), "unit_key", F.lit(".zh.md"))))
    s, t = texts.select(F.col("t_name").alias("s_name"), F.col("value").alias("source_text")), texts.withColumnRenamed("value", "translation_text")
    u = c.join(s, F.col("source_file") == F.col("s_name"), "left").join(t, F.col("translated_file") == F.col("t_name"), "left")
    status = F.when(F.col("status") == "done", "done").when(F.col("status").isin("failed", "error"), "failed").otherwise("pending")
    units = u.select(
        "unit_key", "sequence_index", "source_text", F.coalesce("source_sha256", F.sha2("source_text", 256)).alias("source_hash"), status.alias("status"), "translation_text",
        F.sha2("translation_text", 256).alias("translation_hash"), F.when(status == "done", 1).otherwise(0).alias("attempt_count"), "source_file", "translated_file",
    )
    return file, units


def log_positions(log: DataFrame, at: str) -> DataFrame:
    """The newest entry of each unit in a log (unit_id), with how many entries it has."""
    n = log.groupBy("unit_id").agg(F.count(F.lit(1)).alias("entries"))
    return latest(log, ["unit_id"], [F.desc(at)]).join(n, "unit_id")


def numbered(df: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of each key numbered from 1."""
    return df.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(order)))
