"""Session factory, table loader and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_LOCAL_BASE: list[tempfile.TemporaryDirectory] = []


def get_spark(app: str = "quire", cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings that the operators expect (UTC, AQE)."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, else a temporary one in local mode only."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL_BASE:
        _LOCAL_BASE.append(tempfile.TemporaryDirectory(prefix="quire-"))
    return "file://" + _LOCAL_BASE[0].name


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per context; they may not have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_quire_shipped", False):
        return
    root = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path(root.name) / p.relative_to(root))
    target = f"{shared_dir(spark)}/quire-ship-{uuid.uuid4().hex}/quire_package.zip"
    fs, path = hadoop_path(spark, target)
    out = fs.create(path)
    out.write(bytearray(packed.getvalue()))
    out.close()
    sc.addPyFile(target)
    sc._quire_shipped = True


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of Hadoop for a location."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


class Stage:
    """Intermediate tables written to the shared folder, to cut lineage where a loop would grow it.

    A written table survives the loss of executors.  ``drop`` removes one that no later step reads;
    what is left goes when the process ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/quire-{label}-{uuid.uuid4().hex}"
        self.count = 0
        atexit.register(self._clean)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.count += 1
        path = f"{self.base}/{self.count:03d}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._quire_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_quire_path", None)
        if path:
            fs, p = hadoop_path(self.spark, path)
            fs.delete(p, True)

    def _clean(self) -> None:
        try:
            fs, p = hadoop_path(self.spark, self.base)
            fs.delete(p, True)
        except Exception:  # the JVM may be gone already; the folder is then the cluster's to sweep
            pass
