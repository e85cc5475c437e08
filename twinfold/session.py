"""Session helpers: where shared intermediate data goes and how lineage is cut."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "twinfold", cores: int | str = 8, partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster use the session that is given."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the cluster names none, a local session gets a temporary folder; any other session is refused, as
    a machine-local folder is not visible to executors.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        current = spark.sparkContext.getCheckpointDir()
        if current:
            return os.path.dirname(current.rstrip("/"))
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="twinfold-")
        spark.conf.set("spark.checkpoint.dir", root)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


#: Paths handed out since the last ``clean_up``.
_WRITTEN: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def file_system(spark: SparkSession, path: str) -> tuple:
    """Spark's file system of a path, and the path as it takes it: the driver's own file calls need not reach it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete folders of intermediate data that nothing reads any more."""
    for path in paths:
        fs, where = file_system(spark, path)
        fs.delete(where, True)


def clean_up(spark: SparkSession) -> None:
    """Delete all intermediate data of this process; results that were not written elsewhere are gone with it."""
    while _WRITTEN:
        discard(spark, _WRITTEN.pop())


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage is cut, columns stay prunable."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame) -> bool:
    """True while the files are there that ``df``, made by ``materialize``, reads."""
    fs, path = file_system(df.sparkSession, df.inputFiles()[0].rsplit("/", 1)[0]) if df.inputFiles() else (None, None)
    return fs is not None and fs.exists(path)


def fits_broadcast(df: DataFrame, max_rows: int) -> bool:
    """True if ``df`` is proven to hold at most ``max_rows`` rows (counts at most one row more than that)."""
    return df.limit(max_rows + 1).count() <= max_rows
