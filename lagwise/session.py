"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
from concurrent.futures import ThreadPoolExecutor
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


_OWN_FOLDERS: list[tempfile.TemporaryDirectory] = []


def build_session(master: str = "local[*]", app: str = "lagwise", **conf: str) -> SparkSession:
    """A session with the settings the operators assume; `conf` keys use `__` for dots."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in `spark.checkpoint.dir`.

    Only a local session without that setting gets a folder of its own, which goes when the process ends.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    master = spark.sparkContext.master
    if master.startswith("local-cluster") or not master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if not _OWN_FOLDERS:
        _OWN_FOLDERS.append(tempfile.TemporaryDirectory(prefix="lagwise-", ignore_cleanup_errors=True))
    return _OWN_FOLDERS[0].name


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder; who asks for it removes it."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever Spark's readers reach it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows survive the loss of any executor."""
    cut_lineage_ready(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_lineage_ready(spark: SparkSession) -> None:
    """Name the checkpoint folder if nobody has."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def cut_lineages(*frames: DataFrame) -> list[DataFrame]:
    """Reliable checkpoints of independent frames, written at the same time."""
    cut_lineage_ready(frames[0].sparkSession)
    with ThreadPoolExecutor(len(frames)) as pool:
        return list(pool.map(cut_lineage, frames))
