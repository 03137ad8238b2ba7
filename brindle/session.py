"""Session factory, table access and lineage cuts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "brindle", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator assumes: UTC, adaptive execution with skew joins."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(root, f"{name}.parquet"))


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder on any file system Spark knows; none where there is no such folder."""
    fs, at = _hadoop(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []


def removed(spark: SparkSession, path: str) -> bool:
    fs, at = _hadoop(spark, path)
    return fs.delete(at, True)


def touched(spark: SparkSession, path: str) -> None:
    """An empty file, made in one step."""
    fs, at = _hadoop(spark, path)
    fs.create(at, True).close()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`, or a temporary one in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    global _LOCAL
    if _LOCAL is None:
        _LOCAL = tempfile.mkdtemp(prefix="brindle-")
        atexit.register(shutil.rmtree, _LOCAL, ignore_errors=True)
    return _LOCAL


_LOCAL: str | None = None


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared folder and drop its lineage; survives the loss of executors."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    # a checkpoint keeps the constraints of its plan, and over many rounds their inference outgrows the work itself;
    # nothing reads the shuffles behind a table that is written, and iterations would pile them up
    conf = {"spark.sql.constraintPropagation.enabled": "false", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    before = {name: spark.conf.get(name, None) for name in conf}
    for name, value in conf.items():
        spark.conf.set(name, value)
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def replaced(new: DataFrame, *old: DataFrame) -> DataFrame:
    """`new`, already written; the files of the `old` tables of `cut` that it takes the place of are deleted."""
    for df in old:
        file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if file.isDefined():
            removed(df.sparkSession, file.get())
    return new
