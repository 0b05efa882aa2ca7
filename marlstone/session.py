"""Session settings and table access."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "marlstone", **conf: str) -> SparkSession:
    """A session with adaptive execution, skew handling and UTC."""
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    return builder.config(map=settings | {k.replace("__", "."): v for k, v in conf.items()}).getOrCreate()


#: Arrow batches, where the session doesn't say: a batch exists in the JVM, on
#: its way and in the worker, for each core of an executor.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2500", "spark.sql.execution.arrow.maxBytesPerBatch": "8388608b"}


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once a context, and
    batches of moderate size. Called wherever a Python stage starts; it sets
    BATCHES on the caller's session where that has no values of its own, and adds
    the package to the context's files."""
    sc, here = spark.sparkContext, Path(__file__).parent
    for name, value in BATCHES.items():
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, value)
    if getattr(sc, "_marlstone_shipped", False) or not here.is_dir():
        return
    folder = tempfile.mkdtemp(prefix="marlstone-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/marlstone_package.zip", "w") as out:
        for path in sorted(here.rglob("*.py")):
            out.write(path, path.relative_to(here.parent))
    sc.addPyFile(f"{folder}/marlstone_package.zip")
    sc._marlstone_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder that goes with
    the process; any other session gets a folder in the warehouse. The session
    keeps that choice as its ``spark.checkpoint.dir``.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.startswith("local"):
            root = tempfile.mkdtemp(prefix="marlstone-")
            atexit.register(shutil.rmtree, root, ignore_errors=True)
        else:
            root = spark.conf.get("spark.sql.warehouse.dir") + "/_scratch"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}"


_made = threading.local()


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    for paths in getattr(_made, "open", ()):
        paths.append(path)
    return path


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What is written to the shared folder inside is deleted at the end, but for
    the tables that the given function is called with."""
    paths, kept = [], set()
    _made.open = [*getattr(_made, "open", ()), paths]

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._scratch_path)
        return df

    try:
        yield keep
    finally:
        _made.open = _made.open[:-1]
    for path in paths:
        if path not in kept:
            delete(spark, path)


#: Setting by which Spark deletes the shuffle files of a finished query.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends there,
    and the copy survives the loss of any executor. The shuffle files of the write
    go with it, as nothing reads them again."""
    spark = df.sparkSession
    ship(spark)
    path = scratch(spark, label)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def drop_cut(df: DataFrame) -> None:
    """Delete what ``cut`` wrote for ``df``; it must not be read again."""
    delete(df.sparkSession, df._scratch_path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
