"""Tables in the folder that executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only where that is unset and Spark runs in one process (tests), an own one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("a cluster needs spark.checkpoint.dir: a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="strandweave-")
        atexit.register(shutil.rmtree, named.removeprefix("file://"), True)
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


#: Paths of the tables written in each open ``scratch``, the innermost last.
_scopes: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes, at its end, the tables that ``materialize`` wrote within, except those that are kept."""
    _scopes.append([])
    try:
        yield
    finally:
        jvm = spark._jvm
        for path in _scopes.pop():
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


@contextmanager
def _held(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def freed_shuffles(spark: SparkSession):
    """The shuffle files of what is written within go as soon as it is written, not when the driver collects its garbage."""
    return _held(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def text_batches(spark: SparkSession, most: int):
    """What runs within sends rows to Python in batches of ``most`` bytes at most (one row at least)."""
    return _held(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Writes ``df`` to the shared folder and rereads it, which cuts its lineage.

    The table goes at the end of the innermost ``scratch``, or with ``keep`` at the end of the one around that.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    scopes = _scopes[:-1] if keep else _scopes
    if scopes:
        scopes[-1].append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.sw_table = path
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
