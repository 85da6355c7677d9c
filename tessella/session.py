"""Session helpers: default configuration and the shared folder for cut lineage."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str = "*", memory: str = "8g", shuffle: int = 8) -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("tessella")
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle)).config("spark.driver.memory", memory)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all executors share.

    Where none is set and everything runs in this process, as in tests, a temporary one is set, and deleted at the end.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="tessella-")
    atexit.register(shutil.rmtree, own, True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


_scopes: list[list[str]] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df as a table in the shared folder and read it back.

    Unlike a local checkpoint the table outlives any executor. It stays until ``temporary`` ends around
    the call, or ``clean_up`` finds it old enough.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessella/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _scopes:
        _scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def _folder(spark: SparkSession, path: str) -> tuple[object, object]:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    files, where = _folder(spark, path)
    return bool(files.exists(where))


def delete(spark: SparkSession, path: str) -> None:
    files, where = _folder(spark, path)
    files.delete(where, True)


def rename(spark: SparkSession, path: str, to: str) -> None:
    files, where = _folder(spark, path)
    if not files.rename(where, _folder(spark, to)[1]):
        raise OSError(f"{path} could not be moved to {to}")


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """A scope whose materialized tables are deleted at its end; results must be written before."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            delete(spark, path)


def clean_up(spark: SparkSession, older_than_hours: float = 24.0) -> int:
    """Delete the tables in the shared folder that have not changed for a while; returns how many."""
    files, where = _folder(spark, f"{shared_dir(spark)}/tessella")
    if not files.exists(where):
        return 0
    old = [f.getPath() for f in files.listStatus(where) if f.getModificationTime() < (time.time() - older_than_hours * 3600) * 1000]
    for path in old:
        files.delete(path, True)
    return len(old)
