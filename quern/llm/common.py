"""What the operators share: the shared folder, written tables, free names."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE_ROOT = str(Path(__file__).resolve().parents[2])
#: Bytes of rows that a Python worker gets at a time in ``small_batches``.
BATCH_BYTES = 8 << 20
_own: dict[str, str] = {}
_made: list[str] = []


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(":") if p]
    if PACKAGE_ROOT not in paths:
        env["PYTHONPATH"] = ":".join([PACKAGE_ROOT, *paths])


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs begun in it give Python workers ``BATCH_BYTES`` at a time, or what is set where that is less: rows of long texts then take no more memory than short ones."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    if spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > BATCH_BYTES:
        spark.conf.set(name, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, named by ``spark.checkpoint.dir``.

    Where it is unset and the master is one local JVM (as in tests), a
    temporary folder is made and set; on a cluster that is an error.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = _own.get(sc.applicationId)
        if root is None:
            root = _own[sc.applicationId] = tempfile.mkdtemp(prefix="quern-")
            atexit.register(shutil.rmtree, root, ignore_errors=True)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


def new_dir(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one. Results read from it lazily: it stays until ``release`` or the driver's end."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    _made.append(path)
    return path


def release(spark: SparkSession) -> None:
    """Remove all folders that this driver has made; results that read from them can't be used any more."""
    remove(spark, *_made)
    _made.clear()


@atexit.register
def _release_local() -> None:
    for path in _made:
        if "://" not in path or path.startswith("file:"):
            shutil.rmtree("/" + path.removeprefix("file:").lstrip("/"), ignore_errors=True)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder and read again, which cuts its lineage."""
    spark = df.sparkSession
    path = new_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete written tables, on whatever file system they are."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    """How many partitions the session's operator sized its shuffles to."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
