"""Files of the engine: a work folder shared by all executors, and small JSON files written whole or not at all."""

from __future__ import annotations

import atexit
import json
import os
import shutil
import tempfile
import threading
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import SparkSession

_own: dict[str, str] = {}
_lock, _writing, _before = threading.Lock(), [], []


def work_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one where that is unset and the master is local."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _own:
        _own[sc.applicationId] = tempfile.mkdtemp(prefix="quern-work-")
        atexit.register(shutil.rmtree, _own[sc.applicationId], ignore_errors=True)
    return _own[sc.applicationId]


def unique(spark: SparkSession, name: str) -> str:
    """A new folder in the work folder; a local one goes when the driver ends."""
    path = f"{work_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    if "://" not in path or path.startswith("file:"):
        atexit.register(shutil.rmtree, "/" + path.removeprefix("file:").lstrip("/"), ignore_errors=True)
    return path


@contextmanager
def open_folders(spark: SparkSession, most: int) -> Iterator[None]:
    """Tables of up to ``most`` folders written in it are written to all of these at a time, and aren't sorted by folder first."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    with _lock:
        if not _writing:
            _before[:] = [spark.conf.get(name, None)]
        _writing.append(name)
        spark.conf.set(name, most + 1)  # a task that reaches this number sorts what is left
    try:
        yield
    finally:
        with _lock:
            _writing.pop()
            if not _writing:  # the last of several writers at a time
                spark.conf.unset(name) if _before[0] is None else spark.conf.set(name, _before[0])


def publish(fs: Any, beside: Any, path: Any) -> bool:
    """Give a written file its name; false, and nothing changed, where another has it.

    Both are Hadoop paths. A rename does it on file systems that refuse to
    rename onto a file; a local one doesn't refuse, but a hard link does.
    """
    if fs.getUri().getScheme() != "file":
        return not fs.exists(path) and fs.rename(beside, path)
    try:
        os.link(beside.toUri().getPath(), path.toUri().getPath())
    except FileExistsError:
        return False
    fs.delete(beside, False)
    return True


class Files:
    """Text files and folders on any file system that Spark can reach."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(conf)

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def names(self, path: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(path))) if self.exists(path) else []

    def make(self, path: str) -> None:
        self._fs.mkdirs(self._path(path))

    def size(self, path: str) -> int:
        """Bytes of a file, or of all in a folder."""
        return int(self._fs.getContentSummary(self._path(path)).getLength())

    def age(self, path: str) -> float:
        """Seconds since a file or folder was changed."""
        return time.time() - self._fs.getFileStatus(self._path(path)).getModificationTime() / 1000

    def move(self, path: str, to: str) -> None:
        if not self._fs.rename(self._path(path), self._path(to)):
            raise OSError(f"{path} can't be moved to {to}")

    def remove(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def read(self, path: str) -> Any:
        folder, _, name = path.rpartition("/")
        if not self.exists(path) and self.exists(f"{folder}/.{name}.before"):
            path = f"{folder}/.{name}.before"
        stream = self._fs.open(self._path(path))
        try:
            return json.loads(bytes(self._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)).decode())
        finally:
            stream.close()

    def write(self, path: str, value: Any, replace: bool = True) -> None:
        """Write JSON beside ``path`` and give it that name; without ``replace``, FileExistsError where there is one.

        On a local disk a file is replaced in one step. Elsewhere it is moved
        aside first, and ``read`` finds it there until the new one has its name.
        """
        folder, _, name = path.rpartition("/")
        beside = f"{folder}/.{name}.{uuid.uuid4().hex[:8]}"
        out = self._fs.create(self._path(beside), True)
        try:
            out.write(json.dumps(value, indent=2, sort_keys=True).encode())
        finally:
            out.close()
        if not replace:
            if publish(self._fs, self._path(beside), self._path(path)):
                return
            self.remove(beside)
            raise FileExistsError(path)
        if self._fs.getUri().getScheme() == "file":
            os.replace(self._path(beside).toUri().getPath(), self._path(path).toUri().getPath())
            self.remove(f"{folder}/.{name}.crc")  # of what was there before
            return
        aside = f"{folder}/.{name}.before"
        if self.exists(path):
            self.remove(aside)
            self._fs.rename(self._path(path), self._path(aside))
        if not self._fs.rename(self._path(beside), self._path(path)):
            self.remove(beside)
            raise FileExistsError(path)
        self.remove(aside)


def local_json(path: str, value: Any) -> None:
    """A JSON file on the driver's disk, replaced in one step."""
    beside = f"{path}.{uuid.uuid4().hex[:8]}"
    with open(beside, "w") as f:
        json.dump(value, f, indent=2, sort_keys=True)
    os.replace(beside, path)
