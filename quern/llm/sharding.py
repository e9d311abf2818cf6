"""Sharding by size-tiered compaction.

Arrivals are appended as small immutable shards. Shards of similar size (of
one tier) are merged, as many as make up one file of the target size. Each
change is a new version of a manifest, committed by a rename that fails if
that version exists. Merging is one task per file to be made, which streams
its shards from the shared folder and writes one: nothing is shuffled. A task
that is run again writes another file; only the one that it reports gets into
the manifest, and what no kept version names is removed by ``vacuum``.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from quern.llm.common import fresh, importable, new_dir, remove, table
from quern.sources.storage import publish


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int
    arrival: int  # of a merged one, the latest in it


#: Seconds for which a file that no manifest names is kept: it may belong to a change that isn't committed yet.
GRACE = 24 * 3600


class Conflict(RuntimeError):
    """Another writer has committed this version."""


def unified(old: str | None, new: str) -> str:
    """The schema of both: columns that one lacks are null in its rows. ValueError where a column's types differ."""
    if old is None:
        return new
    fields = {f.name.lower(): f for f in StructType.fromJson(json.loads(old)).fields}
    for f in StructType.fromJson(json.loads(new)).fields:
        own = fields.setdefault(f.name.lower(), f)
        if own.dataType != f.dataType:
            raise ValueError(f"column {f.name} is {own.dataType.simpleString()} and can't be {f.dataType.simpleString()}")
    return StructType([StructField(f.name, f.dataType, True) for f in fields.values()]).json()


def tier(size: int, base: int, fanout: int) -> int:
    return 0 if size <= base else int(math.log(size / base, fanout))


def plan(shards: list[Shard], target: int, base: int, fanout: int) -> list[list[Shard]]:
    """Groups to merge: of one tier, at least ``fanout`` or as many as fill a file, in the order of arrival.

    Shards of three quarters of the target or more are left as they are.
    """
    tiers: dict[int, list[Shard]] = {}
    for s in sorted(shards, key=lambda s: (s.arrival, s.path)):
        if s.bytes < 0.75 * target:
            tiers.setdefault(tier(s.bytes, base, fanout), []).append(s)
    groups = []
    for _, own in sorted(tiers.items()):
        group, size = [], 0
        for s in own:
            if group and size + s.bytes > target:
                if len(group) > 1:
                    groups.append(group)
                group, size = [], 0
            group.append(s)
            size += s.bytes
        if len(group) >= fanout or len(group) > 1 and size >= 0.75 * target:
            groups.append(group)
    return groups


class ShardStore:
    """Shards and manifests in one folder of a file system that all executors share."""

    def __init__(self, spark: SparkSession, root: str, target: int = 64 << 20, base: int = 1 << 20, fanout: int = 4):
        self.spark, self.target, self.base, self.fanout = spark, target, base, fanout
        importable(spark)
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.root = self._fs.makeQualified(self._path(root.rstrip("/"))).toString()
        self._fs.mkdirs(self._path(f"{self.root}/manifests"))

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/manifests"))]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> tuple[int, list[Shard], str | None]:
        """(version, shards, schema as JSON); the latest by default, version 0 where there is none."""
        have = self.versions()
        version = (have[-1] if have else 0) if version is None else version
        if version == 0:
            return 0, [], None
        stream = self._fs.open(self._path(f"{self.root}/manifests/v{version:010d}.json"))
        try:
            text = bytes(self.spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)).decode()
        finally:
            stream.close()
        found = json.loads(text)
        return version, [Shard(**s) for s in found["shards"]], found["schema"]

    def commit(self, version: int, shards: list[Shard], schema: str | None) -> int:
        """Make ``version`` known, whole or not at all; Conflict where it exists."""
        text = json.dumps({"version": version, "schema": schema, "shards": [asdict(s) for s in shards]})
        to = self._path(f"{self.root}/manifests/v{version:010d}.json")
        temporary = self._path(f"{self.root}/manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(temporary, False)
        try:
            out.write(text.encode())
        finally:
            out.close()
        if not publish(self._fs, temporary, to):
            self._fs.delete(temporary, False)
            raise Conflict(f"version {version} exists")
        return version

    def _change(self, change: Callable[[list[Shard], str | None], list[tuple[list[Shard], str | None]]]) -> int:
        """Commit the versions that ``change`` makes of the newest one; once more, on the newer one, if another writer was faster."""
        while True:
            version, shards, schema = self.manifest()
            try:
                for shards, schema in change(shards, schema):
                    version = self.commit(version + 1, shards, schema)
                return version
            except Conflict:
                continue

    def _written(self, folder: str) -> list[tuple[str, int]]:
        found, files = [], self._fs.listFiles(self._path(folder), True)
        while files.hasNext():
            s = files.next()
            if s.getPath().getName().endswith(".parquet"):
                found.append((s.getPath().toString(), int(s.getLen())))
        return sorted(found)

    def append(self, rows: DataFrame, arrival: str | None = None) -> int:
        """Add rows as new shards and return the new version.

        With ``arrival``, a column of small whole numbers that isn't stored,
        each of its values is an arrival of its own, committed in their order,
        and all are written in one pass. Rows without any value come first.
        Columns may be added or missing; ValueError where a column has another
        type than before. Several writers may append and compact at a time.
        """
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        kept = [c for c in rows.columns if c != arrival]
        schema = rows.select(*[f"`{c}`" for c in kept]).schema.json()
        unified(self.manifest()[2], schema)  # before anything is written
        if arrival is None:
            rows.write.parquet(folder)
            portions = {0: self._written(folder)}
        else:
            (name,) = fresh(rows, "quern_arrival")
            rows.select(*[f"`{c}`" for c in kept], F.coalesce(F.col(f"`{arrival}`").cast("long"), F.lit(-1)).alias(name)).write.partitionBy(name).parquet(folder)
            portions = {}
            for path, size in self._written(folder):
                portions.setdefault(int(path.rsplit("=", 1)[1].split("/")[0]), []).append((path, size))
        left = sorted(portions.items())

        def change(shards: list[Shard], old: str | None) -> Iterator[tuple[list[Shard], str | None]]:
            kind = unified(old, schema)
            if not left:
                yield shards, kind
            while left:
                latest = max((s.arrival for s in shards), default=0) + 1
                shards = shards + [Shard(p, n, latest) for p, n in left[0][1]]
                yield shards, kind
                left.pop(0)  # it is committed

        return self._change(change)

    def compact(self) -> int:
        """Merge round by round until no tier has enough shards; returns the version.

        A merged file takes the place of its shards only where all of them are
        still there: of two compactions of the same shards one counts.
        """
        from pyspark.sql.pandas.types import to_arrow_schema

        while True:
            version, shards, schema = self.manifest()
            groups = plan(shards, self.target, self.base, self.fanout)
            if not groups:
                return version
            folder = f"{self.root}/data/{uuid.uuid4().hex}"
            self._fs.mkdirs(self._path(folder))
            kind = to_arrow_schema(StructType.fromJson(json.loads(schema))).serialize().to_pybytes()
            jobs = self.spark.createDataFrame([(i, [s.path for s in g], folder, kind) for i, g in enumerate(groups)], "id int, paths array<string>, folder string, kind binary")
            made = jobs.repartition(len(groups), "id").mapInPandas(_merge, "id int, path string, bytes bigint").collect()  # one row a file

            def change(now: list[Shard], schema: str | None) -> list[tuple[list[Shard], str | None]]:
                there = {s.path for s in now}
                whole = [r for r in sorted(made) if all(s.path in there for s in groups[r["id"]])]
                gone = {s.path for r in whole for s in groups[r["id"]]}
                merged = [Shard(r["path"], r["bytes"], max(s.arrival for s in groups[r["id"]])) for r in whole]
                return [([s for s in now if s.path not in gone] + merged, schema)] if whole else []

            self._change(change)

    def vacuum(self, keep: int = 1, grace: float = GRACE) -> int:
        """Remove manifests but the last ``keep``, and files older than ``grace`` seconds that no kept one names; returns how many files."""
        have = self.versions()
        named = {s.path for v in have[-keep:] for s in self.manifest(v)[1]}
        for v in have[:-keep]:
            self._fs.delete(self._path(f"{self.root}/manifests/v{v:010d}.json"), False)
        latest = (time.time() - grace) * 1000
        gone = []
        if self._fs.exists(self._path(f"{self.root}/data")):
            gone = [p for p, _ in self._written(f"{self.root}/data") if p not in named and self._fs.getFileStatus(self._path(p)).getModificationTime() <= latest]
        remove(self.spark, *gone)
        return len(gone)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, from the files that its manifest names."""
        _, shards, schema = self.manifest(version)
        if schema is None:
            raise ValueError("nothing has been appended")
        kind = StructType.fromJson(json.loads(schema))
        if not shards:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).option("recursiveFileLookup", "true").parquet(*[s.path for s in shards])


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import pyarrow as pa
    import pyarrow.parquet as pq

    def fitted(rows: pa.RecordBatch, kind: pa.Schema) -> pa.RecordBatch:
        at = {n.lower(): i for i, n in enumerate(rows.schema.names)}
        own = [rows.column(at[f.name.lower()]).cast(f.type) if f.name.lower() in at else pa.nulls(rows.num_rows, f.type) for f in kind]
        return pa.RecordBatch.from_arrays(own, schema=kind)

    for b in batches:
        for id_, paths, folder, kind in zip(b["id"], b["paths"], b["folder"], b["kind"]):
            kind = pa.schema([f.with_nullable(True) for f in pa.ipc.read_schema(pa.py_buffer(kind))])
            out = f"{folder}/part-{id_:05d}-{uuid.uuid4().hex}.parquet"
            fs, to = _open(out)
            with pq.ParquetWriter(to, kind, filesystem=fs, compression="zstd") as writer:
                for p in paths:
                    own, at = _open(p)
                    with own.open_input_file(at) as f, pq.ParquetFile(f, coerce_int96_timestamp_unit="us") as source:
                        for rows in source.iter_batches(batch_size=2048):
                            writer.write_batch(fitted(rows, kind), row_group_size=16384)
            yield pd.DataFrame({"id": [id_], "path": [out], "bytes": [fs.get_file_info(to).size]})


def _open(path: str):
    import pyarrow.fs

    if path.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)


#: In how many portions the query lets the documents arrive.
ARRIVALS = 8


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, read through the last manifest, after they arrived in portions and were compacted.

    Any columns of any names are kept. Null ids arrive together; an empty
    table gives a manifest without shards, and reads as empty.
    """
    docs = table(spark, sf_dir, "documents")
    store = ShardStore(spark, new_dir(spark, "shards"))
    (arrival,) = fresh(docs, "arrival")
    store.append(docs.withColumn(arrival, F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS))), arrival)
    store.compact()
    store.vacuum(grace=0)  # nobody else writes to this folder
    return store.read()


ORACLE_SQL = "SELECT * FROM documents"
