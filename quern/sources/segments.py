"""Immutable segments of an index, its versioned manifest, live documents, compaction.

    docs/F/…                   all columns of the documents, and ordinal
    postings/F/term_bucket=B/…  term, id, ordinal, dl, tf, positions
    versions/F/…                id, ordinal, dead, dl: what decides which documents are live
    manifests/vN.json          the segments of version N, in their order, and their folders F
    live/vN.json               where the live versions of N are, and its statistics

Any number of writers may add, delete and compact at a time: a folder's name is
unique, a segment gets its place when it is committed, and a compaction counts
only where all that it merged is still there.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, replace
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators import build
from quern.plans.search import BUCKETS, Snapshot, local
from quern.sources.catalog import Definition
from quern.sources.storage import Files, open_folders

#: Segments of fewer documents are small: two of them are worth merging.
SMALL = 10
#: Bytes of a row group of postings; a task has one open for each folder.
ROW_GROUP = 16 << 20
VERSIONS = "id string, ordinal bigint, dead boolean, dl bigint"
#: Seconds for which ``vacuum`` keeps what no manifest names.
GRACE = 24 * 3600


@dataclass(frozen=True)
class Segment:
    id: str
    seq: int
    documents: int
    clean: bool  # no tombstone, and each id once
    termed: int = 0  # documents with a term
    length: int = 0  # terms in all
    folder: str = ""
    bytes: int = 0  # of its documents


def should_merge(segments: list[Segment], threshold: int = 4) -> bool:
    if len(segments) <= 1:
        return False
    return len(segments) >= threshold or sum(s.documents < SMALL for s in segments) >= 2


def resolved(docs: DataFrame) -> DataFrame:
    """Live documents: of each id the last version, unless that is a tombstone (``_deleted``, a boolean, is true)."""
    last = Window.partitionBy("id").orderBy(F.desc("segment_seq"), F.desc("ordinal"))
    rows = docs.withColumn("__nth", F.row_number().over(last)).where("__nth = 1").drop("__nth")
    if dict(docs.dtypes).get("_deleted") == "boolean":
        rows = rows.where(~F.coalesce(F.col("_deleted"), F.lit(False)))
    return rows


class Segments:
    #: How postings are compressed; any codec that Spark's Parquet writer knows.
    compression = "zstd"

    def __init__(self, spark: SparkSession, root: str, definition: Definition):
        self.spark, self.root, self.definition = spark, root.rstrip("/"), definition
        self.files = Files(spark, root)
        for folder in ("docs", "postings", "versions", "manifests", "live"):
            self.files.make(f"{self.root}/{folder}")

    # -- manifest -----------------------------------------------------------

    def version(self) -> int:
        return max((int(n[1:-5]) for n in self.files.names(f"{self.root}/manifests") if n.startswith("v") and n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"segments": [], "applied": -1, "next": 0, "bytes": 0}
        return self.files.read(f"{self.root}/manifests/v{version:010d}.json")

    def segments(self, version: int | None = None) -> list[Segment]:
        return [Segment(**s) for s in self.manifest(version)["segments"]]

    def _commit(self, change: Callable[[dict], dict | None]) -> bool:
        """Apply a change to the newest manifest and commit it; again, on the newer one, if another was faster. False if it comes to nothing."""
        while True:
            version = self.version()
            new = change(self.manifest(version))
            if new is None:
                return False
            try:
                self.files.write(f"{self.root}/manifests/v{version + 1:010d}.json", new, replace=False)
                return True
            except FileExistsError:
                continue

    def add(self, made: Sequence[Segment], applied: int | None = None) -> list[Segment]:
        """Commit written segments, all at once; they get their places here. One of a name that is there takes its place.

        None are added of a batch that has been ``applied`` before.
        """
        placed: list[Segment] = []

        def change(m: dict) -> dict | None:
            if applied is not None and m["applied"] >= applied:
                return None
            placed[:] = []
            there = {s["id"]: s for s in m["segments"]}
            for k, s in enumerate(made):
                placed.append(replace(s, seq=there[s.id]["seq"] if s.id in there else m["next"] + k))
                there[s.id] = asdict(placed[-1])
            return m | {
                "segments": sorted(there.values(), key=lambda s: (s["seq"], s["id"])), "next": m["next"] + len(made),
                "applied": m["applied"] if applied is None else applied, "bytes": m["bytes"] + sum(s.bytes for s in made),
            }

        if not self._commit(change):
            self._discard(made)
            return []
        return placed

    def replace(self, gone: Sequence[Segment], made: Segment) -> bool:
        """Swap segments for one; what others have added meanwhile stays. False where one of them isn't there any more."""
        merged = {(s.id, s.folder) for s in gone}

        def change(m: dict) -> dict | None:
            if not merged <= {(s["id"], s["folder"]) for s in m["segments"]}:
                return None
            kept = [s for s in m["segments"] if (s["id"], s["folder"]) not in merged]
            return m | {"segments": sorted([*kept, asdict(made)], key=lambda s: (s["seq"], s["id"]))}

        return self._commit(change)

    def _discard(self, made: Sequence[Segment]) -> None:
        for s in made:
            for kind in ("docs", "postings", "versions"):
                self.files.remove(f"{self.root}/{kind}/{s.folder}")

    # -- writing ------------------------------------------------------------

    def write(self, docs: DataFrame, applied: int | None = None, segment_id: str | None = None) -> Segment | None:
        """One new segment of documents, whose order is that of ``ordinal`` if they have it; None if the batch was applied before."""
        return next(iter(self.add([self.written(docs, segment_id)], applied)), None)

    def written(self, docs: DataFrame, segment_id: str | None = None) -> Segment:
        """The files of a segment, which is in no manifest yet. A document is tokenised once, and what is made of it isn't shuffled."""
        folder = f"{segment_id or 'seg'}-{uuid.uuid4().hex[:12]}"
        at = {kind: f"{self.root}/{kind}/{folder}" for kind in ("docs", "postings", "versions")}
        if "ordinal" not in docs.columns:
            docs = docs.withColumn("ordinal", F.monotonically_increasing_id())
        docs.drop(*[c for c in ("segment_id", "segment_seq") if c in docs.columns]).write.option("compression", "zstd").parquet(at["docs"])
        stored = self.spark.read.parquet(at["docs"])
        deleted = F.coalesce(F.col("_deleted"), F.lit(False)) if dict(stored.dtypes).get("_deleted") == "boolean" else F.lit(False)
        keys = {"dead": deleted, "id": F.col("id").cast("string"), "ordinal": F.col("ordinal").cast("bigint")}
        rows = build.indexed(stored.withColumns(keys), self.definition, ("id", "ordinal", "dead"), BUCKETS)
        # Each task writes a file to each folder, in runs sorted by term, so that pages are skipped.
        with open_folders(self.spark, BUCKETS + 1):
            rows.write.option("compression", self.compression).option("parquet.block.size", ROW_GROUP).partitionBy("term_bucket").parquet(at["postings"])
        if self.files.exists(itself := f"{at['postings']}/term_bucket={build.ITSELF}"):
            self.files.move(itself, at["versions"])
        else:
            self.files.make(at["versions"])
        told = self.spark.read.schema(VERSIONS).parquet(at["versions"]).agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.coalesce(F.max("dead"), F.lit(False)).alias("dead"), F.count_if(F.col("dl") > 0).alias("termed"), F.coalesce(F.sum("dl"), F.lit(0)).alias("length")).first()
        return Segment(segment_id or folder, -1, told["n"], told["n"] == told["ids"] and not told["dead"], told["termed"], told["length"], folder, self.files.size(at["docs"]))

    # -- reading ------------------------------------------------------------

    def raw_docs(self, segments: list[Segment]) -> DataFrame | None:
        parts = [self.spark.read.parquet(f"{self.root}/docs/{s.folder}").withColumns({"segment_id": F.lit(s.id), "segment_seq": F.lit(s.seq)}) for s in segments]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None

    def raw_postings(self, segments: list[Segment]) -> DataFrame:
        schema = "term string, id string, ordinal bigint, dl bigint, tf double, positions array<int>, term_bucket int"
        parts = [self.spark.read.schema(schema).parquet(f"{self.root}/postings/{s.folder}").withColumn("segment_seq", F.lit(s.seq)) for s in segments if s.documents]
        return reduce(lambda a, b: a.unionByName(b), parts) if parts else self.spark.createDataFrame([], schema + ", segment_seq int")

    def _live(self, version: int, segments: list[Segment]) -> tuple[DataFrame, dict]:
        """``(id, segment_seq, ordinal, dl)`` of the live documents of a version, and how many they are and their mean length.

        Told from the narrow table of versions, once for each manifest.
        """
        note = f"{self.root}/live/v{version:010d}.json"
        if not self.files.exists(note):
            parts = [self.spark.read.schema(VERSIONS).parquet(f"{self.root}/versions/{s.folder}").withColumn("segment_seq", F.lit(s.seq)) for s in segments]
            every = reduce(lambda a, b: a.union(b), parts)
            last = Window.partitionBy("id").orderBy(F.desc("segment_seq"), F.desc("ordinal"))
            rows = every.withColumn("nth", F.row_number().over(last)).where((F.col("nth") == 1) & ~F.col("dead"))
            folder = f"v{version:010d}-{uuid.uuid4().hex[:12]}"
            rows.select("id", "segment_seq", "ordinal", "dl").write.option("compression", "zstd").parquet(f"{self.root}/live/{folder}")
            n, avgdl = self.spark.read.parquet(f"{self.root}/live/{folder}").agg(F.count("*"), F.avg(F.when(F.col("dl") > 0, F.col("dl")))).first()
            try:
                self.files.write(note, {"folder": folder, "n": n, "avgdl": avgdl}, replace=False)
            except FileExistsError:  # another search was faster
                self.files.remove(f"{self.root}/live/{folder}")
        told = self.files.read(note)
        return self.spark.read.parquet(f"{self.root}/live/{told['folder']}"), told

    def snapshot(self, version: int | None = None, stale_postings: bool = False) -> Snapshot:
        """Documents, postings and statistics of one version.

        Postings are those of live versions alone; with ``stale_postings``,
        those that any segment has of an id that is live, which count anew in
        frequencies, lengths and scores.
        """
        version = self.version() if version is None else version
        segments = self.segments(version)
        raw = self.raw_docs(segments)
        stats = lambda n, avgdl: local(self.spark, n=([n], pa.int64()), avgdl=([avgdl], pa.float64()))
        if raw is None:
            raw = self.spark.createDataFrame([], "id string, ordinal bigint, segment_id string, segment_seq int")
            return Snapshot(self.raw_postings(segments), raw, stats(0, None), self.definition)
        postings = self.raw_postings(segments)
        if len(segments) == 1 and segments[0].clean:
            own = segments[0]
            return Snapshot(postings, raw, stats(own.documents, own.length / own.termed if own.termed else None), self.definition)
        live, told = self._live(version, segments)
        keys = ["id", "segment_seq", "ordinal"]
        docs = raw.join(live.select(*keys), keys, "left_semi")
        if not stale_postings:
            return Snapshot(postings.join(live.select(*keys), keys, "left_semi"), docs, stats(told["n"], told["avgdl"]), self.definition)
        postings = postings.join(live.select("id"), "id", "left_semi")
        dl = postings.groupBy("id").agg(F.sum(F.size("positions")).cast("bigint").alias("dl"))
        both = stats(told["n"], None).select("n").crossJoin(dl.agg(F.avg(F.when(F.col("dl") > 0, F.col("dl"))).alias("avgdl")))
        return Snapshot(postings.drop("dl").join(dl, "id"), docs, both, self.definition)

    # -- lifecycle ----------------------------------------------------------

    def compact(self) -> Segment | None:
        """Merge all segments of the newest version into one of live documents; None where there is nothing to do.

        If another writer has replaced one of them meanwhile, what was written
        is dropped, and the newer version is merged instead.
        """
        while True:
            version = self.version()
            segments = self.segments(version)
            if not segments or len(segments) == 1 and segments[0].clean:
                return None
            live = self.snapshot(version).docs.withColumn("ordinal", F.monotonically_increasing_id())  # each id is there once: the order says nothing more
            made = replace(self.written(live), seq=max(s.seq for s in segments))
            if self.replace(segments, made):
                return made
            self._discard([made])

    def vacuum(self, grace: float = GRACE) -> int:
        """Remove folders older than ``grace`` seconds that the newest manifest doesn't name; returns how many."""
        named = {s.folder for s in self.segments()}
        live = f"v{self.version():010d}"
        gone = [f"{self.root}/{kind}/{n}" for kind in ("docs", "postings", "versions", "tokens", "live") for n in self.files.names(f"{self.root}/{kind}") if n not in named and not n.startswith(live)]
        gone = [p for p in gone if self.files.age(p) >= grace]
        for path in gone:
            self.files.remove(path)
        return len(gone)

    def clear(self) -> None:
        self.files.remove(self.root)
