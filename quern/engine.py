"""The engine: named indexes, ingest, search, compaction."""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.metrics import Metrics
from quern.operators import build
from quern.plans import search as plans
from quern.plans.parser import Page, Parsed, parse
from quern.sources.catalog import Catalog, CreateRequest, Definition
from quern.sources.config import Config
from quern.sources.segments import Segment, Segments, should_merge
from quern.sources.storage import Files
from quern.streaming.merging import Merger


@dataclass(frozen=True)
class Ingested:
    indexed: int
    segment_ids: tuple[str, ...]
    errors: tuple[str, ...]


@dataclass(frozen=True)
class Answer:
    """A page of hits (id, score, highlights, source), best first, and how many there are in all."""

    total: int
    page: int
    size: int
    hits: DataFrame
    taken_ms: float


def id_errors(docs: DataFrame) -> DataFrame:
    """``docs`` with ``error``: null for a good id, else why the row can't be indexed."""
    if "id" not in docs.columns:
        return docs.withColumn("error", F.lit("document has no id"))
    of = build.kind(docs, "id")
    if isinstance(of, T.NullType):
        return docs.withColumn("error", F.lit("document has no id"))
    if not isinstance(of, T.StringType):
        return docs.withColumn("error", F.when(F.col("id").isNull(), "document has no id").otherwise("document id isn't a string"))
    return docs.withColumn("error", F.when(F.col("id").isNull(), "document has no id").when(F.col("id") == "", "document id is empty"))


def request_error(row: object) -> str | None:
    """Why a document of a request can't be indexed; null for a good one."""
    if not isinstance(row, dict):
        return "document isn't an object"
    if row.get("id") is None:
        return "document has no id"
    if not isinstance(row["id"], str):
        return "document id isn't a string"
    return None if row["id"] else "document id is empty"


class Engine:
    def __init__(self, spark: SparkSession, root: str, catalog_folder: str | None = None, config: Config | None = None):
        """``root`` holds the data, on a file system that all executors share; the catalog too, unless a folder of the driver's is given."""
        self.spark, self.root, self.config = spark, root.rstrip("/"), config or Config()
        files = Files(spark, root) if catalog_folder is None else None
        self.catalog = Catalog(catalog_folder or f"{self.root}/_catalog", self.config.tokenizer, self.config.bm25, files)
        self.metrics = Metrics()
        self.merger: Merger | None = None
        self._noting = threading.Lock()

    # -- catalog ------------------------------------------------------------

    def create_index(self, request: CreateRequest | dict) -> Definition:
        return self.catalog.create(CreateRequest.from_dict(request) if isinstance(request, dict) else request)

    def list_indexes(self) -> list[Definition]:
        return self.catalog.list()

    def get_index(self, name: str) -> Definition:
        return self.catalog.get(name)

    def segments(self, name: str) -> Segments:
        return Segments(self.spark, f"{self.root}/{name}", self.get_index(name))

    def stats(self, name: str) -> dict:
        own = self.segments(name).segments()
        return {"name": name, "docCount": sum(s.documents for s in own), "segments": [{"id": s.id, "documentCount": s.documents} for s in own]}

    # -- ingest -------------------------------------------------------------

    def index_documents(self, name: str, docs: DataFrame, segment_id: str | None = None, applied: int | None = None) -> Ingested:
        """Add a table as one segment, visible at once; rows without a proper id are reported and left out.

        Texts of errors are collected by kind, with a count, not by row.
        """
        began = time.time()
        segments = self.segments(name)
        judged = id_errors(docs)
        bad = judged.where(F.col("error").isNotNull()).groupBy("error").count().collect()  # a row for each kind of error
        errors = tuple(f"{r['error']} ({r['count']})" for r in sorted(bad))
        good = judged.where(F.col("error").isNull()).drop("error")
        made = segments.write(good, applied, segment_id) if "id" in docs.columns and isinstance(build.kind(docs, "id"), T.StringType) else None
        return self._ingested(name, segments, [made] if made else [], errors, began)

    def index_request(self, name: str, rows: Sequence[object]) -> Ingested:
        """Add the documents of a request, in its order: a new segment whenever the thresholds of the configuration are reached.

        All of them are visible at once. Errors tell the document's place.
        """
        began = time.time()
        segments = self.segments(name)
        errors, good = [], []
        for i, row in enumerate(rows):
            wrong = request_error(row)
            errors += [f"doc {i}: {wrong}"] * bool(wrong)
            good += [] if wrong else [json.dumps(row)]
        made: list[Segment] = []
        if good:
            docs = self.spark.read.json(self.spark.sparkContext.parallelize(good, 1))
            docs = docs.drop("ordinal").withColumn("ordinal", F.monotonically_increasing_id()).persist()
            try:
                cut = self.flush_plan(name, docs.select("ordinal", *[f"`{c}`" for c in docs.columns if c != "ordinal"]), ["ordinal"]).select("ordinal", "segment").persist()
                for k in range(cut.agg(F.max("segment")).first()[0] + 1):
                    made.append(segments.written(docs.join(cut.where(F.col("segment") == k), "ordinal", "left_semi")))
                cut.unpersist()
            finally:
                docs.unpersist()
            made = segments.add(made)
        return self._ingested(name, segments, made, tuple(errors), began)

    def _ingested(self, name: str, segments: Segments, made: list[Segment], errors: tuple[str, ...], began: float) -> Ingested:
        done = Ingested(sum(s.documents for s in made), tuple(s.id for s in made), errors)
        self.metrics.count("index_documents_total", done.indexed, index=name)
        self.metrics.observe("index_latency_ms", (time.time() - began) * 1000, index=name)
        if errors:
            self.metrics.count("index_errors_total", len(errors), index=name)
        self._note(name, segments)
        if should_merge(segments.segments(), self.config.merge_threshold):
            if self.merger:
                self.merger.request(name)
            elif self.config.merge_interval == 0:
                self.compact(name)
        return done

    def flush_plan(self, name: str, docs: DataFrame, order: Sequence[str]) -> DataFrame:
        """Where the thresholds of the configuration would cut a request into segments."""
        sized = docs.withColumn("__tokens", F.size(build.field_tokens(docs, self.get_index(name))))
        return build.flush(sized, "__tokens", self.config.flush_max_documents, self.config.flush_max_postings, order).drop("__tokens")

    def delete(self, name: str, ids: DataFrame) -> Ingested:
        """Tombstones for a table of ids."""
        return self.index_documents(name, ids.select("id", F.lit(True).alias("_deleted")))

    def compact(self, name: str) -> Segment | None:
        segments = self.segments(name)
        made = segments.compact()
        self._note(name, segments)
        return made

    def compact_if_due(self, name: str) -> Segment | None:
        due = should_merge(self.segments(name).segments(), self.config.merge_threshold)
        return self.compact(name) if due else None

    def start_merging(self) -> Merger:
        """Merge in the background from now on, when it is due and at the interval of the configuration."""
        if self.merger is None:
            self.merger = Merger(self.compact, lambda: [d.name for d in self.list_indexes()], self.config.merge_interval)
        return self.merger

    def close(self) -> None:
        if self.merger:
            self.merger.close()
            self.merger = None

    def _note(self, name: str, segments: Segments) -> None:
        with self._noting:
            manifest = segments.manifest()
            own = [Segment(**s) for s in manifest["segments"]]
            self.metrics.gauge("segments", len(own), index=name)
            self.metrics.gauge("wal_offset_bytes", manifest["bytes"], index=name)
            told = tuple({"id": s.id, "document_count": s.documents} for s in own)
            self.catalog.update(replace(self.get_index(name), doc_count=sum(s.documents for s in own), segments=told))

    # -- search -------------------------------------------------------------

    def snapshot(self, name: str, stale_postings: bool = False) -> plans.Snapshot:
        return self.segments(name).snapshot(stale_postings=stale_postings)

    def search(self, name: str, q: str, filters: str = "", page: int = 1, size: int = 10, phrase_mode: str = "loose", snapshot: plans.Snapshot | None = None) -> Answer:
        began = time.time()
        query, where = parse(q, filters), Page(page, size)
        index = snapshot or self.snapshot(name)
        found = plans.hits(index, [query], phrase_mode == "strict").persist()
        try:
            total = found.count()
            top = plans.ranked(found, where).drop("qid").collect() if total else []  # a page has at most 100 rows
        finally:
            found.unpersist()
        hits = plans.with_source(index, self.spark.createDataFrame(top, "id string, score double"), query)
        hits = hits.orderBy(F.desc(F.round("score", plans.DECIMALS)), "id")
        taken = (time.time() - began) * 1000
        self.metrics.count("search_requests_total", index=name)
        self.metrics.observe("search_latency_ms", taken, index=name)
        return Answer(total, where.number, where.size, hits, taken)

    def search_many(self, name: str, queries: Sequence[tuple[str, str]], page: int = 1, size: int = 10) -> DataFrame:
        """``(qid, rank, id, score)`` for many (q, filters) in one plan."""
        parsed: list[Parsed] = [parse(q, f) for q, f in queries]
        return plans.ranked_each(plans.hits(self.snapshot(name), parsed), Page(page, size))

    def ready(self) -> dict:
        """How many indexes there are and how many of them can be read; ``ready`` if it is all, and merging hasn't died."""
        try:
            names = [d.name for d in self.list_indexes()]
        except Exception:
            return {"ready": False, "registry": 0, "engines": 0}
        able = 0
        for name in names:
            try:
                segments = self.segments(name)
                able += all(segments.files.exists(f"{segments.root}/docs/{s.folder}") for s in segments.segments())
            except Exception:
                continue
        return {"ready": able == len(names) and (self.merger is None or self.merger.alive()), "registry": len(names), "engines": able}
