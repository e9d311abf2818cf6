"""Near-duplicate embeddings by NN-descent.

A neighbour graph is begun with the nearest rows in buckets of a few random
sign hashes and refined: each round joins the neighbours of a row, and the
rows that it is a neighbour of, with each other, where one of the two is new
to it. A list that is saturated, having only near-duplicates, is enlarged: it
keeps all of them. There are as many hashes as let any pair at the threshold
meet with the wanted probability, whatever else the table holds. An audit
compares a sample of rows with brute force over all; while recall is too low,
lists are doubled, more hashes added and rounds run. Edges at or above the
threshold are the result: the links of each row, and the classes that they
connect. Equal vectors are one row of the graph from the start.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import importable, partitions, remove, table, written
from quern.llm.graphs import components
from quern.llm.vectors import stacked, usable

THRESHOLD = 0.9
NEIGHBOURS = 10
#: Hashes whose buckets are made at once.
HASHES = 8
#: Rows that a bucket of a hash has on average, and rows of it that are compared in one piece.
BUCKET, PIECE = 64, 4096
#: Large buckets that there can be at most where they are joined by broadcast.
MOST_LARGE = 100_000
#: The recall that hashes are made for and that the audit must show, and attempts to reach it.
RECALL, ATTEMPTS = 0.95, 4
#: Rows with a near duplicate that the audit needs, and rows that it begins with and samples at most (for measuring only).
EVIDENCE, AUDIT, AUDIT_MOST = 200, 256, 16_384
#: Where the audit finds too few such rows, the probability with which the hashes must let a pair at the threshold meet.
SURE = 0.99
#: What the cosine of a pair may differ by when it is computed in another product.
ROUNDING = 1e-6
#: A refinement ends when a round adds less than this share of near-duplicate edges.
SETTLED, ROUNDS = 0.001, 6

_EDGES = "u bigint, v bigint, sim double"


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def _table(u, v, s) -> pa.Table:
    return pa.table({"u": pa.array(np.asarray(u, np.int64)), "v": pa.array(np.asarray(v, np.int64)), "sim": pa.array(np.asarray(s, np.float64))})


def meeting(bits: int, t: float, hashes: int) -> float:
    """The probability that two rows of cosine t are in one bucket of some of the hashes, of so many signs each."""
    p = (1 - math.acos(max(-1.0, min(1.0, t))) / math.pi) ** bits
    return 1 - (1 - p) ** hashes


def hashes_for(bits: int, t: float, recall: float = RECALL) -> int:
    """The least number of hashes with which two rows of cosine t meet with the probability ``recall``."""
    p = meeting(bits, t, 1)
    if p >= recall:
        return 1
    return math.ceil(math.log1p(-recall) / math.log1p(-p)) if p > 0 else 1 << 62


def bits_for(count: int, t: float) -> int:
    """Signs of a hash: for buckets of ``BUCKET`` rows, but so few that hashes don't cost more than comparing all rows."""
    bits = max(0, math.ceil(math.log2(max(1, count) / BUCKET)))
    while bits and hashes_for(bits, t) > 1 << bits:
        bits -= 1
    return bits


def begin(rows: DataFrame, count: int, k: int, t: float, hashes: int, seed: int) -> tuple[DataFrame, str]:
    """``(u, v, sim)``: per bucket of each hash, the k nearest of every row, and all that are near duplicates; and the folder that it reads."""
    bits = bits_for(count, t)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = stacked(b.column(1))
            n, ids = len(x), b.column(0)
            if not n:
                continue
            planes = np.random.default_rng(seed).standard_normal((hashes, x.shape[1], bits))
            codes = [((x @ p > 0) @ (1 << np.arange(bits, dtype=np.int64))).astype(np.int64) if bits else np.zeros(n, np.int64) for p in planes]
            for h, code in enumerate(codes):
                yield pa.RecordBatch.from_arrays([pa.array(code * hashes + h, pa.int64()), ids, b.column(1)], names=["bucket", "id", "v"])

    def nearest(group: pa.Table) -> pa.Table:
        """Of a bucket, or of two pieces of a large one: rows of the first piece against those of both, or of the second."""
        first, second = group["piece"][0].as_py(), group["other"][0].as_py()
        ids, own, x = group["id"].to_numpy(), group["own"].to_numpy(), _unit(stacked(group["v"].combine_chunks()))
        left, right = np.flatnonzero(own == first), np.flatnonzero(own == second)
        u, v, s = [], [], []
        for step in range(0, len(left), 512):
            here = left[step : step + 512]
            sim = x[here] @ x[right].T
            if first == second:
                sim[np.arange(len(here)), np.arange(step, step + len(here))] = -2
            for a, b, m in ((here, right, sim), *([(right, here, sim.T)] if first != second else [])):
                few = min(k, m.shape[1] - (first == second))
                if few < 1:
                    continue
                edge = -np.partition(-m, few - 1, axis=1)[:, few - 1]
                i, j = np.nonzero((m >= np.minimum(edge, t)[:, None]) & (m > -1.5))
                u.append(ids[a[i]])
                v.append(ids[b[j]])
                s.append(m[i, j])
        empty = np.zeros(0)
        return _table(np.concatenate([*u, empty]), np.concatenate([*v, empty]), np.concatenate([*s, empty]))

    buckets, at = written(rows.mapInArrow(hashed, "bucket bigint, id bigint, v array<float>"), "buckets")
    # A bucket of more than PIECE rows, as that of a large group, is cut into pieces, and each two of them are a task.
    large = buckets.groupBy("bucket").count().where(F.col("count") > PIECE).select("bucket", F.ceil(F.col("count") / PIECE).cast("int").alias("pieces"))
    cut = buckets.join(F.broadcast(large) if count * hashes <= MOST_LARGE * PIECE else large, "bucket", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    cut = cut.withColumn("own", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int"))
    met = cut.withColumn("met", F.explode(F.when(F.col("pieces") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("pieces") - 1))))
    tasks = met.select("bucket", "id", "v", "own", F.least("own", "met").alias("piece"), F.greatest("own", "met").alias("other"))
    found = tasks.groupBy("bucket", "piece", "other").applyInArrow(nearest, _EDGES).where("u <> v").dropDuplicates(["u", "v"])
    return found, at


def shortened(edges: DataFrame, k: int, t: float) -> DataFrame:
    """Per row the k nearest, and all near duplicates beyond them."""
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v"))
    return edges.withColumn("r", rank).where((F.col("r") <= k) | (F.col("sim") >= t)).drop("r")


def refined(graph: DataFrame, rows: DataFrame, k: int, t: float) -> DataFrame:
    """One round: ``graph`` (u, v, sim, new) with what its neighbours' neighbours add.

    Into the join of a row go its k nearest, k more of its near duplicates and
    k of the rows that it is a neighbour of, the latter two new ones first and
    then in the order of a hash. An edge stays new until it has been in the
    join of its row.
    """
    near = Window.partitionBy("u").orderBy(F.desc("sim"), "v")
    some = Window.partitionBy("u").orderBy(F.desc("new"), F.xxhash64("u", "v"))
    ranked = graph.withColumn("r", F.row_number().over(near)).withColumn("h", F.row_number().over(some)).withColumn("in", (F.col("r") <= k) | (F.col("h") <= k))
    out = ranked.where("in").select("u", "v", "new")
    back = graph.select(F.col("v").alias("u"), F.col("u").alias("v"), "new").withColumn("h", F.row_number().over(some)).where(F.col("h") <= k).drop("h")
    lists = out.union(back).groupBy("u", "v").agg(F.max("new").alias("new"))
    worst = graph.withColumn("r", F.row_number().over(near)).where(F.col("r") == k).select(F.col("u").alias("id"), F.col("sim").alias("worst"))
    known = rows.join(worst, "id", "left").select(F.col("id").alias("v"), F.col("v").alias("x"), F.coalesce("worst", F.lit(-2.0)).alias("worst"))
    joined = lists.join(known, "v").repartition(partitions(rows.sparkSession), "u").sortWithinPartitions("u", "v").select("u", "v", "new", "worst", "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def join(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
            ids, new, worst = (np.concatenate([p.column(c).to_numpy(zero_copy_only=False) for p in parts]) for c in (1, 2, 3))
            x = _unit(np.concatenate([stacked(p.column(4)) for p in parts]))
            sim = x @ x.T
            i, j = np.nonzero(np.triu(new[:, None] | new[None, :], 1) & ((sim > worst[:, None]) | (sim > worst[None, :]) | (sim >= t)))
            return ids[i], ids[j], sim[i, j]

        def emit(found: list) -> pa.RecordBatch:
            a, b, s = (np.concatenate(c) for c in zip(*found))
            both = np.unique(np.stack([np.concatenate([a, b]), np.concatenate([b, a])], 1), axis=0, return_index=True)[1]
            return _table(np.concatenate([a, b])[both], np.concatenate([b, a])[both], np.concatenate([s, s])[both]).combine_chunks().to_batches()[0]

        held: list[pa.RecordBatch] = []
        found: list = []
        for b in batches:
            u = b.column(0).to_numpy()
            edge = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]])) if len(u) else []
            for s, e in zip(edge, [*edge[1:], len(u)]):
                part = b.slice(s, e - s)
                if held and held[0].column(0)[0].as_py() != u[s]:
                    found.append(join(held))
                    held = []
                held.append(part)
            if sum(len(f[0]) for f in found) > 200_000:
                yield emit(found)
                found = []
        if held:
            found.append(join(held))
        if found and sum(len(f[0]) for f in found):
            yield emit(found)

    more = joined.mapInArrow(run, _EDGES).withColumn("new", F.lit(True))
    merged = ranked.select("u", "v", "sim", (F.col("new") & ~F.col("in")).alias("new")).union(more).groupBy("u", "v").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
    return shortened(merged, k, t)


class Audit(NamedTuple):
    """Mean recall of the sampled rows that have a near duplicate, how many these are, and whether all rows were sampled."""

    recall: float
    rows: int
    whole: bool


def audited(graph: DataFrame, rows: DataFrame, t: float, enough: int = EVIDENCE, most: int = AUDIT_MOST) -> Audit:
    """What share of a row's near duplicates, found by brute force over all rows, the graph has, as the mean over a sample.

    The sample grows until ``enough`` of it have a near duplicate, or it has ``most`` rows or all.
    """
    count = rows.count()
    share = min(1.0, most / max(1, count))
    picked = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))).toArrow()  # a bounded sample of vectors
    order = np.argsort(picked["id"].to_numpy())
    order = order[np.random.default_rng(0).permutation(len(order))]
    every, vectors = picked["id"].to_numpy()[order], _unit(stacked(picked["v"].combine_chunks()))[order]
    edges = graph.where(F.col("sim") >= t).select("u", "v", F.lit(1).alias("hit"))

    def compared(ids: np.ndarray, x: np.ndarray) -> tuple[float, int]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                own, y = b.column(0).to_numpy(), _unit(stacked(b.column(1), x.shape[1]))
                for a in range(0, len(ids), 512):
                    sim = x[a : a + 512] @ y.T
                    i, j = np.nonzero((sim >= t + ROUNDING) & (ids[a : a + 512, None] != own[None, :]))
                    yield from _table(ids[a + i], own[j], sim[i, j]).to_batches()

        each = rows.mapInArrow(run, _EDGES).join(edges, ["u", "v"], "left").groupBy("u").agg((F.count("hit") / F.count("*")).alias("recall"))
        got = each.agg(F.sum("recall").alias("recalls"), F.count("*").alias("n")).first()
        return got["recalls"] or 0.0, got["n"]

    recalls, n, done, size = 0.0, 0, 0, AUDIT
    while done < len(every) and n < enough:
        more = compared(every[done:size], vectors[done:size])
        recalls, n = recalls + more[0], n + more[1]
        done, size = min(size, len(every)), 4 * size
    return Audit(recalls / n if n else 1.0, n, done == count)


def accepted(audit: Audit, sure: float) -> bool:
    """Whether the audit shows the recall; too few rows with a near duplicate show it only together with enough hashes."""
    return audit.recall >= RECALL and (audit.whole or audit.rows >= EVIDENCE or sure >= SURE)


class Found(NamedTuple):
    """members: ``(id, rep, alone)``, which vector stands for that of an id, and whether it is one of zeros; graph: ``(u, v, sim)`` both ways."""

    members: DataFrame
    graph: DataFrame


def search(table: DataFrame, t: float = THRESHOLD, k: int = NEIGHBOURS, id_column: str = "vec_id", column: str = "embedding") -> Found:
    """The neighbour graph at the threshold.

    Approximate: any pair is found with a probability of at least 95 %, and
    the mean recall of the audit's rows is at least that. Each attempt takes
    as many hashes again; if the audit fails after the last of ``ATTEMPTS``,
    by when a pair is missed with a probability of (1 - ``RECALL``) to the
    power of ``ATTEMPTS``, that is an error and nothing is returned.
    """
    spark = table.sparkSession
    importable(spark)
    every, _ = written(usable(table, id_column, column), "vectors")
    kinds = every.groupBy("v").agg(F.min("id").alias("rep"))
    alone = ~F.exists("v", lambda x: x != 0)
    members = every.join(kinds, "v").select("id", "rep", alone.alias("alone"))
    members, _ = written(members, "members")
    rows, _ = written(kinds.where(~alone).select(F.col("rep").alias("id"), "v"), "kinds")
    count = rows.count()
    bits = bits_for(count, t)
    hashes, seeds = hashes_for(bits, t), 0
    graph = path = None
    for attempt in range(ATTEMPTS):
        for made in range(0, hashes, HASHES):
            more, at = begin(rows, count, k, t, min(HASHES, hashes - made), seeds)
            more = more.withColumn("new", F.lit(True))
            if graph is not None:
                more = graph.union(more).groupBy("u", "v").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
            graph, new_path = written(shortened(more, k, t), "graph")
            remove(spark, at, *([path] if path else []))
            path, seeds = new_path, seeds + 1
        near = graph.where(F.col("sim") >= t).count()
        for _ in range(ROUNDS):
            graph, new_path = written(refined(graph, rows, k, t), "graph")
            remove(spark, path)
            path, before = new_path, near
            near = graph.where(F.col("sim") >= t).count()
            if near - before <= SETTLED * max(1, near):
                break
        audit = audited(graph, rows, t)
        if accepted(audit, meeting(bits, t, hashes * (attempt + 1))):
            break
        if audit.recall < RECALL:
            k *= 2
    else:
        raise RuntimeError(f"after {ATTEMPTS * hashes} hashes the audit of {audit.rows} rows still shows a recall of {audit.recall:.3f}; {RECALL} is wanted")
    edges = graph.where(F.col("sim") >= t)
    both = edges.select("u", "v", "sim").union(edges.select("v", "u", "sim"))
    return Found(members, both.groupBy("u", "v").agg(F.max("sim").alias("sim")))


def near_duplicates(table: DataFrame, t: float = THRESHOLD, k: int = NEIGHBOURS, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``(id_a, id_b, similarity)``, id_a < id_b: pairs of different vectors with a cosine of at least t, found as ``search`` says.

    Of equal vectors the least id stands for all, and each other one is paired
    with it alone. Rows that ``vectors.usable`` leaves out are in no pair, nor
    is a vector of zeros, whose cosine counts as 0. Repeated rows are one. An
    empty table gives no pairs; other columns don't matter.
    """
    found = search(table, t, k, id_column, column)
    pairs = found.graph.where("u < v").toDF("id_a", "id_b", "similarity")
    return pairs.union(found.members.where("id <> rep AND NOT alone").select("rep", "id", F.lit(1.0)))


def classes(table: DataFrame, t: float = THRESHOLD, k: int = NEIGHBOURS, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``(vec_id, class_id, links)``: one row for each usable vector, with the pairs that ``search`` finds.

    links: how many other rows have a cosine of at least t with it, equal
    vectors counted each. class_id: the least id that a chain of links leads
    to, its own where there is none. What ``near_duplicates`` says of odd rows
    holds here: those left out give no row, a vector of zeros has no links.
    """
    members, graph = search(table, t, k, id_column, column)
    size = members.groupBy("rep").agg(F.count("*").alias("size"), F.max("alone").alias("alone"))
    around = graph.join(size.select(F.col("rep").alias("v"), "size"), "v").groupBy(F.col("u").alias("rep")).agg(F.sum("size").alias("around"))
    nodes, _ = components(graph.where("u < v").select(F.col("u").alias("a"), F.col("v").alias("b")))
    told = size.join(around, "rep", "left").join(nodes.withColumnRenamed("node", "rep"), "rep", "left")
    links = F.when(F.col("alone"), 0).otherwise(F.col("size") - 1 + F.coalesce("around", F.lit(0)))
    told = told.select("rep", links.cast("bigint").alias("links"), F.coalesce("comp", "rep").alias("comp"))
    alone = members.join(told, "rep")
    return alone.select(F.col("id").alias("vec_id"), F.when(F.col("alone"), F.col("id")).otherwise(F.col("comp")).alias("class_id"), "links")


def op5_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = f"""
WITH RECURSIVE p AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= {THRESHOLD}),
r(vec_id, to_id) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, p.b FROM r JOIN p ON p.a = r.to_id)
SELECT e.vec_id, (SELECT min(to_id) FROM r WHERE r.vec_id = e.vec_id) AS class_id, (SELECT count(*) FROM p WHERE p.a = e.vec_id) AS links FROM embeddings e
"""
