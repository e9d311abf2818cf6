"""Exact top-k by inner product, with Fagin's threshold algorithm.

The rows are cut into parts of bounded size. A task sorts the rows of a part
along every dimension and streams queries past them. A query reads the lists in
rounds, each from the end that its sign in that dimension favours; what it
meets for the first time is scored in full. No row that it hasn't met can
score more than the threshold: the sum, over dimensions, of its weight times
the value that the list has come to. It stops where that is below its k-th
best. In a round those lists are read on, twice as deep as before, that lower
the threshold most for the rows they show. A query begins with the part that its own
row is in; the k-th best from there lets it stop earlier in all others.

The dimensions are the principal axes of a bounded sample of the rows: a
rotation changes no inner product, and gathers in few lists what tells rows
apart. Where no direction tells more than others, as in random vectors, the
threshold falls late and most rows are met before it does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import importable, partitions, table, written
from quern.llm.vectors import stacked, usable

K = 10
#: Of the rows, those whose id is divisible by this are the queries.
EVERY = 50
#: Numbers that a part has at most, rows that it should have at least, and rows that the axes are taken from at most.
NUMBERS, LEAST, SAMPLE = 1 << 22, 4096, 8192
#: Depth to which a list is read first, and the share of the greatest gain at which a list is read on in a round.
FIRST, GAIN = 16, 0.25
#: Decimals to which scores are compared; equal ones are in the order of their ids.
DECIMALS = 9


def principal(x: np.ndarray) -> np.ndarray:
    """An orthogonal matrix whose columns are the axes of x, the one of greatest spread first."""
    values, axes = np.linalg.eigh(x.T.astype(np.float64) @ x) if len(x) else (np.zeros(x.shape[1]), np.eye(x.shape[1]))
    return axes[:, np.argsort(-values, kind="stable")]


class Lists:
    """The rows of one part, and lists of them sorted along every axis."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, axes: np.ndarray | None = None):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], np.ascontiguousarray(x[order], np.float64)
        self.axes = np.eye(x.shape[1]) if axes is None else axes
        y = (self.x @ self.axes).T
        self.down = np.argsort(-y, 1, kind="stable").astype(np.int32)  # by axis, greatest value first
        self.values = np.take_along_axis(y, self.down, 1)

    def top(self, own: int, q: np.ndarray, k: int, floor: float = -np.inf) -> tuple[np.ndarray, np.ndarray, int]:
        """(ids, scores, rows met) of the k best of at least ``floor``, without the id ``own``."""
        q, n = q.astype(np.float64), len(self.ids)
        if not n:
            return self.ids, np.zeros(0), 0
        weights = q @ self.axes
        up, every = weights > 0, np.arange(len(weights))
        mine = np.searchsorted(self.ids, own)
        mine = mine if mine < n and self.ids[mine] == own else -1
        met, count, kth = np.zeros(n, bool), 0, floor
        rows, scores = np.zeros(0, np.int64), np.zeros(0)

        def bounds(depths: np.ndarray) -> np.ndarray:
            """What a row that none of the lists has shown can gain in each dimension."""
            last = np.maximum(depths, 1)
            return weights * self.values[every, np.where(up, last - 1, n - last)]

        depths = np.zeros(len(weights), np.int64)
        now = bounds(depths)
        while count < n and now.sum() >= kth - 2 * 10.0**-DECIMALS:
            deeper = np.minimum(n, np.maximum(FIRST, 2 * depths))
            then = bounds(deeper)
            # The lists that lower the threshold most for what is read of them; a list that can't lower it comes last.
            gain = np.where(depths < n, (now - then) / np.maximum(1, deeper - depths), -1.0)
            chosen = np.flatnonzero(gain >= GAIN * gain.max()) if gain.max() > 0 else np.flatnonzero(depths < n)
            shown = np.concatenate([self.down[j, depths[j] : deeper[j]] if up[j] else self.down[j, n - deeper[j] : n - depths[j]] for j in chosen])
            before = met.copy()
            met[shown] = True
            new = np.flatnonzero(met & ~before)
            count += len(new)
            depths[chosen], now[chosen] = deeper[chosen], then[chosen]
            if not len(new):
                continue
            got = np.round(self.x[new] @ q, DECIMALS)
            fine = (got >= kth) & (new != mine)
            rows, scores = np.concatenate([rows, new[fine]]), np.concatenate([scores, got[fine]])
            if len(rows) > k:
                best = np.lexsort((rows, -scores))[:k]
                rows, scores = rows[best], scores[best]
            if len(rows) == k:
                kth = max(floor, scores.min())
        best = np.lexsort((rows, -scores))
        return self.ids[rows[best]], scores[best], count


def search(table: DataFrame, k: int = K, id_column: str = "vec_id", column: str = "embedding", every: int = EVERY, numbers: int = NUMBERS, least: int = LEAST) -> DataFrame:
    """``(query_id, rank, neighbor_id, score)``: for every query row the k others of greatest inner product.

    Queries are the rows whose id is divisible by ``every``; all rows are
    searched. Scores are compared to nine decimals, ties go to the lower id.
    Rows that ``vectors.usable`` leaves out are neither queries nor
    neighbours; a table of fewer than k + 1 rows gives shorter lists, an empty
    one none. Other columns don't matter.

    Each row is shipped twice, each query once to each part; the parts' number
    grows with the rows, so that queries shipped grow with rows times queries,
    divided by the rows of a part.
    """
    spark = table.sparkSession
    importable(spark)
    rows, _ = written(usable(table, id_column, column), "vectors")
    some = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()  # a bounded sample of vectors
    n, some = rows.count(), stacked(some["v"].combine_chunks())
    axes, dims = principal(some), some.shape[1]
    parts = max(1, -(-n * dims // numbers), min(partitions(spark), n // max(1, least)))
    part = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    data = rows.select(part.alias("part"), F.lit(0).alias("side"), "id", "v", F.lit(0.0).alias("floor"))
    asked = rows.where(F.col("id") % every == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, lists = None, [], None
        for batch in batches:
            where, side = batch["part"].to_numpy(), batch["side"].to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], (where[1:] != where[:-1]) | (side[1:] != side[:-1])])) if len(where) else []
            for a, b in zip(edges, [*edges[1:], len(where)]):
                piece = batch.slice(a, b - a)
                if where[a] != here:
                    here, held, lists = where[a], [], None
                if side[a] == 0:
                    held.append((piece["id"].to_numpy(), stacked(piece["v"])))
                    continue
                if lists is None:
                    lists = Lists(np.concatenate([i for i, _ in held] or [np.zeros(0, np.int64)]), np.concatenate([x for _, x in held] or [np.zeros((0, dims), np.float32)]), axes)
                    held = []
                ids, floors = piece["id"].to_numpy(), piece["floor"].to_numpy()
                found = [lists.top(own, q, k, floor) for own, q, floor in zip(ids, stacked(piece["v"]), floors)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(ids, [len(f[0]) for f in found]).astype(np.int64)), pa.array(np.concatenate([f[0] for f in found]).astype(np.int64)), pa.array(np.concatenate([f[1] for f in found]).astype(np.float64)),
                ], names=["query_id", "neighbor_id", "score"])

    def found_by(queries: DataFrame) -> DataFrame:
        both = data.union(queries.select("part", F.lit(1), "id", "v", "floor"))
        count = min(parts, 8 * partitions(spark))
        placed = both.repartitionById(count, F.col("part") % count).sortWithinPartitions("part", "side", "id")
        return placed.mapInArrow(run, "query_id bigint, neighbor_id bigint, score double")

    home, _ = written(found_by(asked.select(part.alias("part"), "id", "v", F.lit(float("-inf")).alias("floor"))), "home")
    floors = home.groupBy("query_id").agg(F.min("score").alias("floor"), F.count("*").alias("got")).where(F.col("got") >= k).select(F.col("query_id").alias("id"), "floor")
    away = asked.join(floors, "id", "left").select(part.alias("own"), "id", "v", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
    away = away.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).where("part <> own")
    found = home.union(found_by(away)) if parts > 1 else home
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "neighbor_id"))
    return found.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= k).select("query_id", "rank", "neighbor_id", "score")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings")).withColumn("score", F.round("score", 6))


ORACLE_SQL = f"""
WITH s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id, round(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), {DECIMALS}) AS s
  FROM embeddings a JOIN embeddings b ON a.vec_id % {EVERY} = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, neighbor_id) AS rank FROM s)
SELECT query_id, rank, neighbor_id, round(s, 6) AS score FROM r WHERE rank <= {K}
"""
