"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import remove, written


def components(edges: DataFrame) -> tuple[DataFrame, list[str]]:
    """``(node, comp)`` for every end of an edge ``(a, b)``: comp is the least node that is connected to it.

    Large-star and small-star steps in turn, each round written to the shared
    folder, until nothing changes. Returns the folder to remove with it.
    """
    spark = edges.sparkSession
    e, path = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "star")
    mark = None
    while True:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("a", F.col("m").alias("b"))).distinct()
        e, new = written(small, "star")
        remove(spark, path)
        path = new
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    return nodes.union(e.select(F.col("b").alias("node"), F.col("b").alias("comp"))).distinct(), [path]
