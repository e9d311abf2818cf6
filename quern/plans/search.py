"""Parsed queries as one DataFrame plan over postings.

Many queries are one plan: their words are a small table that is joined to
the postings of those words alone, and everything about a document and a
query is decided in one aggregation.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.highlight import highlights
from quern.operators.build import column, kind
from quern.operators.predicates import all_of
from quern.plans.parser import Clause, Page, Parsed
from quern.sources.catalog import BM25, TEXT, Definition

#: Folders that postings are divided into by a checksum of the term.
BUCKETS = 16
#: Scores are compared to this many decimals, so that the order of a sum doesn't decide a tie.
DECIMALS = 10

HITS = "qid int, id string, score double"


@dataclass(frozen=True)
class Snapshot:
    """What a search reads, all of one version: postings (term, id, dl, tf, positions), docs, stats (n, avgdl)."""

    postings: DataFrame
    docs: DataFrame
    stats: DataFrame
    definition: Definition


def local(spark: SparkSession, **columns: tuple[Sequence, pa.DataType]) -> DataFrame:
    """A few rows as a relation of the plan itself, which needs no job of its own."""
    return spark.createDataFrame(pa.table({k: pa.array(v, t) for k, (v, t) in columns.items()}))


def bucket(term: str) -> int:
    return zlib.crc32(term.encode()) % BUCKETS


def _positions(word: str) -> Column:
    return F.col("at")[F.lit(word)]


def _follows(first: Column, distance: int, word: str) -> Column:
    return F.exists(first, lambda x: F.array_contains(_positions(word), x + distance))


def phrase_matches(words: Sequence[str], strict: bool = False) -> Column:
    """Whether positions, a map ``at`` by word, hold a phrase.

    Loosely, each later word must follow some occurrence of the first one at
    its distance; strictly, all of them one and the same occurrence.
    """
    first = _positions(words[0])
    present = reduce(lambda a, b: a & b, (_positions(w).isNotNull() for w in words))
    steps = [(i, w) for i, w in enumerate(words) if i]
    if not steps:
        return present
    if strict:
        near = F.exists(first, lambda x: reduce(lambda a, b: a & b, (F.array_contains(_positions(w), x + i) for i, w in steps)))
    else:
        near = reduce(lambda a, b: a & b, (_follows(first, i, w) for i, w in steps))
    return F.coalesce(present & near, F.lit(False))


def bm25(bm25: BM25) -> Column:
    """A posting's share of the score, from df, tf, dl and the corpus's n and avgdl."""
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    avgdl = F.when(F.coalesce(F.col("avgdl"), F.lit(0.0)) > 0, F.col("avgdl")).otherwise(1.0)
    return idf * F.col("tf") * (bm25.k1 + 1) / (F.col("tf") + bm25.k1 * (1 - bm25.b + bm25.b * F.col("dl") / avgdl))


def hits(index: Snapshot, queries: Sequence[Parsed], strict: bool = False) -> DataFrame:
    """``(qid, id, score)`` of all matches of all queries; qid is a query's place in the sequence.

    A query without a positive clause matches nothing. Filters narrow the
    result and leave the statistics alone.
    """
    spark = index.docs.sparkSession
    live = [(i, q) for i, q in enumerate(queries) if q.positive]
    if not live:
        return spark.createDataFrame([], HITS)
    rows, need, phrases = [], [], []
    for i, q in live:
        words = {w: [False, False] for c in q.clauses for w in c.words}
        for w in q.scoring:
            words[w][0] = True
        for c in q.clauses:
            if c.negative and not c.phrase:
                words[c.words[0]][1] = True
        rows += [(i, w, pos, neg) for w, (pos, neg) in words.items()]
        need.append((i, len(q.scoring)))
        phrases += [(i, c) for c in q.clauses if c.phrase]
    terms = sorted({r[1] for r in rows})
    qid, term, scores, excludes = zip(*rows)
    wanted = F.broadcast(local(spark, qid=(qid, pa.int32()), term=(term, pa.string()), scores=(scores, pa.bool_()), excludes=(excludes, pa.bool_())))  # as many rows as the queries have words
    qid, least = zip(*need)
    needed = F.broadcast(local(spark, qid=(qid, pa.int32()), need=(least, pa.int64())))

    found = index.postings.where(F.col("term").isin(terms))
    if "term_bucket" in index.postings.columns:
        found = found.where(F.col("term_bucket").isin(sorted({bucket(t) for t in terms})))
    df = F.broadcast(found.groupBy("term").agg(F.count("*").alias("df")))  # at most one row for each word of the queries
    parts = found.join(df, "term").crossJoin(F.broadcast(index.stats)).withColumn("part", bm25(index.definition.bm25)).join(wanted, "term")
    with_at = [F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at")] if phrases else []
    per = parts.groupBy("qid", "id").agg(
        F.sum(F.when(F.col("scores"), F.col("part"))).alias("score"), F.sum(F.col("scores").cast("int")).alias("has"), F.max("excludes").alias("excluded"), *with_at
    )
    matched = per.join(needed, "qid").where((F.col("has") == F.col("need")) & ~F.col("excluded"))
    if phrases:
        checks: dict[int, list[Column]] = {}
        for i, c in phrases:
            ok = phrase_matches(c.words, strict)
            checks.setdefault(i, []).append(~ok if c.negative else ok)
        rule = reduce(lambda w, kv: w.when(F.col("qid") == kv[0], reduce(lambda a, b: a & b, kv[1])), list(checks.items()), F.when(F.lit(False), F.lit(True)))
        matched = matched.where(rule.otherwise(True))
    matched = matched.select("qid", "id", "score")

    filtered = [(i, q) for i, q in live if q.filters]
    if not filtered:
        return matched
    passing = F.filter(F.array(*[F.when(all_of(index.docs, q.filters), F.lit(i)) for i, q in filtered]), lambda x: x.isNotNull())
    allowed = index.docs.select("id", F.explode(passing).alias("qid"))
    narrowed = matched.where(F.col("qid").isin([i for i, _ in filtered])).join(allowed, ["qid", "id"], "left_semi")
    if len(filtered) == len(live):
        return narrowed
    return narrowed.union(matched.where(~F.col("qid").isin([i for i, _ in filtered])))


def ranked(found: DataFrame, page: Page) -> DataFrame:
    """A page of one query's hits: best first, ties in the order of their ids."""
    return found.orderBy(F.desc(F.round("score", DECIMALS)), F.asc("id")).offset(page.offset).limit(page.size)


def ranked_each(found: DataFrame, page: Page) -> DataFrame:
    """The same page of every query's hits, with their ranks."""
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(F.round("score", DECIMALS)), F.asc("id")))
    return found.withColumn("rank", rank).where((F.col("rank") > page.offset) & (F.col("rank") <= page.offset + page.size))


def with_source(index: Snapshot, page: DataFrame, query: Parsed) -> DataFrame:
    """A page's hits with their documents and highlights, both made above the join, for these few rows alone."""
    docs = index.docs
    texts = [n for n, f in sorted(index.definition.fields.items()) if f.type == TEXT and n in docs.columns and isinstance(kind(docs, n), T.StringType)]
    hidden = {"segment_id", "segment_seq", "ordinal"}
    shown = [F.col(f"`{c}`") for c in docs.columns if c not in hidden]
    few = F.broadcast(page.select(F.col("id").alias("__hit"), F.col("score").alias("__score")))  # a page has at most 100 rows
    joined = docs.join(few, docs["id"] == F.col("__hit"))
    return joined.select("id", F.col("__score").alias("score"), highlights([(n, column(docs, n)) for n in texts], query.scoring).alias("highlights"), F.struct(*shown).alias("source"))


def words(clause: str) -> Clause:
    return Clause(tuple(clause.split()), " " in clause)
