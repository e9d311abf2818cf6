"""Mixing sources to target weights by temperature.

Token shares of the sources are raised to an exponent between 0 and 1 and
normalised. The exponent is bisected: as near to 1 as an entropy target
allows, or as far from it as a limit on repetition allows. The weights become
token budgets; every source is read in the order of a hash, again and again
until its budget is spent, and its stream is cut evenly over all blocks.
Within a block, rows are permuted by another hash.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import fresh, table, written

STEPS = 40
#: A token is a run of characters other than blanks and ASCII white space.
TOKEN = "[^ \\t-\\r]+"
#: Sources up to this many are joined by broadcast.
BROADCAST_SOURCES = 10_000


@dataclass(frozen=True)
class Target:
    """What the exponent is bisected for, and how the budget is spent.

    entropy: share of the greatest possible entropy, ln(sources), that the
    weights must have. repeats: times that any source may be read at most; it
    overrules entropy. budget: tokens in all; None is as many as there are.
    cover: instead, the least budget at which every row is used at least once.
    """

    entropy: float | None = None
    repeats: float | None = None
    budget: int | None = None
    cover: bool = False
    block_tokens: int = 1 << 20
    seed: str = "mix"


def exponent(tokens: list[int], target: Target) -> float:
    """The exponent, to nine decimals; 1 where there is nothing to bisect for."""
    total = sum(tokens)
    if len(tokens) < 2:
        return 1.0
    p = [t / total for t in tokens]
    budget = target.budget if target.budget is not None else total

    def entropy(a: float) -> float:
        z = sum(x**a for x in p)
        return math.log(z) - a * sum(x**a * math.log(x) for x in p) / z

    def repeats(a: float) -> float:
        if target.cover:
            return max(p) ** (1 - a) / min(p) ** (1 - a)
        z = sum(x**a for x in p)
        return max(x**a / z * budget / t for x, t in zip(p, tokens))

    def bisect(ok, low: float, high: float) -> tuple[float, float]:
        for _ in range(STEPS):
            mid = (low + high) / 2
            low, high = (mid, high) if ok(mid) else (low, mid)
        return low, high

    found = 1.0 if target.entropy is None else bisect(lambda a: entropy(a) >= target.entropy * math.log(len(p)), 0.0, 1.0)[0]
    if target.entropy is not None and entropy(1.0) >= target.entropy * math.log(len(p)):
        found = 1.0
    if target.repeats is not None:
        least = 0.0 if repeats(0.0) <= target.repeats else bisect(lambda a: repeats(a) > target.repeats, 0.0, 1.0)[1]
        found = max(found, least) if target.entropy is not None else least
    return round(found, 9)


def budgets(tokens: list[int], target: Target) -> list[int]:
    """Tokens to take from each source."""
    total = sum(tokens)
    if not total:
        return [0] * len(tokens)
    a = exponent(tokens, target)
    power = [(t / total) ** a for t in tokens]
    z = sum(power)
    if target.cover:
        scale = max(t * z / w for t, w in zip(tokens, power))
        return [max(t, int(math.floor(w / z * scale))) for t, w in zip(tokens, power)]
    budget = target.budget if target.budget is not None else total
    if target.repeats is not None:
        budget = min(budget, int(target.repeats * total))
    return [int(math.floor(w / z * budget)) for w in power]


def mix(docs: DataFrame, target: Target) -> DataFrame:
    """The rows of ``docs`` as the mixture has them: repeated or left out, in blocks.

    All columns are kept; ``source``'s stream gives each row an ``epoch``, a
    ``block``, a ``slot`` in the block and its ``tokens`` (columns of these
    names that ``docs`` has are kept, and ours then start with underscores).
    Rows without any token (null, empty or blank text) aren't in the mixture.
    A null source is a source of its own. Repeated rows, and rows with equal
    or null ids, are rows of their own. An empty table gives an empty mixture.
    """
    spark = docs.sparkSession
    key, h, tok, at, total, budget, epoch, block, slot, before = fresh(docs, "key", "h", "tokens", "at", "total", "budget", "epoch", "block", "slot", "before")
    text_hash = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns if dict(docs.dtypes)[c] in ("string", "bigint", "int", "double")])
    id_text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.withColumns({
        key: F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), "source")),
        tok: F.coalesce(F.regexp_count("text", F.lit(TOKEN)), F.lit(0)).cast("bigint"),
        h: F.md5(F.concat(F.lit(f"{target.seed}|"), id_text).cast("binary")),
    }).where(F.col(tok) > 0)
    part = F.substring(h, 1, 4)  # the order of a source is that of h; equal beginnings of h are its stretches

    fine, _ = written(rows.groupBy(key, part.alias(at)).agg(F.sum(tok).alias(tok)), "mix")
    totals = sorted((r[0], r[1]) for r in fine.groupBy(key).agg(F.sum(tok)).collect())
    plan = budgets([t for _, t in totals], target)
    blocks = max(1, -(-sum(plan) // target.block_tokens))
    sources = spark.createDataFrame([(k, t, b) for (k, t), b in zip(totals, plan)], f"`{key}` string, `{total}` bigint, `{budget}` bigint")
    if len(totals) <= BROADCAST_SOURCES:
        sources = F.broadcast(sources)
    upto = Window.partitionBy(key).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    starts = fine.select(key, at, F.coalesce(F.sum(tok).over(upto), F.lit(0)).alias(before)).join(sources, key)

    within = Window.partitionBy(key, at).orderBy(h, "doc_id", tok, text_hash).rowsBetween(Window.unboundedPreceding, -1)
    begun = F.col(before) + F.coalesce(F.sum(tok).over(within), F.lit(0))
    copies = F.when(F.col(budget) > F.col(before), F.floor((F.col(budget) - F.col(before) + F.col(total) - 1) / F.col(total))).otherwise(0).cast("int")
    placed = (
        rows.withColumn(at, part).join(starts, [key, at]).withColumn(before, begun)
        .withColumn(epoch, F.explode(F.when(copies > 0, F.sequence(F.lit(0), copies - 1))))
    )
    point = (F.col(epoch) * F.col(total) + F.col(before)).cast("decimal(19,0)") * F.lit(blocks).cast("decimal(19,0)")
    placed = placed.withColumn(block, F.call_function("div", point, F.col(budget).cast("decimal(19,0)")))
    shuffled = Window.partitionBy(block).orderBy(F.md5(F.concat_ws("|", F.lit(target.seed), F.col(epoch).cast("string"), id_text).cast("binary")), "doc_id", epoch, key, tok, text_hash)
    out = placed.withColumn(slot, F.row_number().over(shuffled).cast("bigint"))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(epoch).cast("bigint").alias(epoch), block, slot, tok)


#: What the query uses: weights at 95 % of the greatest entropy, and no source read more than four times.
PRODUCTION = Target(entropy=0.95, repeats=4.0)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs, PRODUCTION).select("doc_id", "source", "epoch", "block", "slot", "tokens")


_ORACLE = """
WITH RECURSIVE doc AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS k,
         CAST(len(regexp_extract_all(coalesce(text, ''), '{token}')) AS BIGINT) AS tokens, md5('{seed}|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
d AS (SELECT * FROM doc WHERE tokens > 0),
s AS (SELECT k, CAST(sum(tokens) AS BIGINT) AS t FROM d GROUP BY k),
g AS (SELECT CAST(sum(t) AS BIGINT) AS total, count(*) AS n FROM s),
l AS (SELECT list(CAST(t AS DOUBLE) / total ORDER BY k) AS p, any_value(n) AS n FROM s, g),
bis(i, elo, ehi, rlo, rhi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1,
    CASE WHEN ent >= {entropy} * ln(n) THEN em ELSE elo END, CASE WHEN ent >= {entropy} * ln(n) THEN ehi ELSE em END,
    CASE WHEN rep > {repeats} THEN rm ELSE rlo END, CASE WHEN rep > {repeats} THEN rhi ELSE rm END
  FROM (
    SELECT i, elo, ehi, rlo, rhi, em, rm, n,
      ln(list_sum(list_transform(p, lambda x: pow(x, em)))) - em * list_sum(list_transform(p, lambda x: pow(x, em) * ln(x))) / list_sum(list_transform(p, lambda x: pow(x, em))) AS ent,
      list_max(list_transform(p, lambda x: pow(x, rm) / x)) / list_sum(list_transform(p, lambda x: pow(x, rm))) AS rep
    FROM (SELECT *, (elo + ehi) / 2 AS em, (rlo + rhi) / 2 AS rm FROM bis, l WHERE i < {steps}))),
a AS (
  SELECT CASE WHEN n < 2 THEN 1.0 ELSE round(greatest(
      CASE WHEN -list_sum(list_transform(p, lambda x: x * ln(x))) >= {entropy} * ln(n) THEN 1.0 ELSE elo END,
      CASE WHEN 1 / list_min(p) / n <= {repeats} THEN 0.0 ELSE rhi END), 9) END AS alpha
  FROM bis, l WHERE i = {steps}),
w AS (SELECT k, t, pow(CAST(t AS DOUBLE) / total, alpha) AS w, total FROM s, g, a),
b AS (SELECT k, t, CAST(floor(w / (SELECT sum(w ORDER BY k) FROM w) * least(total, CAST(floor({repeats} * total) AS BIGINT))) AS BIGINT) AS budget FROM w),
nb AS (SELECT greatest(1, CAST(ceil(sum(budget) / {block}.0) AS BIGINT)) AS blocks FROM b),
c AS (
  SELECT d.doc_id, d.source, d.k, d.tokens, b.t, b.budget,
    CAST(coalesce(sum(d.tokens) OVER (PARTITION BY d.k ORDER BY d.h, d.doc_id, d.tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begun
  FROM d JOIN b ON b.k = d.k),
e AS (SELECT c.*, unnest(generate_series(0, CASE WHEN budget > begun THEN (budget - begun + t - 1) // t - 1 ELSE -1 END)) AS epoch FROM c),
f AS (SELECT e.*, CAST((CAST(epoch * t + begun AS HUGEINT) * blocks) // budget AS BIGINT) AS block FROM e, nb)
SELECT doc_id, source, CAST(epoch AS BIGINT) AS epoch, block,
  CAST(row_number() OVER (PARTITION BY block ORDER BY md5('{seed}|' || epoch || '|' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, epoch, k, tokens) AS BIGINT) AS slot, tokens
FROM f
"""
ORACLE_SQL = _ORACLE.format(token=TOKEN, seed=PRODUCTION.seed, entropy=PRODUCTION.entropy, repeats=PRODUCTION.repeats, steps=STEPS, block=PRODUCTION.block_tokens)
