import hashlib
import math
import random

import pytest

from quern.llm.mixing import Target, budgets, exponent, mix


def entropy(tokens, a):
    p = [(t / sum(tokens)) ** a for t in tokens]
    return -sum(x / sum(p) * math.log(x / sum(p)) for x in p)


def test_exponent_meets_its_targets():
    tokens = [1_000_000, 50_000, 50_000, 1_000]
    a = exponent(tokens, Target(entropy=0.8))
    assert 0 < a < 1 and abs(entropy(tokens, a) - 0.8 * math.log(4)) < 1e-6
    assert exponent([5, 5], Target(entropy=0.9)) == 1.0 and exponent([5], Target(entropy=0.9)) == 1.0
    b = budgets(tokens, Target(repeats=3.0))
    assert max(x / t for x, t in zip(b, tokens)) <= 3.0 + 1e-6 and max(x / t for x, t in zip(b, tokens)) > 2.99
    both = exponent(tokens, Target(entropy=0.99, repeats=2.0))
    assert both == pytest.approx(exponent(tokens, Target(repeats=2.0)), abs=1e-8)
    cover = budgets(tokens, Target(repeats=2.0, cover=True))
    assert all(b >= t and b <= 2.0 * t + 1 for b, t in zip(cover, tokens))
    assert budgets([], Target()) == [] and sum(budgets(tokens, Target(budget=1000))) <= 1000


def brute(rows, target):
    """The same mixture, one row at a time."""
    import re

    own = {}
    for r in rows:
        n = len(re.findall("[^ \t-\r]+", r[2] or ""))
        if n:
            own.setdefault("" if r[1] is None else "=" + r[1], []).append((hashlib.md5(f"{target.seed}|{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] if r[0] is not None else -1, n, r))
    keys = sorted(own)
    plan = budgets([sum(x[2] for x in own[k]) for k in keys], target)
    blocks, out = max(1, -(-sum(plan) // target.block_tokens)), []
    for k, b in zip(keys, plan):
        stream, at = sorted(own[k], key=lambda x: x[:3]), 0
        epoch = 0
        while at < b:
            for *_, n, r in stream:
                if at < b:
                    out.append((r[0], r[1], epoch, at * blocks // b, n))
                at += n
            epoch += 1
    return out


def corpus():
    rng = random.Random(1)
    rows = [(i, rng.choices(["big", "mid", "small", None], [70, 20, 8, 2])[0], "w " * rng.randint(1, 40)) for i in range(800)]
    return rows + [(None, "mid", "a b c"), (801, "mid", None), (802, "mid", ""), (803, "mid", " \n"), (804, "small", "x y"), (804, "small", "x y"), (805, "big", "long " * 20_000)]


@pytest.mark.parametrize("target", [Target(entropy=0.95, repeats=4.0, block_tokens=500), Target(repeats=2.0, cover=True, block_tokens=300), Target(budget=3_000, block_tokens=700), Target()])
def test_mixture_equals_brute_force(spark, target):
    docs = spark.createDataFrame([(*r, 1, "kept") for r in corpus()], "doc_id long, source string, text string, block int, slot string")
    mixed = mix(docs, target)
    assert mixed.columns == [*docs.columns, "epoch", "_block", "_slot", "tokens"]
    rows = mixed.collect()
    key = lambda x: tuple(map(str, x))
    assert sorted(((r["doc_id"], r["source"], r["epoch"], r["_block"], r["tokens"]) for r in rows), key=key) == sorted(brute(corpus(), target), key=key)
    by_block = {}
    for r in rows:
        by_block.setdefault(r["_block"], []).append(r["_slot"])
    assert all(sorted(s) == list(range(1, len(s) + 1)) for s in by_block.values())


def test_blocks_hold_the_weights(spark):
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, "a" if i % 10 else "b", "w " * rng.randint(5, 15)) for i in range(6_000)], "doc_id long, source string, text string")
    rows = mix(docs, Target(repeats=2.0, block_tokens=4_000)).collect()
    total = {s: sum(r["tokens"] for r in rows if r["source"] == s) for s in "ab"}
    for block in range(max(r["block"] for r in rows) + 1):
        own = {s: sum(r["tokens"] for r in rows if r["block"] == block and r["source"] == s) for s in "ab"}
        assert abs(own["b"] / sum(own.values()) - total["b"] / sum(total.values())) < 0.02


def test_empty(spark):
    assert mix(spark.createDataFrame([], "doc_id long, source string, text string"), Target(entropy=0.9)).count() == 0
