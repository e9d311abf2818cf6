import random

import numpy as np
import pytest

from quern.llm import common, grams
from quern.llm import ngram_join as N
from quern.llm.grams import gram_set, words

WORDS = [f"w{i}" for i in range(400)]


def brute(rows, n, t):
    own = [(i, set(gram_set(x, n).tolist())) for i, x in rows if i is not None]
    out = {}
    for i, a in own:
        for j, b in own:
            if i < j and a and b and (s := len(a & b) / len(a | b)) >= t - 1e-12:
                out[i, j] = max(s, out.get((i, j), 0))
    return out


def corpus(seed=3):
    rng = random.Random(seed)
    rows, k = [], 0
    shared = " ".join(rng.choice(WORDS) for _ in range(60))
    for g in range(40):
        base = [rng.choice(WORDS) for _ in range(rng.choice([4, 12, 60, 200]))]
        for c in range(rng.choice([1, 1, 2, 3, 12])):
            text = [rng.choice(WORDS) if rng.random() < 0.02 * (c % 4) else w for w in base]
            rows.append((k, " ".join(text) + (" " + shared if g % 3 == 0 else "")))
            k += 1
    return rows


ODD = [(900, None), (901, ""), (902, " ... "), (None, "w1 w2 w3 w4 w5 w6"), (903, "w1 w2 w3 w4 w5 w6"), (904, "W1, w2; w3 w4 w5 w6!"), (904, "W1, w2; w3 w4 w5 w6!"), (905, "one"), (906, "One."), (907, "w1 " * 30_000)]


@pytest.mark.parametrize("n, t", [(5, 0.4), (3, 0.8), (2, 0.5)])
def test_pairs_equal_brute_force(spark, n, t):
    rows = corpus() + ODD
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fp string")
    found = {(r["doc_a"], r["doc_b"]): r["jaccard"] for r in N.pairs(docs, n, t).collect()}
    want = brute(rows, n, t)
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-12 for k in want)
    assert (903, 904) in found and (905, 906) in found


def test_large_components_are_joined_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(N, "STRETCH", 600)
    monkeypatch.setattr(N, "LEAST", 32)
    rows = corpus(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r["doc_a"], r["doc_b"]) for r in N.pairs(docs, 5, 0.4).collect()}
    assert found == brute(rows, 5, 0.4).keys()


def brute_classes(rows, n, t):
    """One (class, links) for each id: links between texts of different ids, classes also through texts without an id."""
    texts = sorted({(i, x) for i, x in rows}, key=str)
    sets = [(i, frozenset(gram_set(x, n).tolist())) for i, x in texts]
    sets = list(dict.fromkeys(s for s in sets if s[1]))
    group, links = list(range(len(sets))), {i: 0 for i, _ in rows if i is not None}
    for p, (i, a) in enumerate(sets):
        for q, (j, b) in enumerate(sets[:p]):
            alike = len(a & b) / len(a | b) >= t - 1e-12
            if alike and i is not None and j is not None and i != j:
                links[i] += 1
                links[j] += 1
            if alike or i is not None and i == j:
                group = [group[q] if g == group[p] else g for g in group]
    least = {}
    for (i, _), g in zip(sets, group):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    of = {i: least[g] for (i, _), g in zip(sets, group) if i is not None}
    return {i: (of.get(i, i), k) for i, k in links.items()}


@pytest.mark.parametrize("n, t", [(5, 0.4), (2, 0.5)])
def test_classes_equal_brute_force(spark, monkeypatch, n, t):
    rows = corpus(7) + ODD + [(1, corpus(7)[5][1]), (1, "w1 w2 w3 w4 w5 w6"), (2, corpus(7)[6][1])]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, class_id string")
    found = {r["doc_id"]: (r["class_id"], r["links"]) for r in N.classes(docs, n, t).collect()}
    assert found == brute_classes(rows, n, t)
    monkeypatch.setattr(N, "BROADCAST_ROWS", 3)  # larger ones are joined by a shuffle
    monkeypatch.setattr(N, "STRETCH", 600)
    assert {r["doc_id"]: (r["class_id"], r["links"]) for r in N.classes(docs, n, t).collect()} == found
    assert found[900] == (900, 0) and N.classes(docs.limit(0)).count() == 0


def test_an_id_with_two_texts(spark):
    rows = [(1, "a b c d e f"), (1, "p q r s t u"), (2, "a b c d e f"), (3, "p q r s t u v")]
    found = {(r["doc_a"], r["doc_b"]): round(r["jaccard"], 3) for r in N.pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {(1, 2): 1.0, (1, 3): 0.667}


def test_one_of_each_group_stays(spark):
    rows = corpus() + ODD
    docs = spark.createDataFrame([(*r, "l", "s", len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = N.one_of_each(docs)
    assert kept.columns == docs.columns
    got = sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)
    parent = {i: i for i, _ in rows if i is not None}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in brute(rows, N.N, N.THRESHOLD):
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    assert got == sorted({find(i) for i in parent})


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert N.pairs(docs).count() == 0 and N.one_of_each(docs).count() == 0


def test_words_follow_the_pattern():
    import re

    text = "The QUICK-brown fox_42, Ünïté 你好 İx"
    assert len(words(text)) == len(re.findall("[a-z0-9\x80-\U0010ffff]+", text.lower()))
    assert np.array_equal(words("a b a")[[0]], words("xx a")[[1]]) and not len(words(None))


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (9, 8), (8, 7), (7, 9), (6, 6)], "a long, b long")
    nodes, _ = N.components(e)
    assert {(r["node"], r["comp"]) for r in nodes.collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (7, 7), (8, 7), (9, 7)}


def test_a_long_text_is_hashed_in_portions(monkeypatch):
    text = " ".join(WORDS * 40) + " " + "é" * 30_000 + " end"
    want = words(text)
    monkeypatch.setattr(grams, "_powers", (np.ones(1, np.uint64), np.ones(1, np.uint64)))
    monkeypatch.setattr(grams, "PORTION", 1000)
    assert words(text).tolist() == want.tolist() and len(want) == 16_002
    assert words("w7")[0] == want[7] and words("é" * 30_000)[0] == want[-2]
    assert len(grams._powers[0]) <= 4096


def test_slices_are_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(N, "SLICE_GRAMS", 500)
    monkeypatch.setattr(common, "BATCH_BYTES", 2000)
    rows = corpus(7) + ODD
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    assert {(r["doc_a"], r["doc_b"]) for r in N.pairs(docs, 5, 0.4).collect()} == brute(rows, 5, 0.4).keys()
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before
    texts = spark.createDataFrame(rows, "doc_id long, text string").toArrow().column("text")
    for _, own in N._grams(texts, 5):
        assert len(own) == 1 or sum(map(len, own)) <= 500


def test_sets_of_sizes_too_different_arent_linked(spark):
    rng = random.Random(9)
    short = [" ".join(f"{rng.random()}" for _ in range(30)) for _ in range(40)]
    near = [x + " more" for x in short[:5]]
    docs = spark.createDataFrame([(k, x) for k, x in enumerate([*short, *near, " ".join(short)])], "doc_id long, text string")
    mixed = N.links(docs, 5, 0.4, 10_000).collect()  # the long text shares every n-gram of the short ones
    fp = [N.fingerprint(gram_set(x, 5)) for x in [*short, *near]]
    assert {(r["a"], r["b"]) for r in mixed} == {(min(fp[k], fp[40 + k]), max(fp[k], fp[40 + k])) for k in range(5)}
