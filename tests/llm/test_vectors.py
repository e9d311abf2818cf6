import numpy as np
import pytest

from quern.llm import nn_descent, topk
from quern.llm.topk import Lists

ODD = [(None, [1.0, 0.0]), (900, None), (901, []), (902, [1.0]), (903, [None, 1.0]), (904, [float("nan"), 1.0])]


def vectors(n, d, seed=0, copies=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d))
    for i in range(copies):
        x[n - 1 - i] = x[i % 7] + 0.02 * rng.standard_normal(d)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def brute(ids, x, k):
    x = x.astype(np.float32).astype(np.float64)
    out = {}
    for i, q in zip(ids, x):
        s = [(-round(float(v), 9), int(j)) for j, v in zip(ids, np.round(x @ q, 9)) if j != i]
        out[int(i)] = [j for _, j in sorted(s)[:k]]
    return out


@pytest.mark.parametrize("n, d, every, numbers", [(300, 6, 1, 240), (400, 64, 7, 64 * 90), (50, 2, 1, 1 << 22), (5, 3, 1, 6), (1, 3, 1, 8)])
def test_topk_equals_brute_force(spark, n, d, every, numbers):
    x = vectors(n, d)
    x[n // 2] = x[0]  # ties
    rows = [(i, x[i].tolist(), 1) for i in range(n)]
    df = spark.createDataFrame(rows + rows[:1], "vec_id long, embedding array<float>, rank int")
    found = {}
    for r in topk.search(df, 4, every=every, numbers=numbers, least=20).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["neighbor_id"])
    assert found == {i: v for i, v in brute(np.arange(n), x, 4).items() if v and i % every == 0}


def turned(n, d, spread, seed=1):
    """Vectors whose directions have this spread, turned so that no coordinate shows it."""
    rng = np.random.default_rng(seed)
    return (rng.standard_normal((n, d)) * spread) @ np.linalg.qr(rng.standard_normal((d, d)))[0]


@pytest.mark.parametrize("d, spread, most", [(4, [10, 0.1, 0.1, 0.1], 500), (64, 2.0 ** -np.arange(64), 500), (64, 0.7 ** np.arange(64), 3_000)])
def test_threshold_stops_early(d, spread, most):
    """Where few directions tell rows apart, few rows are met, and the result is that of brute force."""
    x = turned(5_000, d, spread)
    lists = Lists(np.arange(5_000), x, topk.principal(x[:500]))
    met = []
    for i in range(0, 5_000, 250):
        scores = np.round(x @ x[i], topk.DECIMALS)
        scores[i] = -np.inf
        want = np.lexsort((np.arange(5_000), -scores))[:5]
        ids, found, count = lists.top(i, x[i], 5)
        assert ids.tolist() == want.tolist() and np.allclose(found, scores[want])
        met.append(count)
        # With a bound from elsewhere nothing is lost, and no more rows are met.
        again, _, fewer = lists.top(i, x[i], 5, scores[want[2]])
        assert again.tolist() == want[:3].tolist() and fewer <= count
    assert np.mean(met) < most


def test_threshold_without_structure():
    """Random vectors: lists are read until the bound allows to stop, or every row has been met."""
    x = vectors(3_000, 64, 2)
    ids, scores, count = Lists(np.arange(3_000), x).top(-1, x[7], 3)
    assert ids[0] == 7 and count <= 3_000
    assert Lists(np.arange(9), np.zeros((9, 4))).top(3, np.ones(4), 3)[0].tolist() == [0, 1, 2]
    assert Lists(np.arange(9), vectors(9, 4)).top(-1, np.zeros(4), 3)[0].tolist() == [0, 1, 2]
    assert not len(Lists(np.zeros(0, int), np.zeros((0, 4))).top(1, np.ones(4), 3)[0])


def test_rows_that_are_no_vectors(spark):
    good = [(i, v.tolist()) for i, v in enumerate(vectors(6, 2))]
    df = spark.createDataFrame(good + ODD, "vec_id long, embedding array<float>")
    assert {r["query_id"] for r in topk.search(df, 2, every=1).collect()} == set(range(6))
    x = vectors(6, 2)
    want = {(i, j) for i in range(6) for j in range(i) if x[i] @ x[j] >= 0.3}
    assert {(r["id_b"], r["id_a"]) for r in nn_descent.near_duplicates(df, t=0.3).collect()} == want and want
    assert {r["vec_id"] for r in nn_descent.classes(df).collect()} == set(range(6))
    empty = df.limit(0)
    assert nn_descent.classes(empty).count() == 0
    assert topk.search(empty).count() == 0 and nn_descent.near_duplicates(empty).count() == 0


def test_near_duplicates_recall_and_precision(spark):
    x = vectors(700, 24, 3, copies=90)
    df = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "vec_id long, embedding array<float>, sim int")
    s = x.astype(np.float32) @ x.astype(np.float32).T
    want = {(i, j) for i, j in zip(*np.nonzero(s >= 0.9)) if i < j}
    found = {(r["id_a"], r["id_b"]) for r in nn_descent.near_duplicates(df).collect()}
    assert len(want) > 300 and found <= want and len(found) >= 0.95 * len(want)


def grouped(pairs, ids):
    """(class, links) of each id."""
    group, links = {i: i for i in ids}, dict.fromkeys(ids, 0)
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
        old, new = max(group[a], group[b]), min(group[a], group[b])
        group = {i: new if g == old else g for i, g in group.items()}
    return {i: (group[i], links[i]) for i in ids}


@pytest.mark.parametrize("piece", [4096, 40])
def test_classes_and_links_equal_brute_force(spark, monkeypatch, piece):
    """One row a vector: a third of all are one vector, some are zero; large buckets are joined piece by piece."""
    monkeypatch.setattr(nn_descent, "PIECE", piece)
    x = vectors(300, 16, 4, copies=60).astype(np.float32)
    x[100:200] = x[50]
    x[200:203] = 0
    df = spark.createDataFrame([(i, v.tolist(), "c") for i, v in enumerate(x)], "vec_id long, embedding array<float>, links string")
    s = x @ x.T
    pairs = [(i, j) for i in range(300) for j in range(i + 1, 300) if s[i, j] >= 0.9]
    found = {r["vec_id"]: (r["class_id"], r["links"]) for r in nn_descent.classes(df).collect()}
    assert found == grouped(pairs, range(300)) and found[150] == (50, 100) and found[201] == (201, 0)


def test_refinement_finds_what_the_start_missed(spark):
    """Two hashes leave edges out that one round of neighbours' neighbours adds; none that is found is wrong."""
    x = vectors(400, 8, 5, copies=80).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>")
    start, _ = nn_descent.begin(df, 400, 4, 0.9, 2, 0)
    graph = nn_descent.shortened(start, 4, 0.9).selectExpr("u", "v", "sim", "true AS new").cache()
    near = lambda g: {(r["u"], r["v"]) for r in g.where("sim >= 0.9").collect()}
    s = x @ x.T
    want = {(i, j) for i, j in zip(*np.nonzero(s >= 0.9)) if i != j}
    better = nn_descent.refined(graph, df, 4, 0.9).cache()
    edges = lambda g: {(r["u"], r["v"]) for r in g.collect()}
    assert len(edges(better) - edges(graph)) >= 20
    assert near(graph) <= near(better) <= want and len(near(better)) >= 0.95 * len(want)
    top = {(i, int(j)) for i in range(400) for j in np.argsort(-(s[i] - 9 * (np.arange(400) == i)))[:4]}
    assert len(top & edges(better)) > len(top & edges(graph))


@pytest.mark.parametrize("count", [51_282, 500_000, 15_000_000])
def test_hashes_follow_from_the_size(count):
    """A pair at the threshold meets with the wanted recall, at any size."""
    bits = nn_descent.bits_for(count, 0.9)
    hashes = nn_descent.hashes_for(bits, 0.9)
    assert nn_descent.meeting(bits, 0.9, hashes) >= nn_descent.RECALL > nn_descent.meeting(bits, 0.9, hashes - 1)


def test_audit_needs_rows_with_near_duplicates(spark):
    """Three pairs among 2,000 rows: the audit looks until it meets them, row by row; none of a part of the table is no evidence."""
    x = vectors(2_000, 32, 11)
    x[-3:] = x[:3]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>")
    none = spark.createDataFrame([], "u long, v long, sim double, new boolean")
    found = nn_descent.audited(none, df, 0.9)
    assert tuple(found) == (0.0, 6, True) and not nn_descent.accepted(found, 1.0)
    part = nn_descent.audited(none, df.where("id between 10 and 1900"), 0.9, most=400)
    assert part.rows == 0 and not part.whole
    assert not nn_descent.accepted(part, nn_descent.RECALL) and nn_descent.accepted(part, nn_descent.SURE)
    pairs = [(i, 1_997 + i) for i in range(3)]
    group = spark.createDataFrame([(a, b, 1.0, True) for p in pairs[:2] for a, b in (p, p[::-1])], none.schema)
    assert abs(nn_descent.audited(group, df, 0.9).recall - 4 / 6) < 1e-9


def test_a_failed_audit_is_an_error(spark, monkeypatch):
    """More hashes until the audit is met; where it never is, nothing is returned."""
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors(60, 4, 2, copies=9))], "vec_id long, embedding array<float>")
    shown = [0.5, 0.94, 0.96]
    monkeypatch.setattr(nn_descent, "audited", lambda *_: nn_descent.Audit(shown.pop(0), 60, True))
    assert nn_descent.near_duplicates(df).count() > 0 and not shown
    shown += [0.94] * nn_descent.ATTEMPTS
    with pytest.raises(RuntimeError, match="recall of 0.940"):
        nn_descent.near_duplicates(df)


def test_edges_left_out_of_a_round_stay_new(spark):
    """Of 30 equal rows 2 + 2 come into a row's join at k = 2; the others are still new, and come in by and by."""
    df = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(30)], "id long, v array<float>")
    graph = spark.createDataFrame([(u, v, 1.0, True) for u in range(30) for v in range(30) if u != v], "u long, v long, sim double, new boolean")
    left = [graph.where("new").count()]
    for _ in range(2):
        rows = nn_descent.refined(graph, df, 2, 0.9).collect()
        graph = spark.createDataFrame(rows, graph.schema)
        left.append(sum(r["new"] for r in rows))
    assert 30 * 29 - 30 * 4 <= left[1] < left[0] and 0 < left[2] < left[1] and len(rows) == 30 * 29
