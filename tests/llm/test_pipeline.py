import re
from collections import Counter

import pytest

import corpus_pipeline as P
from quern.llm import bpe, mixing, ngram_join, quality, toxicity
from test_classifiers import ROWS

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t, "en", f"s{i % 9 // 4}", len(t)) for i, t, *_ in ROWS]
    clean = next(r for r in ROWS if r[2] == 1 and r[3] == 0)
    rows += [(9_000, clean[1], "en", "s0", 1), (9_001, clean[1] + " and more", "en", None, 1), (9_002, None, None, "s1", None), (None, "The quiet river and the stone bridge of winter in the morning.", "en", "s1", 1)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, q, x) for i, _, q, x in ROWS[:450]], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return root


def test_stages_and_their_columns():
    assert [n for n, _ in P.STAGES] == ["toxicity", "quality", "ngram_join", "mixing", "bpe"]


def test_each_stage_against_brute_force(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    columns = docs.columns
    models = {"toxicity": toxicity.train(docs, labels), "quality": quality.train(docs, labels)}
    for name, stage in P.STAGES:
        out = str(tmp_path / name)
        stage(spark, docs, folder).write.parquet(out)
        before, after = docs.collect(), spark.read.parquet(out)
        got = Counter((r["doc_id"], r["text"]) for r in after.collect()) if name != "bpe" else None
        texts = [r["text"] for r in before]
        if name == "toxicity":
            p = models[name].probability(texts)
            want = Counter((r["doc_id"], r["text"]) for r, x in zip(before, p) if x < toxicity.THRESHOLD)
        elif name == "quality":
            p = models[name].probability(texts)
            want = Counter((r["doc_id"], r["text"]) for r, x in zip(before, p) if x >= quality.THRESHOLD)
        elif name == "ngram_join":
            want = Counter((r["doc_id"], r["text"]) for r in brute_groups(before))
            assert sum(want.values()) < len(before)
        elif name == "mixing":
            want = Counter()
            own = {}
            for r in before:
                n = len(re.findall("[^ \t-\r]+", r["text"] or ""))
                if n:
                    own[r["source"]] = own.get(r["source"], 0) + n
            plan = dict(zip(sorted(own, key=lambda s: s or ""), mixing.budgets([own[s] for s in sorted(own, key=lambda s: s or "")], P.MIXTURE)))
            used = {}
            for r in after.collect():
                used[r["source"]] = used.get(r["source"], 0) + len(r["text"].split())
            longest = max(len((r["text"] or "").split()) for r in before)
            assert all(plan[s] <= used[s] < plan[s] + longest for s in own)
            assert set(got) == {(r["doc_id"], r["text"]) for r in before if (r["text"] or "").strip()} and max(got.values()) <= 2
            want = got
        else:
            rows = after.collect()
            assert len(rows) == len(before) and all(r["exact"] for r in rows)
            encoder = bpe.Encoder()
            assert sorted((str(r["doc_id"]), list(r["tokens"])) for r in rows) == sorted((str(r["doc_id"]), encoder.encode(r["text"]).tolist()) for r in before)
            break
        assert got == want, name
        assert after.columns == columns
        docs = after


def brute_groups(rows):
    sets = [set(ngram_join.gram_set(r["text"], ngram_join.N).tolist()) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= ngram_join.THRESHOLD * len(sets[i] | sets[j]) - 1e-9:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    best = {}
    for k, r in zip(group, rows):
        key = (r["doc_id"] is None, r["doc_id"] or 0)
        if k not in best or key < best[k][0]:
            best[k] = (key, r)
    return [r for _, r in best.values()]


def test_run(spark, folder):
    rows = P.run(spark, folder).collect()
    toxic = {i for i, _, _, x in ROWS if x}
    poor = {i for i, _, q, _ in ROWS if not q}
    got = {r["doc_id"] for r in rows}
    assert len(got & toxic) <= 0.03 * len(toxic) and len(got & poor) <= 0.03 * len(poor)
    assert 9_000 not in got and 9_001 not in got and None in got and all(r["exact"] for r in rows)
