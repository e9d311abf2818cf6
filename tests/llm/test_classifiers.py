import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import quality, toxicity
from quern.llm.boosting import Boosted, Isotonic
from quern.llm.labelled import representative, sample

WORDS = "the of and".split() + [a + b + c for a in ("ri", "sto", "gar", "win", "mo", "pa") for b in ("ve", "ter", "ne", "la", "sil") for c in ("r", "n", "den", "ming", "ge", "low", "tain")]
INSULTS = ("blockhead", "nitwit", "dunderhead")


def prose(rng, n=60):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def labelled(n=600, seed=1):
    """Rows (id, text, quality, toxic): a fifth insults someone, a fifth is symbols and shouting."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        text, good, toxic = prose(rng, rng.randint(20, 120)), 1, 0
        if i % 5 == 0:
            at = text.split()
            for _ in range(3):
                at.insert(rng.randrange(len(at)), f"you {rng.choice(INSULTS)}" if rng.random() < 0.7 else "grobi" + rng.choice(["an", "en", "us", "ix", "ol"]))
            text, toxic = " ".join(at), 1
        elif i % 5 == 1:
            text, good = " ".join(w.upper() + rng.choice(["!!", "$$$", "###"]) for w in text.split()), 0
        out.append((i, text, good, toxic))
    return out


ROWS = labelled()
TRAIN, TEST = ROWS[:450], ROWS[450:]
ODD = [(None, "a river"), (1, None), (2, ""), (3, "x" * 300_000), (4, "same"), (4, "same"), (5, "🙂 ß \x00 ퟿")]


@pytest.fixture(scope="module")
def toxic_model():
    return toxicity.fit(*map(list, zip(*((i, t, y) for i, t, _, y in TRAIN))))


@pytest.fixture(scope="module")
def quality_model():
    return quality.fit(*map(list, zip(*((i, t, y) for i, t, y, _ in TRAIN))))


def test_toxicity_held_out(toxic_model):
    assert set(INSULTS) <= toxic_model.words and any("grobi".startswith(s) for s in toxic_model.stems)
    p = toxic_model.probability([t for _, t, _, _ in TEST])
    y = np.array([x for *_, x in TEST])
    assert ((p >= 0.5) == y).mean() >= 0.98


def test_toxicity_features(toxic_model):
    f = dict(zip(toxicity.FEATURES, toxic_model.features("You nitwit! n1twit nitwits HELLO sooo")))
    assert f["near_you"] == 1 and f["word_density"] > 0 and f["obfuscation"] > 0 and f["stretched"] > 0 and f["exclamation"] > 0
    assert f["obfuscated_hits"] > 0
    assert dict(zip(toxicity.FEATURES, toxic_model.features(None)))["hits"] == 0


def test_quality_held_out(quality_model):
    p = quality_model.probability([t for _, t, _, _ in TEST])
    y = np.array([x for _, _, x, _ in TEST])
    assert ((p >= 0.5) == y).mean() >= 0.98


def test_quality_reads_whole_texts(quality_model):
    good, bad = ([t for _, t, y, _ in TEST if y == k] for k in (1, 0))
    long = " ".join(good * 3)
    s = quality_model.score(long)
    assert s > quality_model.score(long + " ".join(bad * 3)) > quality_model.score(" ".join(bad * 3))


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality, "quality")])
def test_on_tables(spark, module, label):
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t, *_ in TRAIN], "doc_id long, text string, rejected string, toxicity double")
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in TRAIN] + [(None, 1, 1), (7, None, None), (3, 1, 0)], "doc_id long, quality int, toxic int")
    model = module.train(docs, labels)
    odd = spark.createDataFrame([(*r, "kept", 0.5) for r in ODD], "doc_id long, text string, Quality string, toxicity double")
    rows = module.score(odd, model).collect()
    assert len(rows) == len(ODD) and all(r["rejected"] in (True, False) for r in rows)
    kept = module.keep(docs, model)
    assert kept.columns == docs.columns
    right = {i for i, _, q, x in TRAIN if (x == 0 if label == "toxic" else q == 1)}
    got = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert len(got ^ right) <= 0.03 * len(TRAIN)
    assert module.keep(odd, model).columns == odd.columns and module.keep(docs.limit(0), model).count() == 0
    again = module.train(docs, labels)
    texts = [t for _, t, *_ in TEST]
    assert np.array_equal(model.probability(texts), again.probability(texts))


def test_few_or_no_labels(spark):
    docs = spark.createDataFrame([(1, "a river"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.keep(docs, toxicity.train(docs, none)).count() == 2
    assert quality.keep(docs, quality.train(docs, none)).count() == 2


def test_boosting_and_isotonic():
    rng = np.random.default_rng(0)
    x = rng.random((400, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    assert ((Boosted(least=4).fit(x, y).margin(x) > 0) == y).mean() > 0.95
    s = rng.random(500)
    iso = Isotonic().fit(s, (rng.random(500) < s).astype(float))
    p = iso(np.linspace(0, 1, 50))
    assert (np.diff(p) >= 0).all() and abs(p[25] - 0.5) < 0.2


def test_copies_do_not_train_twice():
    assert representative(["a b c d", "a b c d", "x y z w", ""]) == [0, 2, 3]


def test_dictionaries_hold_what_any_place_of_a_long_text_has(monkeypatch):
    """All pieces of all texts are trained on."""
    seen = []
    monkeypatch.setattr("zstandard.train_dictionary", lambda size, cut, **_: seen.append(cut) or type("D", (), {"as_bytes": lambda self: b"".join(cut)[-size:]})())
    texts = [f"<{i}>" + "".join(f"{p:04d}" * (quality.PIECE // 4) for p in range(9)) for i in range(30)]
    quality._dictionary(texts)
    assert b"".join(seen[0]) == "".join(texts).encode()


def test_quality_equals_the_definition(quality_model):
    """Sizes by compressors of one's own, piece by piece."""
    import zstandard as Z

    for text in [TEST[0][1], "", "x" * 5_000, " ".join(t for _, t, *_ in TEST)]:
        raw = text.encode()
        n = max(1, round(len(raw) / quality.PIECE))
        diff = 0
        for i in range(n):
            piece = raw[len(raw) * i // n : len(raw) * (i + 1) // n]
            good, bad = (len(Z.ZstdCompressor(level=quality.LEVEL, dict_data=Z.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False, write_checksum=False).compress(piece)) for d in quality_model.dicts)
            diff += bad - good
        assert abs(quality_model.score(text) - (diff + quality.PRIOR[0]) / (len(raw) + quality.PRIOR[1])) < 1e-12


def test_an_id_that_many_documents_have(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(2, "b"), (None, "c"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 1)], "doc_id long, quality int")
    assert sorted(tuple(r) for r in sample(docs, labels, "quality", 10).collect()) == [(1, "text 0", 1), (2, "b", 0)]


OLD = re.compile(r"[^\W_]*[^\W\d_][@$!*\d.\-][^\W\d_][\w@$!*.\-]*")


def test_obfuscated_words_in_linear_time():
    rng = random.Random(5)
    for _ in range(3_000):
        text = "".join(rng.choice("ab1@_-. é!") for _ in range(14))
        assert toxicity.obfuscated(text) == OLD.findall(text)
    began = time.time()
    for text in ("a1b " + "x" * 1_000_000, "a1b " + "x1" * 500_000, "a@b " + "-" * 1_000_000, "_1_" * 300_000):
        toxicity.Model({"nitwit"}, {"grobi"}).features(text)
    assert time.time() - began < 20


def naive_features(model, text):
    """The features as they are defined, by loops over characters."""
    text = text or ""
    low, raw = text.lower(), text.encode()
    alnum = lambda s, i: 0 <= i < len(s) and s[i].isalnum()
    word = stem = near = 0
    for lexicon, kind in ((model.words, "word"), (model.stems, "stem")):
        for w in lexicon:
            for i in range(len(low)):
                if low.startswith(w, i) and not alnum(low, i - 1) and (kind == "stem" or not alnum(low, i + len(w))):
                    word, stem = word + (kind == "word"), stem + (kind == "stem")
                    around = re.findall(r"[^\W_]+", low[max(0, i - toxicity.NEAR_CHARS) : i + len(w) - 1 + toxicity.NEAR_CHARS])
                    near += any(x in toxicity.SECOND_PERSON for x in around)
    letter = lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 128
    symbol = lambda b: b in b"@$!*013457"
    three = list(zip(raw, raw[1:], raw[2:]))
    odd = sum(letter(a) and symbol(b) and letter(c) for a, b, c in three)
    hidden = [w.translate(toxicity._LEET) for w in OLD.findall(low)] if odd else []
    words = sum(b == 32 or 9 <= b <= 13 for b in raw) + 1
    found = sum(w in model.words or any(w.startswith(s) for s in model.stems) for w in hidden)
    return [
        word / words, stem / words, math.log1p(word + stem), math.log1p(found), near / max(1, word + stem), sum(65 <= b <= 90 for b in raw) / max(1, sum(map(letter, raw))),
        raw.count(b"!") / words, sum(b in toxicity._PUNCT for b in raw) / max(1, len(raw)), odd / words, sum(a == b == c and letter(b) for a, b, c in three) / words, math.log1p(words),
    ]


def test_toxicity_equals_the_definition(toxic_model):
    """Features by loops over characters, trees walked node by node, calibration by its steps."""
    texts = [t for _, t, *_ in TEST[:60]] + ["", None, "You n1twit!!! grobian, BLOCK-HEAD soooo $tupid", "é!é @a1a"]
    x = [naive_features(toxic_model, t) for t in texts]
    assert np.allclose(toxic_model.matrix(texts), x)
    for row, text in zip(x, texts):
        margin = toxic_model.trees.bias
        for feature, cut, value in toxic_model.trees.trees:
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + (row[feature[node]] > cut[node])
            margin += value[node - len(feature)]
        at, p = toxic_model.calibration.x, toxic_model.calibration.p
        k = sum(a <= margin for a in at)
        want = p[0] if k == 0 else p[-1] if k == len(at) else p[k - 1] + (p[k] - p[k - 1]) * (margin - at[k - 1]) / (at[k] - at[k - 1])
        assert abs(toxic_model.probability([text])[0] - want) < 1e-9
