"""Toxicity: boosted trees over dense features, calibrated by isotonic regression.

The lexicon is learned from labelled rows: words, and word beginnings of four
to eight letters, that toxic rows hold far more often than others. The features
are lexicon densities, the nearness of hits to second-person words, and the
rates of capitals, punctuation and obfuscation. An Aho-Corasick automaton
finds the hits over the whole text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.boosting import Boosted, Isotonic
from quern.llm.common import fresh, importable, table
from quern.llm.labelled import fitted, representative, sample

#: Labelled rows that the model is fitted on, at most.
MAX_LABELLED = 10_000
#: Documents with at least this probability are rejected.
THRESHOLD = 0.5
SECOND_PERSON = frozenset("you your yours yourself ur u du dich dir dein deine deinen euch ihr euer tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros vuestro".split())
NEAR_CHARS = 40
FEATURES = ("word_density", "stem_density", "hits", "obfuscated_hits", "near_you", "capitals", "exclamation", "punctuation", "obfuscation", "stretched", "length")

_WORD = re.compile(r"[^\W_]+")
_RUN = re.compile(r"[\w@$!*.\-]+")
_HIDDEN = re.compile(r"[^\W\d_][@$!*\d.\-][^\W\d_]")
_LEET = str.maketrans({"@": "a", "4": "a", "3": "e", "1": "i", "!": "i", "0": "o", "$": "s", "5": "s", "7": "t", "*": None, ".": None, "-": None})
_KIND = np.zeros(256, np.uint8)  # 1 letter (any byte of a longer character too), 2 digit or symbol used for letters
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[[*b"@$!*013457"]] = 2
_PUNCT = np.array([*b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"])


def learn_lexicon(texts: list[str], labels: list[int], least: int = 6, precision: float = 0.9) -> tuple[set[str], set[str]]:
    """(words, stems) seen in at least ``least`` toxic rows and, smoothed, at ``precision`` times in them."""
    def grams(text: str) -> set[str]:
        words = set(_WORD.findall(text.lower()))
        return {w for w in words if len(w) > 2} | {w[:n] + "\0" for w in words for n in range(4, 9) if len(w) > n}

    toxic = Counter(g for text, label in zip(texts, labels) if label > 0 for g in grams(text))
    toxic = Counter({g: k for g, k in toxic.items() if k >= least})  # no other can be accepted, so that few are counted in clean rows
    clean = Counter(g for text, label in zip(texts, labels) if label <= 0 for g in grams(text) if g in toxic)
    n_clean, n_toxic = max(1, sum(y <= 0 for y in labels)), max(1, sum(y > 0 for y in labels))
    good = {g for g, k in toxic.items() if (k / n_toxic) / (k / n_toxic + (clean[g] + 0.5) / n_clean) >= precision and k / (k + clean[g]) >= 0.7}
    stems: set[str] = set()
    for g in sorted((g[:-1] for g in good if g[-1] == "\0"), key=len):
        if not any(g.startswith(s) for s in stems):
            stems.add(g)
    words = {g for g in good if g[-1] != "\0"}
    # A stem that one accepted word accounts for adds nothing.
    stems = {s for s in stems if max((toxic[w] for w in words if w.startswith(s)), default=0) < 0.9 * toxic[s + "\0"]}
    return {w for w in words if not any(w.startswith(s) for s in stems)}, stems


def obfuscated(low: str) -> list[str]:
    """Words with a symbol or digit between two letters, from where their letters begin; one scan of the text."""
    found = []
    for run in _RUN.finditer(low):
        word = run[0]
        if hidden := _HIDDEN.search(word):
            begin = hidden.start()
            while begin and word[begin - 1].isalnum():
                begin -= 1
            found.append(word[begin:])
    return found


class Model:
    """Lexicon, trees and calibration; small enough to travel with the tasks."""

    def __init__(self, words: set[str], stems: set[str]):
        self.words, self.stems = words, stems
        self.trees, self.calibration = Boosted(), Isotonic()
        self._automaton = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None}

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for w in self.stems:
                self._automaton.add_word(w, (len(w), True))
            for w in self.words:
                self._automaton.add_word(w, (len(w), False))
            if self.words or self.stems:
                self._automaton.make_automaton()
        return self._automaton

    def _hits(self, low: str) -> tuple[int, int, int]:
        """Hits on words, hits on stems, and how many have a second-person word near."""
        word = stem = near = 0
        if not (self.words or self.stems):
            return 0, 0, 0
        for end, (size, is_stem) in self.automaton().iter(low):
            start = end - size + 1
            if start and low[start - 1].isalnum() or not is_stem and end + 1 < len(low) and low[end + 1].isalnum():
                continue
            word += not is_stem
            stem += is_stem
            around = _WORD.findall(low[max(0, start - NEAR_CHARS) : end + NEAR_CHARS])
            near += not SECOND_PERSON.isdisjoint(around)
        return word, stem, near

    def _obfuscated_hits(self, low: str) -> int:
        n = 0
        for w in obfuscated(low):
            w = w.translate(_LEET)
            n += w in self.words or any(w.startswith(s) for s in self.stems)
        return n

    def features(self, text: str | None) -> list[float]:
        """One row of ``FEATURES``; a null text counts as an empty one."""
        text = text or ""
        raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        low = text.lower()
        size = max(1, len(raw))
        per = np.bincount(raw, minlength=256)
        words = int(per[32] + per[9:14].sum()) + 1
        kind = _KIND[raw]
        letters = max(1, int((kind == 1).sum()))
        odd = int(((kind[1:-1] == 2) & (kind[:-2] == 1) & (kind[2:] == 1)).sum()) if size > 2 else 0
        runs = int(((raw[1:-1] == raw[:-2]) & (raw[1:-1] == raw[2:]) & (kind[1:-1] == 1)).sum()) if size > 2 else 0
        word, stem, near = self._hits(low)
        hidden = self._obfuscated_hits(low) if odd else 0
        return [
            word / words, stem / words, math.log1p(word + stem), math.log1p(hidden), near / max(1, word + stem), int(per[65:91].sum()) / letters,
            int(per[33]) / words, int(per[_PUNCT].sum()) / size, odd / words, runs / words, math.log1p(words),
        ]

    def matrix(self, texts: list[str | None]) -> np.ndarray:
        return np.array([self.features(t) for t in texts], float).reshape(len(texts), len(FEATURES))

    def probability(self, texts: list[str | None]) -> np.ndarray:
        return self.calibration(self.trees.margin(self.matrix(texts)))


def fit(ids: list[int], texts: list[str], labels: list[int]) -> Model:
    """Lexicon and trees from two thirds of the distinct rows, calibration from the rest."""
    keep = representative(texts)
    parts = [[i for k, i in enumerate(keep) if (k % 3 == 2) == held] for held in (False, True)]
    train, held = parts
    model = Model(*learn_lexicon([texts[i] for i in train], [labels[i] for i in train]))
    x, y = model.matrix([texts[i] for i in train]), np.array([labels[i] > 0 for i in train], float)
    model.trees.fit(x, y)
    if held:
        model.calibration.fit(model.trees.margin(model.matrix([texts[i] for i in held])), np.array([labels[i] > 0 for i in held], float))
    else:  # without labels nothing is rejected
        model.calibration.x, model.calibration.p = np.array([0.0]), np.array([0.0])
    return model


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Model:
    return fitted(sample(docs, labels, "toxic", most), fit)


def probability(model: Model) -> Callable[[Column], Column]:
    @F.pandas_udf("double")
    def toxic(text: pd.Series) -> pd.Series:
        return pd.Series(model.probability(text.tolist()))

    return toxic


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, toxicity, rejected)`` for every row of ``docs``.

    Null and empty texts get the probability of a text without any hit, null
    ids stay null, repeated rows are scored each, an empty table gives none.
    """
    importable(docs.sparkSession)
    scored = docs.select("doc_id", probability(model)(F.col("text")).alias("toxicity"))
    return scored.withColumn("rejected", F.col("toxicity") >= threshold)


def keep(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, that aren't rejected."""
    importable(docs.sparkSession)
    (name,) = fresh(docs, "toxicity")
    return docs.withColumn(name, probability(model)(F.col("text"))).where(F.col(name) < threshold).drop(name)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
