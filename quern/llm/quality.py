"""Quality classifier by compression with dictionaries of good and of bad text.

Two zstandard dictionaries are trained, one per class. A whole text is cut into
pieces of equal size, so that a dictionary helps a long text as much as a
short one; every piece is compressed with both. The difference of the two
sizes over the size of the text is the score; isotonic regression on held-out
rows makes it a probability of being good.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.boosting import Isotonic
from quern.llm.common import fresh, importable, table
from quern.llm.labelled import fitted, representative, sample

#: Labelled rows that the model is fitted on, at most.
MAX_LABELLED = 8_000
#: Documents below this probability of being good are rejected.
THRESHOLD = 0.5
PIECE = 1024
DICT_BYTES = 112_640
#: (bytes of difference, bytes of text) that every text is given, so that a short one isn't judged on a byte or two.
PRIOR = (4, 64)
LEVEL = 3


def pieces(text: str | None) -> list[bytes]:
    raw = (text or "").encode("utf-8", "replace")
    n = max(1, round(len(raw) / PIECE))
    edge = [len(raw) * i // n for i in range(n + 1)]
    return [raw[a:b] for a, b in zip(edge, edge[1:])]


class Model:
    def __init__(self, good: bytes, bad: bytes):
        self.dicts = (good, bad)
        self.calibration = Isotonic()
        self._made = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_made": None}

    def compressors(self):
        if self._made is None:
            import zstandard as Z

            self._made = []
            for d in self.dicts:
                z = Z.ZstdCompressionDict(d, dict_type=Z.DICT_TYPE_RAWCONTENT if d[:4] != b"\x37\xa4\x30\xec" else Z.DICT_TYPE_AUTO)
                z.precompute_compress(level=LEVEL)
                self._made.append(Z.ZstdCompressor(level=LEVEL, dict_data=z, write_content_size=False, write_dict_id=False, write_checksum=False))
        return self._made

    def score(self, text: str | None) -> float:
        """(bytes with the bad dictionary - bytes with the good one) / bytes of the text, drawn to ``PRIOR`` where the text is short."""
        good, bad = self.compressors()
        total = diff = 0
        for p in pieces(text):
            total += len(p)
            diff += len(bad.compress(p)) - len(good.compress(p))
        return (diff + PRIOR[0]) / (total + PRIOR[1])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return np.array([self.score(t) for t in texts], float)

    def probability(self, texts: list[str | None]) -> np.ndarray:
        return self.calibration(self.scores(texts))


def _dictionary(texts: list[str]) -> bytes:
    import zstandard as Z

    cut = [p for t in texts for p in pieces(t)]
    try:
        return Z.train_dictionary(DICT_BYTES, cut, k=1024, d=8, level=LEVEL).as_bytes()
    except Z.ZstdError:  # too few rows for the trainer: their bytes serve as they are
        return (b"".join(cut) or b"\n")[-DICT_BYTES:].rjust(8, b" ")


def fit(ids: list[int], texts: list[str], labels: list[int]) -> Model:
    """Dictionaries from two thirds of the distinct rows, calibration from the rest."""
    keep = representative(texts)
    train, held = [[i for k, i in enumerate(keep) if (k % 3 == 2) == held] for held in (False, True)]
    model = Model(*(_dictionary([texts[i] for i in train if (labels[i] > 0) == good]) for good in (True, False)))
    if held:
        model.calibration.fit(model.scores([texts[i] for i in held]), np.array([labels[i] > 0 for i in held], float))
    else:  # without labels nothing is rejected
        model.calibration.x, model.calibration.p = np.array([0.0]), np.array([1.0])
    return model


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Model:
    """A model fitted on at most ``most`` labelled rows: dictionaries and calibration from their whole texts."""
    return fitted(sample(docs, labels, "quality", most), fit)


def probability(model: Model) -> Callable[[Column], Column]:
    @F.pandas_udf("double")
    def good(text: pd.Series) -> pd.Series:
        return pd.Series(model.probability(text.tolist()))

    return good


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, quality, rejected)`` for every row of ``docs``.

    A null text counts as an empty one, whose score is that of ``PRIOR``;
    null ids stay null, repeated rows are scored each, an empty table gives none.
    """
    importable(docs.sparkSession)
    scored = docs.select("doc_id", probability(model)(F.col("text")).alias("quality"))
    return scored.withColumn("rejected", F.col("quality") < threshold)


def keep(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, that aren't rejected."""
    importable(docs.sparkSession)
    (name,) = fresh(docs, "quality")
    return docs.withColumn(name, probability(model)(F.col("text"))).where(F.col(name) >= threshold).drop(name)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
