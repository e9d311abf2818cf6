"""Fitting on a bounded sample of labelled rows, in one task on an executor."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import importable
from quern.llm.grams import gram_set, mix


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """At most ``most`` labelled rows ``(doc_id, text, label)``, the same ones on every run.

    Rows are taken in the order of a hash of their id. Null ids, texts and
    labels give no row; an id labelled twice counts with its highest label,
    and one that several documents have with the least of their texts.
    """
    marks = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(F.col(label)).cast("int").alias("label"))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text")
    found = rows.join(F.broadcast(marks), "doc_id")  # at most `most` rows of two integers
    return found.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")


def fitted(rows: DataFrame, fit: Callable[[list[int], list[str], list[int]], object]) -> object:
    """``fit(doc_ids, texts, labels)`` run once, on an executor; the driver gets the model alone."""
    importable(rows.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, texts, marks = [], [], []
        for b in batches:
            ids += b["doc_id"].tolist()
            texts += b["text"].tolist()
            marks += b["label"].tolist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
        model = fit([ids[i] for i in order], [texts[i] for i in order], [marks[i] for i in order])
        yield pd.DataFrame({"model": [pickle.dumps(model)]})

    made = rows.select("doc_id", "text", "label").repartition(1).mapInPandas(run, "model binary").first()
    return pickle.loads(made[0]) if made else fit([], [], [])


def representative(texts: list[str]) -> list[int]:
    """Indices of texts without copies and near copies of earlier ones (by three min-hashes over word triples)."""
    seen: set[tuple[int, int]] = set()
    keep = []
    for i, text in enumerate(texts):
        grams = gram_set(text, 3)
        mins = [(s, int(mix(grams ^ np.uint64(s)).min()) if len(grams) else 0) for s in (1, 2, 3)]
        if not any(m in seen for m in mins):
            keep.append(i)
        seen.update(mins)
    return keep
