"""Token ids as ORC: run-length encoded integers in stripes, row indexes and Bloom filters on document ids.

Rows are sorted by id within each task's file, so that the minima and maxima
of stripes and row groups prune well, without a shuffle of the tokens; the
Bloom filters prune what these can't. Spark reads a file by its stripes in
parallel and pushes conditions on ids down to the metadata.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.bpe import PATTERN, VOCABULARY, encoder_of
from quern.llm.common import importable, new_dir, table

SCHEMA = "doc_id bigint, n_tokens bigint, tokens array<int>"
#: Bytes of a stripe, rows of a row group, and the Bloom filters' share of false positives.
STRIPE, ROW_GROUP, FALSE_POSITIVES = 16 << 20, 1_000, 0.01


@lru_cache(2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def tokenised(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``(doc_id, n_tokens, tokens)`` of every row; a null text has no tokens.

    A text that the library can't cut into pieces (it gives up on a million
    blanks in a row) is encoded by operator 7, whose tokens are the same.
    """
    importable(docs.sparkSession)

    def tokens(encode, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        try:
            return encode(text)
        except ValueError:
            return encoder_of(path).encode(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(path).encode_to_numpy
        for b in batches:
            own = [tokens(encode, t) for t in b.column(1).to_pylist()]
            size = np.array([len(x) for x in own], np.int64)
            flat = np.concatenate([*own, np.zeros(0, np.uint32)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size), lists], names=["doc_id", "n_tokens", "tokens"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, SCHEMA)


def write(tokens: DataFrame, path: str, stripe: int = STRIPE, row_group: int = ROW_GROUP) -> None:
    """Write ``(doc_id, n_tokens, tokens)`` as ORC files into a new folder.

    Null ids are kept and found by ``doc_id IS NULL``; repeated ids are kept
    all; empty and very long lists are ordinary; an empty table leaves a
    folder that reads as one.
    """
    options = {
        "orc.compress": "zstd", "orc.stripe.size": str(stripe), "orc.row.index.stride": str(row_group), "orc.create.index": "true",
        "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": str(FALSE_POSITIVES), "orc.encoding.strategy": "COMPRESSION",
    }
    tokens.select("doc_id", "n_tokens", "tokens").sortWithinPartitions("doc_id").write.format("orc").options(**options).save(path)


def read(spark: SparkSession, path: str, ids: Iterable[int] | None = None) -> DataFrame:
    """All rows, or those of some ids, whose stripes and row groups alone are then read."""
    rows = spark.read.schema(SCHEMA).orc(path)
    return rows if ids is None else rows.where(F.col("doc_id").isin([int(i) for i in ids]))


def op10_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_dir(spark, "tokens-orc")
    write(tokenised(table(spark, sf_dir, "documents")), path)
    return read(spark, path)
