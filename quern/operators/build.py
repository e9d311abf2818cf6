"""Index build: documents to tokens, postings, lengths and statistics."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.analysis import analyzer_for, keyword
from quern.sources.catalog import TEXT, Definition

#: The version of a document: its segment, and its place in it.
VERSION = ("segment_seq", "ordinal")
#: The bucket of rows that stand for a document itself, not for a term of it.
ITSELF = -1
#: Tokens that are gathered at a time, more only where one document has more; and rows that are handed on at a time.
GATHERED, HANDED = 1 << 20, 1 << 16


def column(df: DataFrame, name: str) -> Column | None:
    """A column by its exact name, whatever Spark's case sensitivity; None if there is none."""
    return F.col(f"`{name.replace('`', '``')}`") if name in df.columns else None


def kind(df: DataFrame, name: str) -> T.DataType:
    return next(f.dataType for f in df.schema.fields if f.name == name)


def analysed(df: DataFrame, definition: Definition) -> list[tuple[str, float, Column]]:
    """Of each field that has tokens, in the order of names: its weight, and the array of (term, pos), which may be null.

    A field that the table lacks, a null, and a type that can't be indexed
    give none. Arrays in a text field are joined by blanks.
    """
    parts: list[tuple[str, float, Column]] = []
    analyze = analyzer_for(definition.tokenizer)
    for name, spec in sorted(definition.fields.items()):
        value = column(df, name)
        if value is None:
            continue
        of = kind(df, name)
        is_array = isinstance(of, T.ArrayType)
        if spec.type == TEXT:
            text = F.array_join(value.cast("array<string>"), " ") if is_array else value.cast("string")
            tokens = analyze(text)
        elif isinstance(of, T.StringType) or is_array and isinstance(of.elementType, T.StringType):
            tokens = keyword(value, is_array)
        else:
            continue
        parts.append((name, float(spec.weight), tokens))
    return parts


def field_tokens(df: DataFrame, definition: Definition) -> Column:
    """All tokens of a document in one array of (field, term, pos, weight): one scan, one explode."""
    none = F.array().cast("array<struct<field:string,term:string,pos:int,weight:double>>")
    parts = [F.coalesce(_weighed(tokens, name, weight), none) for name, weight, tokens in analysed(df, definition)]
    return F.concat(*parts) if parts else none


def _weighed(tokens: Column, name: str, weight: float) -> Column:
    return F.transform(tokens, lambda x: F.struct(F.lit(name).alias("field"), x["term"].alias("term"), x["pos"].alias("pos"), F.lit(float(weight)).alias("weight")))


def _of_field(tokens: Column, name: str) -> Column:
    return F.filter(tokens, lambda x: x["field"] == name)


def tokens(docs: DataFrame, definition: Definition, keep: Sequence[str] = ("id",)) -> DataFrame:
    """One row a token: the ``keep`` columns, field, term, pos, weight."""
    return docs.select(*keep, F.inline(field_tokens(docs, definition)))


def indexed(docs: DataFrame, definition: Definition, keep: Sequence[str], buckets: int) -> DataFrame:
    """Documents and their postings in one pass, without a shuffle: ``(*keep, dl, term, tf, positions, term_bucket)``.

    A document is one row without a term, of bucket ``ITSELF``, and one row a
    term: tf is the sum of the fields' weights, positions of all fields in
    order; empty terms aren't indexed. dl, the document's length, travels
    along, so that scoring needs no join. A task gathers ``GATHERED`` tokens
    at a time, and its rows come in runs sorted by bucket and term.
    """
    fields = analysed(docs, definition)
    told = docs.select(*keep, *[tokens.cast("array<struct<term:string,pos:int>>").alias(f"__{k}") for k, (_, _, tokens) in enumerate(fields)])
    own, weights, itself, most, piece = len(keep), [w for _, w, _ in fields], ITSELF, GATHERED, HANDED
    schema = T.StructType([*told.schema.fields[:own], *(T.StructField(n, t) for n, t in (("dl", T.LongType()), ("term", T.StringType()), ("tf", T.DoubleType()), ("positions", T.ArrayType(T.IntegerType())), ("term_bucket", T.IntegerType())))])
    names = schema.names

    def in_order(word: np.ndarray, doc: np.ndarray, n: int, at: np.ndarray, field: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens by word, document and position: word * n + doc, position, field. As one integer each, where that is large enough, as it nearly always is."""
        key, bits = word * n + doc, (int(at.max()).bit_length(), len(weights).bit_length())
        if at.min() >= 0 and int(key.max()).bit_length() + sum(bits) < 64:
            one = np.sort(((key << bits[0] | at) << bits[1]) | field)
            return one >> sum(bits), one >> bits[1] & (1 << bits[0]) - 1, one & (1 << bits[1]) - 1
        order = np.lexsort((at, key))
        return key[order], at[order], field[order]

    def postings_of(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        of, term, at, field = [np.zeros(0, np.int64)], [pa.array([], pa.string())], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, column in enumerate(b.columns[own:]):
            doc = np.repeat(np.arange(b.num_rows), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
            terms, pos = column.flatten().flatten()
            good = pc.fill_null(pc.not_equal(terms, ""), False)
            if not pc.all(good, min_count=0).as_py():
                terms, pos, doc = terms.filter(good), pos.filter(good), doc[good.to_numpy(zero_copy_only=False)]
            of.append(doc)
            term.append(terms.cast(pa.string()))
            at.append(pos.to_numpy(zero_copy_only=False).astype(np.int64))
            field.append(np.full(len(doc), k))
        of, at, field = (np.concatenate(x) for x in (of, at, field))
        dl = np.bincount(of, minlength=b.num_rows)
        none = lambda kind: pa.nulls(b.num_rows, kind)
        yield pa.RecordBatch.from_arrays([*b.columns[:own], pa.array(dl, pa.int64()), none(pa.string()), none(pa.float64()), none(pa.list_(pa.int32())), pa.array(np.full(b.num_rows, itself, np.int32))], names=names)
        if not len(of):
            return
        coded = pa.concat_arrays(term).dictionary_encode()
        words = coded.dictionary
        bucket = (np.fromiter(map(zlib.crc32, words.cast(pa.binary()).to_pylist()), np.int64, len(words)) % buckets).astype(np.int32)
        by = pc.sort_indices(pa.table({"bucket": bucket, "word": words}), sort_keys=[("bucket", "ascending"), ("word", "ascending")]).to_numpy()
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        key, at, field = in_order(place[coded.indices.to_numpy()], of, b.num_rows, at, field)
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        word, doc = np.divmod(key[start], b.num_rows)
        edge = np.append(start, len(key)).astype(np.int32)
        tf = np.add.reduceat(np.array(weights)[field], start) if len(weights) > 1 else np.diff(edge) * weights[0]
        at, words, bucket = pa.array(at, pa.int32()), words.take(pa.array(by)), bucket[by]
        for i in range(0, len(start), piece):
            w, d = word[i : i + piece], doc[i : i + piece]
            lists = pa.ListArray.from_arrays(pa.array(edge[i : i + piece + 1] - edge[i]), at.slice(edge[i], edge[min(i + piece, len(start))] - edge[i]))
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(d)) for c in b.columns[:own]), pa.array(dl[d], pa.int64()), words.take(pa.array(w)), pa.array(tf[i : i + piece]), lists, pa.array(bucket[w])], names=names)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.zeros(b.num_rows, np.int64)
            for column in b.columns[own:]:
                size += pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            upto, at = np.cumsum(size), 0
            while at < b.num_rows:
                before = upto[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(upto, before + most, "right")))
                yield from postings_of(b.slice(at, to - at))
                at = to

    return told.mapInArrow(gather, schema)


def postings(docs: DataFrame, definition: Definition, keep: Sequence[str] = ("id", *VERSION)) -> DataFrame:
    """One row per term and document, as in ``indexed``."""
    return indexed(docs, definition, keep, 1).where(F.col("term_bucket") != ITSELF).select("term", *keep, "dl", "tf", "positions")


def lengths(docs: DataFrame, definition: Definition, keep: Sequence[str] = ("id", *VERSION)) -> DataFrame:
    """Every document with its length, 0 for one without a term."""
    return docs.select(*keep, F.size(F.filter(field_tokens(docs, definition), lambda x: x["term"] != "")).cast("bigint").alias("dl"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row: n, all documents, and avgdl, the mean length of those that have a term (null where none has)."""
    return lengths.agg(F.count("*").alias("n"), F.avg(F.when(F.col("dl") > 0, F.col("dl"))).alias("avgdl"))


def document_frequency(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def average_field_lengths(docs: DataFrame, definition: Definition) -> DataFrame:
    """``(field, total, average)``: tokens of each declared field, also over documents that lack it."""
    sums = []
    every = field_tokens(docs, definition)
    for name in sorted(definition.fields):
        sums.append(F.sum(F.size(_of_field(every, name))).cast("bigint").alias(name))
    wide = docs.agg(F.count("*").alias("__n"), *sums)
    rows = F.array(*[F.struct(F.lit(n).alias("field"), F.coalesce(F.col(f"`{n}`"), F.lit(0)).alias("total")) for n in sorted(definition.fields)])
    return wide.select("__n", F.inline(rows)).select("field", "total", F.when(F.col("__n") > 0, F.col("total") / F.col("__n")).otherwise(0.0).alias("average"))


def flush(docs: DataFrame, tokens_column: str, documents: int, postings: int, order: Sequence[str]) -> DataFrame:
    """``docs`` with ``segment``: a new one once so many documents or tokens are held; 0 is no bound.

    The running counts begin again with each segment, so that the place of a
    document depends on all before it: one task reads the order and the sizes
    alone, as a stream, and holds two counts.
    """
    sizes = docs.select(*order, F.col(tokens_column).cast("bigint").alias("__size"))
    schema = T.StructType([f for f in sizes.schema.fields if f.name != "__size"] + [T.StructField("segment", T.IntegerType())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = held = tokens = 0
        for b in batches:
            out = []
            for size in b.column(b.num_columns - 1).to_pylist():
                out.append(segment)
                held, tokens = held + 1, tokens + (size or 0)
                if documents > 0 and held >= documents or postings > 0 and tokens >= postings:
                    segment, held, tokens = segment + 1, 0, 0
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.int32())], names=[*b.schema.names[:-1], "segment"])

    assigned = sizes.repartition(1).sortWithinPartitions(*order).mapInArrow(fold, schema)
    return docs.join(assigned, list(order))


def flush_by_documents(docs: DataFrame, most: int, order: Sequence[str]) -> DataFrame:
    """``docs`` with ``segment``: a new one after every ``most`` documents in the given order; 0 is no bound."""
    return flush(docs.withColumn("__none", F.lit(0)), "__none", most, 0, order).drop("__none")
