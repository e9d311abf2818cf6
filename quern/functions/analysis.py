"""Analyzers: from text to tokens with positions, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

STOPWORDS = tuple("a an the and or but of to in on for with as at by from into about over after before between without".split())
TOKEN = "[\\p{L}\\p{N}]+"

#: From a text column to an array of (term, pos).
Analyzer = Callable[[Column], Column]
_custom: dict[str, Analyzer] = {}


def simple(stopwords: Iterable[str] = ()) -> Analyzer:
    """Lower case, runs of letters and digits, without stopwords, which leave gaps in the positions."""
    stop = [w.strip().lower() for w in stopwords]

    def analyze(text: Column) -> Column:
        terms = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
        tokens = F.transform(terms, lambda t, i: F.struct(t.alias("term"), i.cast("int").alias("pos")))
        return F.filter(tokens, lambda x: ~x["term"].isin(stop)) if stop else tokens

    return analyze


def keyword(value: Column, is_array: bool) -> Column:
    """The whole value in lower case as one token, or one for each element; nulls give none."""
    items = value if is_array else F.array(value)
    tokens = F.transform(items, lambda t, i: F.struct(F.lower(t).alias("term"), i.cast("int").alias("pos")))
    return F.filter(tokens, lambda x: x["term"].isNotNull())


def register(name: str, analyzer: Analyzer) -> None:
    """Make an analyzer of one's own known by a name."""
    _custom[name.strip().lower()] = analyzer


def analyzer_for(name: str) -> Analyzer:
    """By name, trimmed and in any case; an unknown one is the standard analyzer."""
    key = name.strip().lower()
    return _custom.get(key) or simple(STOPWORDS if key == "standard_en" else ())
