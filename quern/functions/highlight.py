"""Snippets: the words around the first match, with all matches there emphasised."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

AROUND = 3
_EDGES = ",.!?:;"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def snippet(text: Column, terms: Sequence[str]) -> Column:
    """Up to seven words of a text, or null where no word is one of the terms."""
    matches = lambda w: F.lower(F.btrim(w, F.lit(_EDGES))).isin(list(terms))

    def around(words: Column, first: Column) -> Column:
        start = F.greatest(first - AROUND, F.lit(1)).cast("int")
        size = (F.least(first + AROUND, F.size(words)) - start + 1).cast("int")
        window = F.transform(F.slice(words, start, size), lambda w: F.when(matches(w), F.concat(F.lit("<em>"), w, F.lit("</em>"))).otherwise(w))
        return F.when(F.coalesce(first, F.lit(0)) > 0, F.array_join(window, " "))

    found = lambda words: _once(F.array_position(F.transform(words, matches), True), lambda first: around(words, first))
    return _once(F.filter(F.split(text, "(?U)\\s+"), lambda w: w != ""), found)


def highlights(fields: Sequence[tuple[str, Column]], terms: Sequence[str]) -> Column:
    """A map from the text fields that match to their snippets; null where none does."""
    if not fields or not terms:
        return F.lit(None).cast("map<string,string>")
    found = F.map_filter(F.map_from_arrays(F.array(*[F.lit(n) for n, _ in fields]), F.array(*[snippet(c, terms) for _, c in fields])), lambda _, v: v.isNotNull())
    return F.when(F.size(found) > 0, found)
