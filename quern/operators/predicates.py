"""Filters as Column predicates that Spark pushes down where it can."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.values import number, trimmed
from quern.operators.build import column, kind
from quern.plans.parser import Filter, trim


def predicate(df: DataFrame, f: Filter) -> Column:
    """True or false, never null. A field that the table lacks, a null, and values of another type are false."""
    value = column(df, f.field)
    if value is None:
        return F.lit(False)
    of = kind(df, f.field)
    if f.op == "=":
        if isinstance(f.value, str):
            wanted = F.lit(trim(f.value).lower())
            if isinstance(of, T.StringType):
                return F.coalesce(F.lower(trimmed(value)) == wanted, F.lit(False))
            if isinstance(of, T.ArrayType) and isinstance(of.elementType, T.StringType):
                return F.coalesce(F.exists(value, lambda x: F.coalesce(F.lower(trimmed(x)) == wanted, F.lit(False))), F.lit(False))
            return F.lit(False)
        v = number(value, of)
        return F.coalesce((v == F.lit(float(f.value))) & ~F.isnan(v), F.lit(False))
    v = number(value, of)
    if f.op == "range":
        inside = F.lit(True)
        if f.low is not None:
            inside = inside & (v >= f.low)
        if f.high is not None:
            inside = inside & (v <= f.high)
        return F.coalesce(v.isNotNull() & (F.isnan(v) | inside), F.lit(False))
    x = F.lit(float(f.value or 0.0))
    compared = {">": v > x, ">=": v >= x, "<": v < x, "<=": v <= x}[f.op]
    return F.coalesce(compared & ~F.isnan(v) & ~F.isnan(x), F.lit(False))


def all_of(df: DataFrame, filters: tuple[Filter, ...]) -> Column:
    return reduce(lambda a, b: a & b, (predicate(df, f) for f in filters), F.lit(True))
