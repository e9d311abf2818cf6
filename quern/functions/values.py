"""Values as the filters see them: numbers, trimming, equality."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DECIMAL = re.compile(r"[+-]?(?:inf(?:inity)?|nan|(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?)", re.I)
_HEX = re.compile(r"[+-]?0x(?:[0-9a-f]+\.?[0-9a-f]*|\.[0-9a-f]+)p[+-]?\d+", re.I)
_NUMBER = "^[+-]?((?i)inf(inity)?|nan|([0-9]+\\.?[0-9]*|\\.[0-9]+)(e[+-]?[0-9]+)?)$"
_HEX_NUMBER = "^([+-]?)0[xX]([0-9a-fA-F]*)(?:[.]([0-9a-fA-F]*))?[pP]([+-]?[0-9]+)$"
_TRIM = "(?U)^\\s+|\\s+$"


def parse_float(text: str) -> float | None:
    """A float literal, decimal or hexadecimal, without any blanks; None if it isn't one or is out of range."""
    if _DECIMAL.fullmatch(text):
        value = float(text)
    elif _HEX.fullmatch(text):
        try:
            value = float.fromhex(text)
        except OverflowError:
            return None
    else:
        return None
    return None if math.isinf(value) and "n" not in text.lower() else value


def trimmed(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, _TRIM, "")


def _hexadecimal(text: Column) -> Column:
    """The double of a hexadecimal literal, from its first 15 significant digits; null where it has no digit or is out of range."""
    part = lambda i: F.regexp_extract(text, _HEX_NUMBER, i)
    digits = F.regexp_replace(F.concat(part(2), part(3)), "^0+", "")
    high = F.conv(F.substring(digits, 1, 15), 16, 10).cast("double")
    power = part(4).try_cast("int") + 4 * (F.greatest(F.length(digits), F.lit(15)) - 15) - 4 * F.length(part(3))
    # In two steps, so that a power that is out of range alone isn't.
    half = F.floor(power / 2)
    value = F.when(digits == "", 0.0).otherwise(high * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), power - half))
    signed = F.when(part(1) == "-", -value).otherwise(value)
    return F.when((F.length(F.concat(part(2), part(3))) > 0) & (F.abs(signed) < float("inf")), signed)


def number(column: Column, kind: T.DataType) -> Column:
    """The double that a value counts as, or null: numbers, and strings that are float literals."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)):
        return column.cast("double")
    if isinstance(kind, T.StringType):
        text = trimmed(column)
        value = text.try_cast("double")
        infinite = value.isin(float("inf"), float("-inf")) & ~F.lower(text).contains("inf")
        return F.when(text.rlike(_NUMBER) & ~infinite, value).when(text.rlike(_HEX_NUMBER), _hexadecimal(text))
    return F.lit(None).cast("double")
