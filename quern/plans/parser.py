"""The query language, parsed on the driver into required, excluded and filter parts.

Words are required; ``+`` says so too, ``-`` excludes. What is in quotes is
one token and, with a blank in it, a phrase. A token with a comparison or a
colon in it is a filter, whatever its sign.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from quern.functions.values import parse_float

#: What counts as white space.
SPACE = "\t\n\v\f\r \x85\xa0  -     　"
_SPACES = re.compile(f"[{SPACE}]+")
_ENDS = re.compile(f"^[{SPACE}]+|[{SPACE}]+$")
COMPARISONS = (">=", "<=", ">", "<")


@dataclass(frozen=True)
class Clause:
    """A word, or a phrase of several, that must or must not match."""

    words: tuple[str, ...]
    phrase: bool = False
    negative: bool = False


@dataclass(frozen=True)
class Filter:
    """op is one of =, the comparisons, and range, whose open ends are None."""

    field: str
    op: str
    value: str | float | None = None
    low: float | None = None
    high: float | None = None


@dataclass(frozen=True)
class Parsed:
    clauses: tuple[Clause, ...] = ()
    filters: tuple[Filter, ...] = ()

    @property
    def positive(self) -> tuple[Clause, ...]:
        return tuple(c for c in self.clauses if not c.negative)

    @property
    def scoring(self) -> tuple[str, ...]:
        """Words that score and are highlighted: those of all positive clauses, once each."""
        return tuple(dict.fromkeys(w for c in self.positive for w in c.words))


def trim(text: str) -> str:
    return _ENDS.sub("", text)


def lex(text: str) -> list[str]:
    """Tokens between white space and quotes; a quote ends a token, and the last need not be closed."""
    tokens: list[str] = []
    for i, part in enumerate(text.split('"')):
        tokens += [part] if i % 2 else _SPACES.split(part)
    return [t for t in tokens if t]


def parse_filter(token: str) -> Filter | None:
    for op in COMPARISONS:
        name, found, value = token.partition(op)
        name, value = trim(name), trim(value)
        if found and name and value:
            # A literal that isn't a number compares as 0.
            return Filter(name, op, parse_float(value) or 0.0)
    name, found, value = token.partition(":")
    name, value = trim(name), trim(value)
    if not (found and name and value):
        return None
    if "-" in value:
        low, high = map(parse_float, value.split("-", 1))
        if low is not None or high is not None:
            return Filter(name, "range", None, low, high)
    as_number = parse_float(value)
    return Filter(name, "=", value if as_number is None else as_number)


def parse(query: str, filters: str = "") -> Parsed:
    clauses: list[Clause] = []
    found: list[Filter] = []
    for token in lex(query) + lex(filters):
        negative = token[0] == "-"
        if token[0] in "+-":
            token = token[1:]
        if (f := parse_filter(token)) is not None:
            found.append(f)
        elif " " in token and (words := [w.lower() for w in _SPACES.split(token) if w]):
            clauses.append(Clause(tuple(words), True, negative))
        elif word := trim(token).lower():
            clauses.append(Clause((word,), False, negative))
    return Parsed(tuple(clauses), tuple(found))


@dataclass(frozen=True)
class Page:
    """Page and size as they are used: at least 1, by default 10, at most 100."""

    number: int = 1
    size: int = 10
    offset: int = field(init=False, default=0)

    def __post_init__(self) -> None:
        object.__setattr__(self, "number", self.number if self.number > 0 else 1)
        object.__setattr__(self, "size", min(self.size, 100) if self.size > 0 else 10)
        object.__setattr__(self, "offset", (self.number - 1) * self.size)


def parse_int(text: str | None, default: int) -> int:
    """A whole number in decimal, or the default where the text is blank; ValueError else."""
    if text is None or not trim(text):
        return default
    if not re.fullmatch(r"[+-]?[0-9]+", text):
        raise ValueError(f"not a whole number: {text!r}")
    return int(text)
