"""Choosing columns by name, pattern, position or type; everything resolves against a schema, without a job."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import types as T


class Selector:
    def __init__(self, pick: Callable[[T.StructType], list[str]]) -> None:
        self.pick = pick

    def __and__(self, other: object) -> Selector:
        return Selector(lambda s: [c for c in self.pick(s) if c in resolve(s, [other])])

    def __or__(self, other: object) -> Selector:
        return Selector(lambda s: list(dict.fromkeys([*self.pick(s), *resolve(s, [other])])))

    def __invert__(self) -> Selector:
        return Selector(lambda s: [c for c in s.names if c not in self.pick(s)])

    __neg__ = __invert__


def all_of(names: list[str]) -> Selector:
    def pick(s: T.StructType) -> list[str]:
        if missing := [n for n in names if n not in s.names]:
            raise KeyError(f"no such columns: {missing}")
        return list(names)

    return Selector(pick)


def any_of(names: list[str]) -> Selector:
    return Selector(lambda s: [n for n in names if n in s.names])


def where(test: Callable[[T.DataType], bool]) -> Selector:
    return Selector(lambda s: [f.name for f in s if test(f.dataType)])


def _named(test: Callable[[str], bool]) -> Selector:
    return Selector(lambda s: [n for n in s.names if test(n)])


def contains(text: str) -> Selector:
    return _named(lambda n: text.lower() in n.lower())


def starts_with(text: str) -> Selector:
    return _named(lambda n: n.lower().startswith(text.lower()))


def ends_with(text: str) -> Selector:
    return _named(lambda n: n.lower().endswith(text.lower()))


def matches(pattern: str) -> Selector:
    return _named(lambda n: re.search(pattern, n) is not None)


def num_range(prefix: str, numbers: range | list[int]) -> Selector:
    return any_of([f"{prefix}{i}" for i in numbers])


def everything() -> Selector:
    return Selector(lambda s: list(s.names))


def last_col(offset: int = 0) -> Selector:
    return Selector(lambda s: [s.names[-1 - offset]])


def nothing() -> Selector:
    return Selector(lambda s: [])


def span(first: str, last: str) -> Selector:
    """All columns from first to last, either way round."""

    def pick(s: T.StructType) -> list[str]:
        a, b = s.names.index(first), s.names.index(last)
        return s.names[a : b + 1] if a <= b else s.names[b : a + 1][::-1]

    return Selector(pick)


def is_numeric(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def is_string(t: T.DataType) -> bool:
    return isinstance(t, T.StringType)


def resolve(schema: T.StructType, wanted: list | tuple) -> list[str]:
    """Names, "-name", "a:b", positions (from 1, negative: without) and selectors -> column names, each once.

    A selection that starts with an exclusion starts from all columns.
    """
    out: list[str] = []
    for i, w in enumerate(wanted):
        if isinstance(w, Selector):
            got, drop = w.pick(schema), False
        elif isinstance(w, bool) or not isinstance(w, (str, int)):
            raise TypeError(f"not a column selection: {w!r}")
        elif isinstance(w, int):
            if not 1 <= abs(w) <= len(schema.names):
                raise KeyError(f"no column at {w}")
            got, drop = [schema.names[abs(w) - 1]], w < 0
        elif w in schema.names:
            got, drop = [w], False
        elif w[:1] == "-" and w[1:] in schema.names:
            got, drop = [w[1:]], True
        elif w.count(":") == 1 and all(x in schema.names for x in w.split(":")):
            got, drop = span(*w.split(":")).pick(schema), False
        else:
            raise KeyError(f"no such column: {w}")
        if drop:
            out = [c for c in (schema.names if i == 0 else out) if c not in got]
        else:
            out += [c for c in got if c not in out]
    return out
