"""Helpers over ordered rows and arrays."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def over(*keys: str, by: list | tuple = ()) -> WindowSpec:
    spec = Window.partitionBy(*keys)
    return spec.orderBy(*by) if by else spec


def running(*keys: str, by: list | tuple) -> WindowSpec:
    """All rows up to this one."""
    return over(*keys, by=by).rowsBetween(Window.unboundedPreceding, 0)


def earlier(*keys: str, by: list | tuple) -> WindowSpec:
    """All rows before this one."""
    return over(*keys, by=by).rowsBetween(Window.unboundedPreceding, -1)


def joined(order: list[str], value: str, sep: str) -> Column:
    """Aggregate: the values joined in order of the columns named."""
    rows = F.array_sort(F.collect_list(F.struct(*dict.fromkeys([*order, value]))))
    return F.array_join(F.transform(rows, lambda r: r[value]), sep)


def words_pattern(words: list[str]) -> str:
    """A pattern of any of the phrases, bounded by non-words, in ASCII terms."""
    return r"(^|[^a-z0-9_])(" + "|".join(words) + r")([^a-z0-9_]|$)"
