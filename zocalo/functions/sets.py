"""Ordered lists and sets held in array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY = "cast(array() as array<string>)"


def none() -> Column:
    return F.expr(EMPTY)


def ordered_union(*lists: Column) -> Column:
    """All items, first occurrence order kept."""
    return F.array_distinct(F.concat(*lists))


def given(condition: Column, items: list[str]) -> Column:
    """The items where the condition holds, else an empty list."""
    return F.when(condition, F.array(*[F.lit(i) for i in items])).otherwise(none())


def name_set(x: Column, transform=lambda v: v) -> Column:
    """Trimmed, non-empty, distinct, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(x, lambda v: transform(F.trim(v))), lambda v: v != "")))


def split_names(x: Column) -> Column:
    return F.split(x, ",")


def same_set(a: Column, b: Column, transform=lambda v: v) -> Column:
    return name_set(a, transform) == name_set(b, transform)


def subset(part: Column, whole: Column) -> Column:
    return F.size(F.array_except(part, whole)) == 0


def disjoint(a: Column, b: Column) -> Column:
    """Both non-empty and without a common item."""
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)


def unknown_names(cited: Column, own: Column, allowed: Column) -> Column:
    return F.array_sort(F.array_except(F.array_except(cited, own), allowed))
