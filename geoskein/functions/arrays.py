"""Array and set helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_subset(a, b) -> Column:
    """Whether every element of a is in b."""
    return F.size(F.array_except(a, b)) == 0


def union_sorted(a, b) -> Column:
    return F.array_sort(F.array_union(a, b))


def unique_sorted(a) -> Column:
    return F.array_sort(F.array_distinct(a))


def unique_count(a) -> Column:
    return F.size(F.array_distinct(a))


def slide_pairwise(a) -> Column:
    """Neighbouring elements as structs (first, second); empty for fewer than two."""
    a = F.col(a) if isinstance(a, str) else a
    return F.transform(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), lambda x, k: F.struct(x.alias("first"), F.get(a, k + 1).alias("second")))


def moving_mean2(a) -> Column:
    """Means of neighbouring elements."""
    return F.transform(slide_pairwise(a), lambda p: (p["first"] + p["second"]) / 2)


def upper_pairs(n) -> Column:
    """(i, j) with i < j below n: the indices of an upper triangle, row by row."""
    last = n - 1
    rows = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(last - 1, F.lit(0)).cast("long")), lambda i: F.transform(F.sequence(i + 1, F.greatest(last, i + 1).cast("long")), lambda j: F.struct(i.alias("i"), j.alias("j"))))
    return F.filter(F.flatten(rows), lambda p: p["j"] <= last)


def unravel2d(index, columns) -> Column:
    """(row, column) of a flat index into a matrix with that many columns."""
    return F.struct(F.floor(index / columns).alias("row"), F.pmod(index, columns).alias("column"))


def counts_to_last_index(a) -> Column:
    """Running sum less one: the last flat index of each of consecutive runs."""
    return F.transform(F.sequence(F.lit(1), F.size(a)), lambda k: F.aggregate(F.slice(a, 1, k), F.lit(0).cast("long"), lambda s, x: s + x) - 1)


def stacked(columns: list, nested: list[bool] | None = None) -> Column:
    """Arrays side by side: an array of rows, each an array with one item of every column; all items of the row, where a
    column is of arrays (nested). Arrays must be of one length."""
    cs = [F.col(c) if isinstance(c, str) else c for c in columns]
    sizes = F.array_distinct(F.array(*[F.size(c) for c in cs]))
    first = F.when(F.size(sizes) > 1, F.raise_error(F.lit("arrays of several lengths")).cast("int")).otherwise(F.size(cs[0]))
    wide = nested or [False] * len(cs)
    row = lambda k: F.concat(*[F.get(c, k) if w else F.array(F.get(c, k)) for c, w in zip(cs, wide, strict=True)])
    # a sequence to -1 would run downwards
    return F.transform(F.slice(F.sequence(F.lit(0), F.greatest(first - 1, F.lit(0))), 1, first), row)
