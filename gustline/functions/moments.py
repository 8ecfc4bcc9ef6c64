"""Mergeable moments: count, sum and squared deviations of a column.

A state is a struct (n, total, m2): the non-NULL values, their sum and the sum
of their squared deviations from the mean. States of disjoint row sets merge
with the pairwise formula, which only ever subtracts means, so means and
standard deviations can be kept from partials without the cancellation of a
plain sum of squares.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATE = "struct<n:bigint,total:double,m2:double>"


def _column(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def moments(col) -> Column:
    """Aggregate: the state of a column; n is 0 where all its values are NULL."""
    c = _column(col).cast("double")
    n = F.count(c)
    zero = F.lit(0.0)
    return F.struct(n.alias("n"), F.coalesce(F.sum(c), zero).alias("total"),
                    F.coalesce(F.var_pop(c) * n, zero).alias("m2"))


def merged(a: Column, b: Column) -> Column:
    """One state of two."""
    n = a["n"] + b["n"]
    apart = b["total"] / b["n"] - a["total"] / a["n"]
    between = F.when((a["n"] > 0) & (b["n"] > 0), apart * apart * a["n"] * b["n"] / n).otherwise(F.lit(0.0))
    return F.struct(n.alias("n"), (a["total"] + b["total"]).alias("total"), (a["m2"] + b["m2"] + between).alias("m2"))


def merge_moments(state) -> Column:
    """Aggregate: one state of a group's states. The group's states are held
    together, so merge tables with one row per key each: a group then has as
    many states as there are tables."""
    empty = F.lit(0).cast("bigint"), F.lit(0.0), F.lit(0.0)
    zero = F.struct(*[c.alias(n) for c, n in zip(empty, ("n", "total", "m2"))])
    return F.aggregate(F.collect_list(_column(state)), zero, merged)


def mean(state) -> Column:
    s = _column(state)
    return F.when(s["n"] > 0, s["total"] / s["n"])


def stddev_samp(state) -> Column:
    """Sample deviation; NULL for fewer than two values."""
    s = _column(state)
    return F.when(s["n"] > 1, F.sqrt(s["m2"] / (s["n"] - 1)))


def union_all(parts) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
