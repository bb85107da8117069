"""Joins that need more than an equality of columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join in which a null key matches a null key."""
    other = right.withColumnsRenamed({k: f"__k_{k}" for k in keys})
    on = [left[k].eqNullSafe(other[f"__k_{k}"]) for k in keys]
    return left.join(other, on, how).drop(*[f"__k_{k}" for k in keys])


def attach(df: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join with a table that has one row for each key, nulls matching nulls.

    The null-safe condition makes both sides shuffle for the join, even where
    the table comes from an aggregation by the same keys. That small shuffle lets
    adaptive execution split the detail rows of a hot key (or broadcast the table).
    """
    other = table.withColumnsRenamed({k: f"__k_{k}" for k in keys})
    on = [df[k].eqNullSafe(other[f"__k_{k}"]) for k in keys]
    return df.join(other, on, "left").drop(*[f"__k_{k}" for k in keys])


#: Cells in the usual length of an interval: with more of them, an interval is copied more often and meets fewer strangers.
CELLS = 4


def _starting_inside(a: DataFrame, b: DataFrame, lo: str, hi: str, start: str, strictly: bool = False) -> DataFrame:
    """Rows of ``a`` (with ``__cells``) with those of ``b`` (with ``__cell``) that start inside; a start has one cell, so each pair is found once."""
    after = F.col(start) > F.col(lo) if strictly else F.col(start) >= F.col(lo)
    return a.withColumn("__cell", F.explode("__cells")).drop("__cells").join(b, "__cell").where(after & (F.col(start) <= F.col(hi))).drop("__cell")


def _cells(lo: str, hi: str, width: float) -> tuple[Column, Column]:
    cell = lambda x: F.floor(F.col(x) / (width / CELLS))
    return cell(lo), F.sequence(cell(lo), cell(hi))


def overlapping(left: DataFrame, right: DataFrame, lo: str, hi: str, other_lo: str, other_hi: str, width: float) -> DataFrame:
    """All pairs of closed intervals that overlap, through equi joins on cells of a part of ``width``.

    Of two intervals that overlap, the later one starts inside the other. The
    one is put into every cell it touches, starts are in one cell only: a pair
    is found once, where the later interval starts, and needs no distinct.
    Choose ``width`` near the usual interval length.
    """
    cell, cells = _cells(lo, hi, width)
    other_cell, other_cells = _cells(other_lo, other_hi, width)
    a, b = left.where(F.col(lo) <= F.col(hi)), right.where(F.col(other_lo) <= F.col(other_hi))
    later = _starting_inside(a.withColumn("__cells", cells), b.withColumn("__cell", other_cell), lo, hi, other_lo)
    earlier = _starting_inside(b.withColumn("__cells", other_cells), a.withColumn("__cell", cell), other_lo, other_hi, lo, strictly=True)
    return later.unionByName(earlier)


def overlapping_pairs(df: DataFrame, key: str, lo: str, hi: str, width: float) -> DataFrame:
    """Each pair of rows whose closed intervals overlap once, as ``x`` and ``y``, the smaller and the larger key.

    The pairs of ``overlapping`` of a table with itself, in one join: only the
    earlier of two intervals looks for the other, of two that start together the
    one with the smaller key.
    """
    cell, cells = _cells(lo, hi, width)
    d = df.select(key, lo, hi).where((F.col(lo) <= F.col(hi)) & F.col(key).isNotNull())
    a = d.select(F.col(key).alias("__a"), F.col(lo).alias("__lo"), F.col(hi).alias("__hi"), cells.alias("__cells"))
    b = d.select(F.col(key).alias("__b"), F.col(lo).alias("__start"), cell.alias("__cell"))
    pairs = _starting_inside(a, b, "__lo", "__hi", "__start").where("__start > __lo or __a < __b")
    return pairs.where("__a != __b").select(F.least("__a", "__b").alias("x"), F.greatest("__a", "__b").alias("y"))


def lookup(left: DataFrame, table: DataFrame, key: str, value: str, default: object = None) -> DataFrame:
    """The value of a key, or a default where the key is unknown."""
    named = table.select(F.col(key).alias("__k"), F.col(value).alias("__v"))
    found = left.join(named, F.col(key) == F.col("__k"), "left")
    return found.withColumn(value, F.coalesce("__v", F.lit(default))).drop("__k", "__v")


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """For every left row the latest right value at or before its time.

    Both sides are put into one ordered stream per key, and the last value is
    carried on: one shuffle, no range join.
    """
    from pyspark.sql.window import Window

    a = left.withColumns({"__side": F.lit(1), "__v": F.lit(None).cast(right.schema[value].dataType)})
    b = right.select(key, time, F.lit(0).alias("__side"), F.col(value).alias("__v"))
    w = Window.partitionBy(key).orderBy(time, "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn(value, F.last("__v", ignorenulls=True).over(w))
    return both.where("__side = 1").drop("__side", "__v")
