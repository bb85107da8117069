"""Global order without one task: rows are dealt into ranges of the whole order, ranges get offsets.

Ranges come from Spark's range partitioner, which samples splitters of all order
columns together: numbers, texts, dates and tuples alike. A row number is the
last order column, so that even rows that are equal in everything are dealt out
evenly. The dealt rows are written to the shared folder, because range numbers
hold only for one dealing; ``sources.shared.clear`` deletes what a session wrote.
A table of at most ``RANGE_ROWS`` rows (they are counted first) is one range, and
nothing is written. These functions run jobs while the plan is built.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.operators.joins import attach
from marlstone.sources.shared import forget, stored

RANGES = 4096
RANGE_ROWS = 200_000


def _order(order: str, ties: Sequence[str], descending: bool) -> list[Column]:
    return [F.desc_nulls_last(order) if descending else F.asc_nulls_first(order), *[F.asc_nulls_first(t) for t in ties]]


def dealt(df: DataFrame, keys: Sequence[Column], rows: int, range_rows: int | None = None) -> DataFrame:
    """A written table with ``__range``, rising with the order of ``keys``, and ``__tie``, the order of rows that are equal there.

    The rows are written before they are numbered: a file is read in one order, so
    a task that is repeated after a lost executor numbers and deals its rows as before.
    """
    n = min(RANGES, -(-rows // (range_rows or RANGE_ROWS)))
    first = stored(df, "rows")
    whole = first.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(n, *keys, F.asc("__tie"))
    out = stored(whole.withColumn("__range", F.spark_partition_id()), "order")
    forget(first)
    return out


def running(df: DataFrame, order: str, sums: dict[str, Column], ties: Sequence[str] = (), descending: bool = False, range_rows: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Adds running totals (and __row, from 1) over the global order of ``order``, then ``ties``; with ``by`` over each group's own order.

    A group may be larger than a range, and a range may hold many groups: only
    the first group of a range can have begun in an earlier one, so there are at
    most ``RANGES`` offsets, which are broadcast. Ties beyond ``ties`` go in any order.
    """
    names = [*sums, "__row"]
    valued = df.withColumns({f"__v_{n}": c for n, c in sums.items()} | {"__v___row": F.lit(1).cast("long")})
    rows = df.count()
    first = _order(order, ties, descending)
    if rows <= (range_rows or RANGE_ROWS):
        own = Window.partitionBy(*by or [F.lit(0)]).orderBy(*first).rowsBetween(Window.unboundedPreceding, 0)
        return valued.withColumns({n: F.sum(f"__v_{n}").over(own) for n in names}).drop(*[f"__v_{n}" for n in names])
    cut = dealt(valued, [*[F.asc_nulls_first(b) for b in by], *first], rows, range_rows)
    totals = cut.groupBy("__range", *by).agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in names])
    before = Window.partitionBy(*by or [F.lit(0)]).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col("__range").alias("__r"), *[F.col(b).alias(f"__b_{b}") for b in by], *[F.sum(f"__t_{n}").over(before).alias(f"__s_{n}") for n in names]).where("__s___row is not null")
    same = cut["__range"] == F.col("__r")
    for b in by:
        same &= cut[b].eqNullSafe(F.col(f"__b_{b}"))
    own = Window.partitionBy("__range", *by).orderBy(*first, "__tie").rowsBetween(Window.unboundedPreceding, 0)
    joined = cut.join(F.broadcast(starts), same, "left")  # at most RANGES rows
    so_far = lambda n: F.coalesce(F.sum(f"__v_{n}").over(own) + F.col(f"__s_{n}"), F.sum(f"__v_{n}").over(own), F.col(f"__s_{n}"))
    out = joined.withColumns({n: so_far(n) for n in names})
    return out.drop("__range", "__tie", "__r", *[f"__b_{b}" for b in by], *[f"__{k}_{n}" for n in names for k in "vs"])


def group_percentiles(df: DataFrame, by: Sequence[str], column: str, shares: dict[str, float], interpolate: bool = True) -> DataFrame:
    """Exact percentiles of a column by name, one row for each group; nulls are left out.

    Values are counted by group (a written table), counts accumulated over ranges,
    and the neighbours of each place picked by a filter, so no task holds all
    values of a group. Between two neighbours the value is interpolated, or else
    it is the least value that covers the share.
    """
    counts = stored(df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("__n")), "counted")
    placed = running(counts, column, {"__up": F.col("__n")}, by=by)
    whole = counts.groupBy(*by).agg(F.sum("__n").alias("__all"))
    both = attach(placed, whole, by) if by else placed.crossJoin(F.broadcast(whole))  # one row
    x, up, below = F.col(column), F.col("__up"), F.col("__up") - F.col("__n")
    out = []
    for name, share in shares.items():
        at = (F.col("__all") - 1) * F.lit(float(share)) if interpolate else F.greatest(F.ceil(F.col("__all") * F.lit(float(share))), F.lit(1)).cast("double") - 1
        low, high = F.floor(at), F.ceil(at)
        left, right = F.max(F.when((below <= low) & (low < up), x)), F.max(F.when((below <= high) & (high < up), x))
        out.append((left + (right - left) * F.max(at - low) if interpolate else left).alias(name))
    return both.groupBy(*by).agg(*out)


def percentiles(df: DataFrame, column: str, shares: dict[str, float], interpolate: bool = True) -> DataFrame:
    """One row with exact percentiles of a column by name."""
    return group_percentiles(df, [], column, shares, interpolate)


def average_rank(df: DataFrame, column: str, name: str = "rank") -> DataFrame:
    """Rank from 1 with ties averaged: values are counted, counts are accumulated, ranks are joined back."""
    counts = stored(df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("__n")), "counted")
    placed = running(counts, column, {"__up": F.col("__n")})
    ranks = placed.select(F.col(column).alias("__v"), (F.col("__up") - (F.col("__n") - 1) / 2).alias(name), F.col("__up").alias(f"{name}_max"))
    return df.join(ranks, F.col(column) == F.col("__v"), "left").drop("__v")


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows of an order (each task keeps ``k``)."""
    return df.orderBy(*order).limit(k)
