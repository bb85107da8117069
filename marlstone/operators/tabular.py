"""Projections, fills, rules and caps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.operators.joins import attach
from marlstone.operators.ordering import group_percentiles, percentiles


def prefixed(df: DataFrame, prefix: str, keep: Sequence[str] = ()) -> DataFrame:
    """All columns renamed by a prefix, but for ``keep``."""
    return df.select(*[F.col(f"`{c}`").alias(c if c in keep else prefix + c) for c in df.columns])


def with_scalars(df: DataFrame, **scalars: Column) -> DataFrame:
    """Adds the same global aggregates to every row.

    One row is broadcast; unlike an empty window this gathers nothing in one task.
    """
    one = df.agg(*[c.alias(n) for n, c in scalars.items()])
    return df.crossJoin(F.broadcast(one))


def first_match(rules: Sequence[tuple[Column, object]], default: object = None) -> Column:
    """The value of the first rule whose condition holds."""
    out = F.when(rules[0][0], rules[0][1])
    for condition, value in rules[1:]:
        out = out.when(condition, value)
    return out.otherwise(default)


def last_match(rules: Sequence[tuple[Column, object]], default: object = None) -> Column:
    """Rules applied one after another, each overwriting the ones before."""
    return first_match(list(reversed(rules)), default)


def null_count(columns: Sequence[str]) -> Column:
    total = F.lit(0)
    for c in columns:
        total = total + F.col(c).isNull().cast("int")
    return total


def fill_group_median(df: DataFrame, value: str, group: Sequence[str]) -> DataFrame:
    """Nulls replaced by the median of their group (joined back, so a large group is never held by one task)."""
    medians = group_percentiles(df, group, value, {"__median": 0.5})
    return attach(df, medians, group).withColumn(value, F.coalesce(value, "__median")).drop("__median")


def fill_from_dependency(df: DataFrame, keys: Sequence[str], target: str, least: int = 2) -> DataFrame:
    """Null targets filled where the keys determine one single target seen at least ``least`` times."""
    known = df.where(F.col(target).isNotNull()).groupBy(*keys).agg(F.min(target).alias("__low"), F.max(target).alias("__high"), F.count("*").alias("__n"))
    known = known.where((F.col("__low") == F.col("__high")) & (F.col("__n") >= least)).select(*keys, "__low")
    return attach(df, known, keys).withColumn(target, F.coalesce(target, "__low")).drop("__low")


def forward_fill(column: str, group: Sequence[str], order: Sequence[str], backward: bool = False) -> Column:
    """The last value that is not null so far (or the next, going backward)."""
    w = Window.partitionBy(*group).orderBy(*order)
    if backward:
        return F.first(column, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return F.last(column, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def row_forward_fill(columns: Sequence[str]) -> list[Column]:
    """Each column, else the nearest one before it."""
    return [F.coalesce(*[F.col(c) for c in reversed(columns[: k + 1])]).alias(c) for k, c in enumerate(columns)]


def mask_rare(df: DataFrame, column: str, least: int) -> DataFrame:
    """Values seen fewer than ``least`` times become null; counts are joined back."""
    common = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("__n")).where(F.col("__n") >= least)
    return attach(df, common, [column]).withColumn(column, F.when(F.col("__n").isNotNull(), F.col(column))).drop("__n")


def keep_top(df: DataFrame, column: str, k: int, other: object) -> DataFrame:
    """Values beyond the ``k`` most frequent (ties by value) become ``other``; ``k`` rows are broadcast."""
    top = df.where(F.col(column).isNotNull()).groupBy(column).count().orderBy(F.desc("count"), column).limit(k).select(F.col(column).alias("__v"))
    return df.join(F.broadcast(top), F.col(column) == F.col("__v"), "left").withColumn(column, F.coalesce("__v", F.lit(other))).drop("__v")


def within_percentiles(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """Rows between two percentiles (linear interpolation), bounds included."""
    edges = percentiles(df, column, {"__low": low, "__high": high})
    return df.crossJoin(F.broadcast(edges)).where(F.col(column).between(F.col("__low"), F.col("__high"))).drop("__low", "__high")


def winsorise(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """Values moved to the nearer of two percentiles where they lie outside."""
    edges = percentiles(df, column, {"__low": low, "__high": high})
    capped = F.when(F.col(column).isNotNull(), F.least(F.greatest(F.col(column), F.col("__low")), F.col("__high")))
    return df.crossJoin(F.broadcast(edges)).withColumn(column, capped).drop("__low", "__high")


def smallest_type(low: float | None, high: float | None) -> str:
    """The narrowest integer type for a range."""
    for name, bits in (("tinyint", 8), ("smallint", 16), ("int", 32)):
        if low is not None and -(2 ** (bits - 1)) <= low and high < 2 ** (bits - 1):
            return name
    return "bigint"


def narrow(df: DataFrame) -> DataFrame:
    """Integer columns cast to the narrowest type that holds their range; one aggregation, one row to the driver."""
    whole = [c for c, t in df.dtypes if t in ("smallint", "int", "bigint")]
    if not whole:
        return df
    found = df.agg(*[f(c).alias(f"{n}_{c}") for c in whole for n, f in (("lo", F.min), ("hi", F.max))]).first()
    return df.select(*[F.col(c).cast(smallest_type(found[f"lo_{c}"], found[f"hi_{c}"])).alias(c) if c in whole else F.col(c) for c in df.columns])


def unpivot(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "variable", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)
