"""Grouped statistics. All are declarative aggregations, partial before the shuffle where Spark can."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.numeric import rounded
from marlstone.operators.joins import attach


def skewness(column: str | Column) -> Column:
    """Bias-corrected skewness G1; null below three values, 0 for constant values."""
    n = F.count(column).cast("double")
    plain = F.skewness(column)
    return F.when(n >= 3, F.when(F.stddev_pop(column) == 0, 0.0).otherwise(plain * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))))


def kurtosis(column: str | Column) -> Column:
    """Bias-corrected excess kurtosis G2; null below four values, 0 for constant values."""
    n = F.count(column).cast("double")
    corrected = (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * F.kurtosis(column) + 6)
    return F.when(n >= 4, F.when(F.stddev_pop(column) == 0, 0.0).otherwise(corrected))


STATISTICS = {
    "count": lambda c: F.count(c),
    "nunique": lambda c: F.count_distinct(F.col(c)),
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)),
    "mean": F.avg,
    "std": F.stddev_samp,
    "var": F.var_samp,
    "min": F.min,
    "max": F.max,
    "median": F.median,
    "q25": lambda c: F.percentile(c, 0.25),
    "q75": lambda c: F.percentile(c, 0.75),
    "skew": skewness,
    "kurt": kurtosis,
}


def aggregate(df: DataFrame, keys: Sequence[str], spec: dict[str, Sequence[str]], digits: int | None = None, prefix: str = "") -> DataFrame:
    """Several statistics of several columns; rows with a null key are dropped, names are flattened to column_statistic."""
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    made = []
    for column, wanted in spec.items():
        for name in wanted:
            value = STATISTICS[name](column)
            made.append((value if digits is None or name in ("count", "nunique") else rounded(value, digits)).alias(f"{prefix}{column}_{name}"))
    return df.groupBy(*keys).agg(*made)


def describe(df: DataFrame, keys: Sequence[str], column: str, digits: int = 6) -> DataFrame:
    return aggregate(df, keys, {column: ["count", "mean", "std", "min", "q25", "median", "q75", "max"]}, digits)


def value_counts(df: DataFrame, column: str, normalize: bool = False, dropna: bool = True) -> DataFrame:
    """Frequency of every value; shares are of the counted rows."""
    rows = df.where(F.col(column).isNotNull()) if dropna else df
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    if not normalize:
        return counts
    total = counts.agg(F.sum("n").alias("__total"))
    return counts.crossJoin(F.broadcast(total)).select(column, (F.col("n") / F.col("__total")).alias("share"))


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in an order, by a partial aggregation instead of a sort."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.min_by(F.struct(*rest), F.struct(*order)).alias("__row")
    return df.groupBy(*keys).agg(pick).select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest])


def join_back(df: DataFrame, keys: Sequence[str], *aggregates: Column, null_safe: bool = False) -> DataFrame:
    """Group statistics on every detail row; without ``null_safe`` rows with a null key get nulls."""
    rows = df
    for k in () if null_safe else keys:
        rows = rows.where(F.col(k).isNotNull())
    return attach(df, rows.groupBy(*keys).agg(*aggregates), keys)


def profile(df: DataFrame) -> DataFrame:
    """For every column: distinct values, share of nulls, share of the largest value.

    One Expand by the (few) columns, then two aggregations; no job per column.
    """
    texts = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
    long = texts.unpivot([], df.columns, "column", "value")
    counts = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    out = counts.groupBy("column").agg(
        F.count("value").alias("distinct"),
        (F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)) / F.sum("n")).alias("null_share"),
        (F.max(F.when(F.col("value").isNotNull(), F.col("n"))) / F.sum("n")).alias("top_share"),
    )
    return out


def null_signature(df: DataFrame) -> DataFrame:
    """Columns grouped by their number of nulls."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return one.unpivot([], df.columns, "column", "nulls").groupBy("nulls").agg(F.array_join(F.array_sort(F.collect_list("column")), ",").alias("columns"))


def row_mean(columns: Sequence[str]) -> Column:
    """Mean over the columns that are not null; null if all are."""
    some = F.filter(F.array(*[F.col(c).cast("double") for c in columns]), lambda x: x.isNotNull())
    return F.try_divide(F.aggregate(some, F.lit(0.0), lambda a, x: a + x), F.size(some))


def row_std(columns: Sequence[str]) -> Column:
    some = F.filter(F.array(*[F.col(c).cast("double") for c in columns]), lambda x: x.isNotNull())
    mean = row_mean(columns)
    return F.sqrt(F.try_divide(F.aggregate(some, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)), F.size(some) - 1))


def correlation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlations of all pairs in one aggregation, as rows (x, y, r)."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*[F.corr(a, b).alias(f"c{k}") for k, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"c{k}").alias("r")) for k, (a, b) in enumerate(pairs)])
    return one.select(F.inline(rows))
