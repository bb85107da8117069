"""Windows per key, and trailing time windows. Every window has a partition key; global orders are in ``ordering``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

MICRO = 1_000_000


def micros(column: str) -> Column:
    """A timestamp without zone as microseconds."""
    return F.unix_micros(F.col(column).cast("timestamp"))


def trailing(keys: Sequence[str], time: str, seconds: float, ties: Sequence[str] = ()) -> WindowSpec:
    """The half-open frame (t - seconds, t] of a key. Rows of equal time see each other.

    ``time`` is a column of microseconds.
    """
    return Window.partitionBy(*keys).orderBy(time, *ties).rangeBetween(-int(seconds * MICRO) + 1, 0)


def trailing_features(df: DataFrame, keys: Sequence[str], time: str, seconds: float, made: dict[str, Column]) -> DataFrame:
    """Adds aggregates over the trailing frame of each row."""
    t = df.withColumn("__us", micros(time))
    w = trailing(keys, "__us", seconds)
    return t.withColumns({n: c.over(w) for n, c in made.items()}).drop("__us")


def trailing_positional(df: DataFrame, keys: Sequence[str], time: str, tie: str, seconds: float, value: str, name: str) -> DataFrame:
    """Mean over (t - seconds, t] in row order: among rows of equal time only those before and the row itself.

    The time frame includes all peers; the sum and count of the peers behind the row are taken off again.
    """
    t = df.withColumn("__us", micros(time))
    w = trailing(keys, "__us", seconds)
    behind = Window.partitionBy(*keys, "__us").orderBy(tie).rowsBetween(1, Window.unboundedFollowing)
    total = F.sum(value).over(w) - F.coalesce(F.sum(value).over(behind), F.lit(0.0))
    n = F.count(value).over(w) - F.count(value).over(behind)
    return t.withColumn(name, F.try_divide(total, n)).drop("__us")


def equal_value_count(df: DataFrame, keys: Sequence[str], time: str, seconds: float, value: str, name: str) -> DataFrame:
    """How many rows of the trailing frame carry this row's value: the value joins the partition key."""
    t = df.withColumn("__us", micros(time))
    w = trailing([*keys, value], "__us", seconds)
    return t.withColumn(name, F.when(F.col(value).isNotNull(), F.count("*").over(w))).drop("__us")


def at_least(value: Column, w: WindowSpec, column: str, least: int) -> Column:
    """A window aggregate, null below ``least`` values."""
    return F.when(F.count(column).over(w) >= least, value.over(w))


def sequences(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, size: int, step: int = 1, fill: object = None) -> DataFrame:
    """Sliding windows of ``size`` values, starting at every ``step``-th row; short ones are filled at the end."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ahead = F.collect_list(F.coalesce(F.col(value), F.lit(None))).over(w.rowsBetween(0, size - 1))
    numbered = df.select(*keys, (F.row_number().over(w) - 1).alias("start"), ahead.alias("items"))
    filled = F.concat("items", F.array_repeat(F.lit(fill).cast(df.schema[value].dataType), size - F.size("items")))
    return numbered.where(F.col("start") % step == 0).withColumn("items", filled)


def running_mode(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """The most frequent value so far (the smallest on ties).

    Each row counts how often its own value has occurred; the running maximum of
    (count, smaller value first) is the mode.
    """
    own = Window.partitionBy(*keys, value).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    t = df.withColumn("__n", F.count("*").over(own))
    best = F.max(F.struct(F.col("__n").alias("n"), (-F.col(value)).alias("v"))).over(all_)
    return t.withColumn(name, -best["v"]).drop("__n")
