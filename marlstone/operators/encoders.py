"""Encoders of categories."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import pairwise

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators.joins import attach
from marlstone.operators.ordering import running


def _back(df: DataFrame, table: DataFrame, column: str, *values: str) -> DataFrame:
    """Joins a table of distinct values back to all rows; a null value matches null."""
    named = table.select(F.col(column).alias("__v"), *values)
    return df.join(named, F.col(column).eqNullSafe(F.col("__v")), "left").drop("__v")


def counts(df: DataFrame, column: str, name: str, nulls: bool = True) -> DataFrame:
    """Count encoding; without ``nulls`` a null stays null."""
    rows = df if nulls else df.where(F.col(column).isNotNull())
    return _back(df, rows.groupBy(column).agg(F.count("*").alias(name)), column, name)


def relative_frequency(df: DataFrame, column: str, name: str) -> DataFrame:
    """Count over the largest count."""
    table = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("__n"))
    top = table.agg(F.max("__n").alias("__top"))
    return _back(df, table.crossJoin(F.broadcast(top)).withColumn(name, F.col("__n") / F.col("__top")), column, name)


def frequency_rank(df: DataFrame, column: str, name: str) -> DataFrame:
    """Position by falling count (ties by value); all values seen once share the last label."""
    table = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("__n"))
    many = running(table.where("__n > 1").withColumn("__order", -F.col("__n")), "__order", {}, [column]).select(column, (F.col("__row") - 1).alias(name))
    size = table.agg(F.count_if(F.col("__n") > 1).alias("__last"))
    single = table.where("__n = 1").crossJoin(F.broadcast(size)).select(column, F.col("__last").alias(name))
    return _back(df, many.unionByName(single), column, name)


def first_appearance(df: DataFrame, column: str, order: Sequence[str], name: str) -> DataFrame:
    """Labels from 0 by first appearance in an order; null is -1."""
    table = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.min(F.struct(*order)).alias("__at")).select(column, *[F.col(f"__at.{o}").alias(f"__o{k}") for k, o in enumerate(order)])
    ids = running(table, "__o0", {}, [f"__o{k}" for k in range(1, len(order))] + [column]).select(column, (F.col("__row") - 1).alias(name))
    return _back(df, ids, column, name).withColumn(name, F.coalesce(name, F.lit(-1).cast("long")))


def dense_ids(df: DataFrame, column: str, name: str) -> DataFrame:
    """Sorted factorisation: position of the value among all distinct values, from 0.

    Values of any type are dealt into ranges and numbered range by range, so the
    dictionary is never sorted in one task.
    """
    table = df.where(F.col(column).isNotNull()).select(column).distinct()
    ids = running(table, column, {}).select(column, (F.col("__row") - 1).alias(name))
    return _back(df, ids, column, name)


def tuple_ids(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """Position of each tuple of values among all distinct tuples, from 0; a null is a value of its own, before all others."""
    table = df.select(*columns).distinct()
    ids = running(table, columns[0], {}, columns[1:]).select(*columns, (F.col("__row") - 1).alias(name))
    return attach(df, ids, columns)


def train_ids(df: DataFrame, column: str, is_train: Column, name: str) -> DataFrame:
    """Ids of the values of the training part; a value unseen there is -1."""
    known = dense_ids(df.where(is_train).select(column).distinct(), column, name)
    return _back(df, known, column, name).withColumn(name, F.coalesce(name, F.lit(-1).cast("long")))


def smoothed_target(df: DataFrame, column: str, target: str, name: str, least: float, smoothing: float, train: Column | None = None) -> DataFrame:
    """prior * (1 - s) + mean * s with s = 1 / (1 + exp(-(n - least) / smoothing)); unseen values get the prior."""
    rows = df if train is None else df.where(train)
    prior = rows.agg(F.avg(target).alias("__prior"))
    table = rows.groupBy(column).agg(F.avg(target).alias("__mean"), F.count("*").alias("__n"))
    weight = 1 / (1 + F.exp(-(F.col("__n") - least) / smoothing))
    out = _back(df, table, column, "__mean", "__n").crossJoin(F.broadcast(prior))
    return out.withColumn(name, F.coalesce(F.col("__prior") * (1 - weight) + F.col("__mean") * weight, "__prior")).drop("__mean", "__n", "__prior")


def out_of_fold_target(df: DataFrame, column: str, target: str, fold: str, name: str) -> DataFrame:
    """Mean target of the value over all other folds, from one aggregation by (value, fold); else the prior of the other folds."""
    cells = df.groupBy(column, fold).agg(F.sum(target).alias("__s"), F.count(target).alias("__n"))
    whole = cells.groupBy(column).agg(F.sum("__s").alias("__ts"), F.sum("__n").alias("__tn"))
    folds = cells.groupBy(fold).agg(F.sum("__s").alias("__fs"), F.sum("__n").alias("__fn"))
    total = cells.agg(F.sum("__s").alias("__as"), F.sum("__n").alias("__an"))
    table = cells.join(whole, column).join(F.broadcast(folds), fold).crossJoin(F.broadcast(total))  # as many rows as folds, and one row
    value = F.coalesce(F.try_divide(F.col("__ts") - F.col("__s"), F.col("__tn") - F.col("__n")), F.try_divide(F.col("__as") - F.col("__fs"), F.col("__an") - F.col("__fn")))
    named = table.select(F.col(column).alias("__v"), F.col(fold).alias("__f"), value.alias(name))
    return df.join(named, F.col(column).eqNullSafe(F.col("__v")) & (F.col(fold) == F.col("__f")), "left").drop("__v", "__f")


def selected_flag(df: DataFrame, column: str, target: str, name: str, least_share: float, z: float) -> DataFrame:
    """The value itself where it has ``least_share`` of all rows and a mean target farther from the whole than z * 0.5 / sqrt(n), else null."""
    table = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.avg(target).alias("__own"), F.count("*").alias("__k"))
    whole = df.agg(F.avg(target).alias("__m"), F.count("*").alias("__all"))
    chosen = table.crossJoin(F.broadcast(whole)).where((F.col("__k") / F.col("__all") >= least_share) & (F.abs(F.col("__own") - F.col("__m")) > z * 0.5 / F.sqrt("__k")))  # one row
    return _back(df, chosen.select(column, F.col(column).alias(name)), column, name)


def frequency_cutoff(df: DataFrame, column: str, name: str, share: float) -> DataFrame:
    """Labels of values in falling frequency: a new one begins after each value with more than ``share`` of all rows."""
    table = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("__n"))
    whole = df.agg(F.count("*").alias("__all"))
    marked = table.crossJoin(F.broadcast(whole)).withColumn("__big", (F.col("__n") > share * F.col("__all")).cast("long"))  # one row
    placed = running(marked, "__n", {"__labels": F.col("__big")}, [column], descending=True)
    return _back(df, placed.select(column, (F.col("__labels") - F.col("__big")).alias(name)), column, name)


def nested_impact(df: DataFrame, column: str, target: str, outer: str, inner: str, n_outer: int, n_inner: int, name: str) -> tuple[DataFrame, DataFrame, float]:
    """Impact coding by nested folds: coded rows, key map, default.

    For an outer fold, each inner fold gives the mean of the value's rows outside
    of both; the code is the mean of these over the inner folds, the default (the
    whole mean) standing in where no row is left. A value's cells (pairs of folds)
    are one array, from which all its codes follow without another exchange. The
    key map is the mean over the outer folds.
    """
    default = df.agg(F.avg(target)).first()[0]
    cells = df.where(F.col(column).isNotNull()).groupBy(column, outer, inner).agg(F.coalesce(F.sum(target).cast("double"), F.lit(0.0)).alias("s"), F.count(target).alias("n"))
    # one row for a value: at most as many cells as there are pairs of folds
    own = cells.groupBy(column).agg(F.array_sort(F.collect_list(F.struct(F.col(outer).cast("long").alias("f"), F.col(inner).cast("long").alias("g"), "s", "n"))).alias("c"))

    def total(c: Column) -> Column:
        return F.aggregate(c, F.struct(F.lit(0.0).alias("s"), F.lit(0).cast("long").alias("n")), lambda a, v: F.struct((a["s"] + v["s"]).alias("s"), (a["n"] + v["n"]).alias("n")))

    def mean(f: Column, g: Column) -> Column:
        # null folds are outside of every fold
        left = total(F.filter("c", lambda v: ~F.coalesce(v["f"] == f, F.lit(False)) & ~F.coalesce(v["g"] == g, F.lit(False))))
        return F.transform(F.array(left), lambda t: F.when(t["n"] > 0, t["s"] / t["n"]).otherwise(F.lit(default)))[0]

    folds = lambda n: F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))
    add = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    codes = own.select(F.col(column).alias("__v"), F.transform(folds(n_outer), lambda f: add(F.transform(folds(n_inner), lambda g: mean(f, g))) / n_inner).alias("__codes"))
    rows = df.join(codes, F.col(column) == F.col("__v"), "left").withColumn(name, F.coalesce(F.get("__codes", F.col(outer).cast("int")), F.lit(default))).drop("__v", "__codes")
    return rows, codes.select(F.col("__v").alias(column), (add(F.col("__codes")) / n_outer).alias(name)), default


def one_hot(column: str, values: Sequence[object], drop_first: bool = False) -> list[Column]:
    """0/1 columns of the given values; null is 0 everywhere."""
    used = list(values)[1:] if drop_first else list(values)
    return [F.coalesce((F.col(column) == v).cast("int"), F.lit(0)).alias(f"{column}_{v}") for v in used]


def interaction(columns: Sequence[str], separator: str = "_") -> Column:
    """Joined texts with null as ``nan``, so the key is never null."""
    return F.concat_ws(separator, *[F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in columns])


def binned(column: str, edges: Sequence[float], labels: Sequence[object]) -> Column:
    """Right-closed bins (a, b]; outside of all is null."""
    out = F.when(F.lit(False), F.lit(labels[0]))
    for (low, high), label in zip(pairwise(edges), labels, strict=True):
        out = out.when((F.col(column) > low) & (F.col(column) <= high), F.lit(label))
    return out


def version_order(column: str, parts: int = 4) -> Column:
    """Sort key of a dotted version, compared number by number."""
    pieces = F.split(F.col(column), r"\.")
    return F.struct(*[F.coalesce(F.get(pieces, k).try_cast("int"), F.lit(0)).alias(f"v{k}") for k in range(parts)])
