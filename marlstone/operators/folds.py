"""Samples, hold-outs and folds. A row's part follows from its id alone, so it is the same on any cluster."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.numeric import rounded
from marlstone.operators.joins import attach
from marlstone.operators.ordering import running


def hashed(key: str, salt: str = "") -> Column:
    """32 bits of the MD5 of an id, as a long."""
    text = F.col(key).cast("string") if not salt else F.concat(F.lit(salt), F.col(key).cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def fold_of(key: str, k: int, salt: str = "") -> Column:
    return F.pmod(hashed(key, salt), F.lit(k))


def sampled(df: DataFrame, key: str, share: float, salt: str = "") -> DataFrame:
    """A share of the rows, the same rows at every run."""
    return df.where(hashed(key, salt) < int(share * 2**32))


def down_sampled(df: DataFrame, key: str, is_positive: Column, share: float) -> DataFrame:
    """All positives, and a share of the others."""
    return df.where(is_positive | (hashed(key) < int(share * 2**32)))


def stratified(df: DataFrame, key: str, stratum: str, k: int, name: str = "fold") -> DataFrame:
    """Folds of equal size inside each stratum: round robin in the order of the hash."""
    placed = running(df.withColumn("__hash", hashed(key)), "__hash", {}, [key], by=[stratum])
    return placed.withColumn(name, F.pmod(F.col("__row") - 1, F.lit(k))).drop("__hash", "__row")


def tiles(df: DataFrame, key: str, stratum: str, k: int, name: str = "tile") -> DataFrame:
    """Each stratum cut into ``k`` parts (from 1) in the order of the hash; the first parts have one row more where it does not divide."""
    placed = running(df.withColumn("__hash", hashed(key)), "__hash", {}, [key], by=[stratum])
    sizes = df.groupBy(stratum).agg(F.count("*").alias("__size"))
    i, small, more = F.col("__row") - 1, F.expr(f"__size div {k}"), F.col("__size") % k
    wide = more * (small + 1)
    part = F.when(i < wide, F.floor(i / (small + 1))).otherwise(more + F.floor((i - wide) / F.greatest(small, F.lit(1))))
    return attach(placed, sizes, [stratum]).withColumn(name, (part + 1).cast("long")).drop("__hash", "__row", "__size")


def balanced_groups(df: DataFrame, group: str, target: str, k: int, name: str = "fold") -> DataFrame:
    """Folds that keep groups whole and have groups of all mean targets: round robin in the order of the mean, then the group."""
    means = df.groupBy(group).agg(rounded(F.avg(target), 6).alias("__mean"))
    placed = running(means, "__mean", {}, [group]).select(group, F.pmod(F.col("__row") - 1, F.lit(k)).cast("long").alias(name))
    return attach(df, placed, [group])


def sliding(first: int, last: int, train: int, gap: int, valid: int, step: int) -> list[tuple[int, int, int, int, int]]:
    """(fold, train from, train to, validate from, validate to), all inclusive, while the validation fits."""
    out, at = [], first
    while at + train + gap + valid <= last:
        out.append((len(out), at, at + train, at + train + gap, at + train + gap + valid))
        at += step
    return out


def in_folds(df: DataFrame, position: str, plan: Sequence[tuple[int, int, int, int, int]]) -> DataFrame:
    """Each row once for every fold that uses it, with its part. The plan is a short list and is broadcast."""
    table = df.sparkSession.createDataFrame(list(plan), "fold int, t0 long, t1 long, v0 long, v1 long")
    p = F.col(position)
    part = F.when(p.between(F.col("t0"), F.col("t1")), "train").when(p.between(F.col("v0"), F.col("v1")), "valid")
    return df.crossJoin(F.broadcast(table)).withColumn("part", part).where("part is not null").drop("t0", "t1", "v0", "v1")
