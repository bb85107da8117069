"""Free places among numbered ones: gaps between occupied slots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators.ordering import running


def _rows(df: DataFrame, floor: str, number: str, name: str) -> DataFrame:
    return df.select(F.col(floor).alias("__f"), F.col(number).cast("long").alias(name))


def gaps(floors: DataFrame, occupied: DataFrame, floor: str, slot: str, slots: str) -> DataFrame:
    """floor, first, last: every run of free slots. ``floors`` has a row for each floor with its number of slots, numbered from 1.

    A run begins behind an occupied slot (or at 1) where no occupied one follows,
    and ends before one. Begins and ends are found by anti joins on (floor,
    slot), so a floor with very many slots is spread over all tasks; a run's end
    is the least end not before its begin, found by their ranks in the floor.
    Slots outside 1..n, null ones and repeats are no slots. A full floor has no run.
    """
    size = _rows(floors, floor, slots, "__n").where("__n > 0")
    taken = _rows(occupied, floor, slot, "__s").join(size, "__f").where(F.col("__s").between(1, F.col("__n"))).select("__f", "__s").distinct()
    ends = {}
    for name, edge, step in (("first", F.lit(1).cast("long"), 1), ("last", F.col("__n"), -1)):
        beside = taken.select("__f", (F.col("__s") + step).alias("__s")).union(size.select("__f", edge.alias("__s")))
        inside = beside.join(size, "__f").where(F.col("__s").between(1, F.col("__n"))).select("__f", "__s").distinct()
        free = inside.join(taken, ["__f", "__s"], "left_anti")
        ends[name] = running(free, "__s", {}, by=["__f"]).select("__f", "__row", F.col("__s").alias(name))
    # the k-th begin of a floor belongs to its k-th end
    return ends["first"].join(ends["last"], ["__f", "__row"]).select(F.col("__f").alias(floor), "first", "last")


def first_free(floors: DataFrame, occupied: DataFrame, floor: str, slot: str, slots: str) -> DataFrame:
    """floor, first_free (null on a full floor), free (how many) for every floor; only one aggregation by floor after an anti join."""
    size = _rows(floors, floor, slots, "__n")
    taken = _rows(occupied, floor, slot, "__s").join(size, "__f").where(F.col("__s").between(1, F.col("__n"))).select("__f", "__s").distinct()
    behind = taken.select("__f", (F.col("__s") + 1).alias("__s")).union(size.select("__f", F.lit(1).cast("long").alias("__s")))
    free = behind.join(taken, ["__f", "__s"], "left_anti").groupBy("__f").agg(F.min("__s").alias("__first"))
    used = taken.groupBy("__f").agg(F.count("*").alias("__used"))
    both = size.join(free, "__f", "left").join(used, "__f", "left")
    first = F.when(F.col("__first") <= F.col("__n"), F.col("__first"))
    return both.select(F.col("__f").alias(floor), first.alias("first_free"), (F.greatest("__n", F.lit(0).cast("long")) - F.coalesce("__used", F.lit(0))).alias("free"))
