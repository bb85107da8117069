"""Functions that a user hands in: aggregates, group functions and table functions, on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Tasks that reduce the rows of one group.
SALTS = 8


@dataclass(frozen=True)
class Aggregate:
    """An aggregate by its three steps: the state (a list of numbers) of a series, two states merged, the value of a state."""

    partial: Callable[[pd.Series], list[float]]
    merge: Callable[[list[float], list[float]], list[float]]
    finish: Callable[[list[float]], float]


def aggregate(df: DataFrame, keys: Sequence[str], value: str, how: Aggregate, name: str) -> DataFrame:
    """``keys``, ``name`` and n (values that are not null) of every group.

    Rows of a group are dealt to at most ``SALTS`` tasks, each batch is reduced to
    one state a group, and states are merged one by one, so a group is never held whole. Groups without any value
    have a null; null keys are a group.
    """
    keys = list(keys)
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            some = batch[value].notna()
            rows = [(*k, [float(x) for x in how.partial(v)], len(v)) for k, v in batch[some].groupby(keys, dropna=False, sort=False)[value]]
            rows += [(*k, None, 0) for k in batch.loc[~some, keys].drop_duplicates().itertuples(index=False, name=None)]
            yield pd.DataFrame(rows, columns=[*keys, "state", "n"])

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, n, out = None, None, 0, []
        for batch in batches:
            for *key, more, k in batch.itertuples(index=False, name=None):
                key = tuple(None if pd.isna(x) else x for x in key)
                if key != now:
                    if now is not None:
                        out.append((*now, None if state is None else float(how.finish(state)), n))
                    now, state, n = key, None, 0
                n += k
                if more is not None:
                    state = list(more) if state is None else how.merge(state, list(more))
            yield pd.DataFrame(out, columns=[*keys, name, "n"])
            out = []
        if now is not None:
            yield pd.DataFrame([(*now, None if state is None else float(how.finish(state)), n)], columns=[*keys, name, "n"])

    # rows of a group meet in a few tasks first, in order: a state for some rows of a group costs as much as one for many
    met = df.select(*keys, value, (F.spark_partition_id() % SALTS).alias("__salt")).repartition(*keys, "__salt").sortWithinPartitions(*keys).drop("__salt")
    states = met.mapInPandas(reduce, f"{kinds}, state array<double>, n long")
    return states.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(finish, f"{kinds}, `{name}` double, n long")


def group_apply(df: DataFrame, keys: Sequence[str], work: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A frame for every group. A group is held by one task: for groups of a bounded size."""
    return df.groupBy(*keys).applyInPandas(work, schema)


def table_function(df: DataFrame, keep: Sequence[str], arguments: Sequence[str], rows: Callable[..., Iterator[tuple]], schema: str) -> DataFrame:
    """``keep`` columns with each row that ``rows(*arguments)`` gives (columns of ``schema``)."""
    names = [x.split()[0] for x in schema.split(",")]

    @F.pandas_udf(f"array<struct<{', '.join(':'.join(x.split()) for x in schema.split(','))}>>")
    def made(*columns: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(names, r, strict=True)) for r in rows(*values)] for values in zip(*columns, strict=True)])

    return df.select(*keep, F.inline(made(*arguments)))
