"""Structured Streaming forms: totals per key, trailing aggregates, a circuit breaker, a bounded recency cache."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def running_totals(stream: DataFrame, key: str, value: str, default: str) -> DataFrame:
    """Sum and count of every key; a missing or empty key is ``default``. Write with output mode complete or update."""
    name = F.coalesce(F.nullif(F.col(key), F.lit("")), F.lit(default))
    return stream.groupBy(name.alias(key)).agg(F.sum(value).alias("total"), F.count("*").alias("n"))


def trailing_aggregates(stream: DataFrame, key: str, time: str, value: str, length: str, slide: str, late: str) -> DataFrame:
    """Sliding windows per key. State of windows older than the watermark is dropped."""
    w = F.window(time, length, slide)
    out = stream.withWatermark(time, late).groupBy(w, key).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "mean", "std", "n")


def circuit_breaker(stream: DataFrame, key: str, time: str, failed: str, most: int, delay: float) -> DataFrame:
    """State of a breaker per key after each batch: closed, open after ``most`` failures in a row, half open ``delay`` seconds later.

    A success in the half-open state closes it, a failure opens it again.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, failures, since = state.get if state.exists else ("closed", 0, 0.0)
        for rows in (pd.concat(list(batches)).sort_values("t"),):
            for t, bad in zip(rows["t"], rows["bad"], strict=True):
                if now == "open" and t >= since + delay:
                    now = "half_open"
                if now == "open":
                    continue
                failures = failures + 1 if bad else 0
                if bad and (now == "half_open" or failures >= most):
                    now, since = "open", float(t)
                elif not bad:
                    now = "closed"
        state.update((now, int(failures), float(since)))
        yield pd.DataFrame({"key": [str(k[0])], "state": [now], "failures": [int(failures)]})

    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(time).cast("double").alias("t"), F.col(failed).cast("boolean").alias("bad"))
    return rows.groupBy("key").applyInPandasWithState(step, "key string, state string, failures long", "now string, failures long, since double", "update", GroupStateTimeout.NoTimeout)


def recency_cache(stream: DataFrame, group: str, item: str, order: str, size: int) -> DataFrame:
    """The ``size`` items of each group used last, least recent first; the state never holds more."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values("o")
        for x in rows["i"]:
            if x in held:
                held.remove(x)
            held.append(x)
            del held[:-size]
        state.update((held,))
        yield pd.DataFrame({"key": [str(k[0])], "items": [",".join(held)]})

    rows = stream.select(F.col(group).cast("string").alias("key"), F.col(item).cast("string").alias("i"), F.col(order).alias("o"))
    return rows.groupBy("key").applyInPandasWithState(step, "key string, items string", "items array<string>", "update", GroupStateTimeout.NoTimeout)
