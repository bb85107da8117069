"""Order over ranges: hot values, outliers, tuples, groups larger than a range, nulls."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import encoders, folds, ordering, tabular
from marlstone.sources import shared


def sizes(df, *keys, range_rows):
    cut = ordering.dealt(df, keys, df.count(), range_rows)
    return [r["count"] for r in cut.groupBy("__range").count().collect()]


def test_no_range_is_large(spark):
    n, rows = 20_000, 500
    same = spark.range(n).select(F.lit(7).alias("x"), "id")
    assert max(sizes(same, F.asc("x"), range_rows=rows)) <= 4 * rows  # one value for all rows
    # addresses with a long common beginning, and one outlier
    texts = spark.range(n).select(F.concat(F.lit("https://host.example/path/"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("x")).union(spark.createDataFrame([("z",), ("",)], "x string"))
    assert max(sizes(texts, F.asc("x"), range_rows=rows)) <= 4 * rows
    third = spark.range(n).select(F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id")).alias("x"), "id")
    assert max(sizes(third, F.asc_nulls_first("x"), F.asc("id"), range_rows=rows)) <= 4 * rows


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("by", [[], ["g"], ["g", "h"]])
def test_running(spark, descending, by):
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 1, 1, 1, 2, 3]), rng.choice(["a", "a", "b", None]), rng.choice([None, "x", "yy", "x"]), i, rng.choice([None, 1, 5])) for i in range(3000)]
    df = spark.createDataFrame(rows, "g int, h string, x string, id long, v long")
    got = ordering.running(df, "x", {"s": F.col("v")}, ["id"], descending, range_rows=100, by=by).collect()
    want, state = {}, {}
    ordered = sorted(rows, key=lambda r: r[3])
    ordered = sorted(ordered, key=lambda r: (r[2] is not None, r[2] or ""), reverse=descending)
    if descending:  # equal texts keep the order of their ids
        ordered = sorted(ordered, key=lambda r: r[3])
        ordered = sorted(ordered, key=lambda r: r[2] or "", reverse=True)
        ordered = sorted(ordered, key=lambda r: r[2] is None)
        ordered = [r for t in ("yy", "x", None) for r in sorted(rows, key=lambda r: r[3]) if r[2] == t]
    for g, h, x, i, v in ordered:
        key = {0: (), 1: (g,), 2: (g, h)}[len(by)]
        k, s = state.get(key, (0, None))
        state[key] = k, s = k + 1, s if v is None else (s or 0) + v
        want[i] = k, s
    assert {r.id: (r["__row"], r.s) for r in got} == want
    assert got[0].asDict().keys() == {"g", "h", "x", "id", "v", "s", "__row"}


def test_running_of_equal_rows_and_of_nothing(spark):
    df = spark.range(1000).select(F.lit("same").alias("x"))
    got = ordering.running(df, "x", {}, range_rows=50)
    assert sorted(r["__row"] for r in got.collect()) == list(range(1, 1001))
    assert ordering.running(df.limit(0), "x", {}).count() == 0


def test_percentiles_of_one_group_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(ordering, "RANGE_ROWS", 100)
    rng = np.random.default_rng(3)
    rows = [("hot", float(round(x, 2))) for x in rng.normal(size=4000)] + [("a", 1.0), ("a", 4.0), ("b", 2.0), (None, 3.0), ("c", None), ("hot", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    shares = {"p10": 0.1, "p50": 0.5, "p99": 0.99}
    got = {r.g: r for r in ordering.group_percentiles(df, ["g"], "x", shares).collect()}
    assert got.keys() == {"hot", "a", "b", None}  # a group without values has no row
    for g in got:
        values = [x for k, x in rows if k == g and x is not None]
        for name, share in shares.items():
            assert abs(got[g][name] - np.quantile(values, share)) < 1e-9
    whole = [x for _, x in rows if x is not None]
    least = ordering.percentiles(df, "x", shares, interpolate=False).first()
    assert all(least[n] == np.quantile(whole, s, method="inverted_cdf") for n, s in shares.items())
    filled = tabular.fill_group_median(df, "x", ["g"]).where("g = 'hot' and x is null").count()
    assert filled == 0


def test_ids_and_folds_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(ordering, "RANGE_ROWS", 60)
    rows = [(a, b) for a in [None, "a", "b"] for b in [None, "x", "y"]] * 3
    got = {(r.a, r.b): r.id for r in encoders.tuple_ids(spark.createDataFrame(rows, "a string, b string"), ["a", "b"], "id").collect()}
    key = lambda t: tuple((x is not None, x or "") for x in t)
    assert [k for k, _ in sorted(got.items(), key=lambda t: t[1])] == sorted(set(rows), key=key)  # (a, null) and (null, a) differ
    df = spark.range(1003).select("id", F.when(F.col("id") < 900, "big").otherwise("small").alias("s"))
    count = {(r.s, r.fold): r["count"] for r in folds.stratified(df, "id", "s", 5).groupBy("s", "fold").count().collect()}
    assert all(180 == count["big", k] for k in range(5)) and sorted(count["small", k] for k in range(5)) == [20, 20, 21, 21, 21]
    tiles = {(r.s, r.tile): r["count"] for r in folds.tiles(df, "id", "s", 10).groupBy("s", "tile").count().collect()}
    assert all(tiles["big", k] == 90 for k in range(1, 11)) and [tiles["small", k] for k in range(1, 11)] == [11] * 3 + [10] * 7


def test_stored_tables_can_be_cleared(spark):
    t = shared.stored(spark.range(3), "kept")
    path = t._marlstone_path
    shared.clear()
    exists = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not exists.getFileSystem(spark._jsc.hadoopConfiguration()).exists(exists)
