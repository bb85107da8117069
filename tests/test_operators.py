"""Literal frames with nulls, ties and edges, which the tables lack."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from marlstone.functions import text as tx
from marlstone.functions.numeric import rounded
from marlstone.operators import aggregates as agg
from marlstone.operators import encoders, folds, graph, joins, metrics, ordering, tabular
from marlstone.operators import windows as win


def values(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_bias_corrected_moments(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (9.0,)], "x double")
    row = df.agg(agg.skewness("x").alias("s"), agg.kurtosis("x").alias("k"), F.percentile("x", 0.25).alias("q"), F.median("x").alias("m")).first()
    assert (round(row.s, 4), round(row.k, 4), row.q, row.m) == (1.3309, 1.5, 1.75, 3.0)
    few = df.limit(2).agg(agg.skewness("x").alias("s"), agg.kurtosis("x").alias("k")).first()
    assert few.s is None and few.k is None


def test_null_keys(spark):
    df = spark.createDataFrame([(None, 1), ("a", 2), ("a", 3)], "k string, v int")
    assert values(agg.aggregate(df, ["k"], {"v": ["sum", "count"]}), "k", "v_sum", "v_count") == [("a", 5, 2)]
    assert values(encoders.counts(df, "k", "n"), "k", "n") == [("a", 2), ("a", 2), (None, 1)]
    assert values(encoders.counts(df, "k", "n", nulls=False), "k", "n") == [("a", 2), ("a", 2), (None, None)]
    assert len(joins.null_safe(df, df.withColumnRenamed("v", "w"), ["k"]).collect()) == 5


def test_trailing_tie_rules(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("k", t, 2.0, 1), ("k", t, 4.0, 2), ("k", t + dt.timedelta(days=7), 9.0, 3)], "k string, t timestamp_ntz, v double, i int")
    peers = win.trailing_features(df, ["k"], "t", 7 * 86400, {"m": F.avg("v")})
    assert values(peers, "i", "m") == [(1, 3.0), (2, 3.0), (3, 9.0)]
    rows = win.trailing_positional(df, ["k"], "t", "i", 7 * 86400, "v", "m")
    assert values(rows, "i", "m") == [(1, 2.0), (2, 3.0), (3, 9.0)]


def test_overlapping_intervals(spark):
    spans = [(7, 10), (5, 11), (4, 8), (17, 19), (15, 18), (21, 23), (24, 24)]
    a = spark.createDataFrame(spans, "lo int, hi int")
    b = spark.createDataFrame(spans, "lo2 int, hi2 int")
    for width in (1.0, 3.0, 100.0):
        got = values(joins.overlapping(a, b, "lo", "hi", "lo2", "hi2", width), "lo", "hi", "lo2", "hi2")
        assert got == sorted(((*x, *y) for x in spans for y in spans if x[0] <= y[1] and y[0] <= x[1]), key=str)


def test_components_and_reach(spark):
    e = spark.createDataFrame([(0, 2), (1, 4), (1, 5), (2, 3), (2, 7), (4, 8), (5, 8)], "a int, b int")
    assert values(graph.components(e, "a", "b"), "node", "component") == [(0, 0), (1, 1), (2, 0), (3, 0), (4, 1), (5, 1), (7, 0), (8, 1)]
    start = spark.createDataFrame([(0,)], "n int")
    assert values(graph.reach(e, "a", "b", start, "n"), "node", "hops") == [(0, 0), (2, 1), (3, 2), (7, 2)]
    assert graph.components(e.limit(0), "a", "b").count() == 0


def test_global_order(spark):
    df = spark.range(1000).select((F.col("id") % 37).alias("x"), "id")
    t = ordering.running(df, "x", {"s": F.col("x")}, ["id"], range_rows=100)
    assert ordering.dealt(df, [F.asc("x")], df.count(), 100).select("__range").distinct().count() > 5
    rows = sorted(t.collect(), key=lambda r: (r.x, r.id))
    total = 0
    for k, r in enumerate(rows):
        total += r.x
        assert (r["__row"], r.s) == (k + 1, total)
    ranks = {r.x: r["rank"] for r in ordering.average_rank(spark.createDataFrame([(1,), (1,), (2,)], "x int"), "x").collect()}
    assert ranks == {1: 1.5, 2: 3.0}


def test_dictionary_of_texts(spark):
    texts = ["", "a", "ab", "abc", "field_a", "field_b", "field_é", "z", "Z"]
    df = spark.createDataFrame([(t,) for t in [*texts, None, "a"]], "t string")
    got = {r.t: r.i for r in encoders.dense_ids(df, "t", "i").collect()}
    assert got == {None: None} | {t: k for k, t in enumerate(sorted(texts, key=str.encode))}
    same = df.where("t like 'field%'")
    assert {r.t: r.i for r in encoders.dense_ids(same, "t", "i").collect()} == {"field_a": 0, "field_b": 1, "field_é": 2}


def test_metrics(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1), (0.8, 0)], "s double, y int")
    assert metrics.roc_auc(df, "s", "y").first().auc == pytest.approx((1 + 0 + 0 + 1 + 1 + 0.5) / 6)
    best = metrics.best_mcc(df, "s", "y").first()
    assert best.threshold in (0.35, 0.8)
    ratings = spark.createDataFrame([(0, 0), (1, 1), (2, 2)], "a int, p int")
    assert metrics.quadratic_kappa(ratings, "a", "p").first().kappa == 1.0


def test_fills_and_rules(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", 4.0), (3, "b", None), (4, None, 6.0)], "i int, g string, v double")
    assert values(tabular.fill_group_median(df, "v", ["g"]), "i", "v") == [(1, 4.0), (2, 4.0), (3, None), (4, 6.0)]
    rule = tabular.last_match([(F.col("i") > 1, F.lit("x")), (F.col("i") > 2, F.lit("y"))])
    assert values(df.select("i", rule.alias("r")), "i", "r") == [(1, None), (2, "x"), (3, "y"), (4, "y")]
    assert dict(tabular.narrow(df).dtypes)["i"] == "tinyint"


def test_bins_and_target(spark):
    df = spark.createDataFrame([(0,), (10,), (11,), (50,), (60,)], "x int")
    assert values(df.select("x", encoders.binned("x", [0, 10, 50], ["a", "b"]).alias("b")), "x", "b") == [(0, None), (10, "a"), (11, "b"), (50, "b"), (60, None)]
    t = spark.createDataFrame([("a", 1, 0), ("a", 0, 1), ("b", 1, 0)], "k string, y int, f int")
    assert values(encoders.out_of_fold_target(t, "k", "y", "f", "e"), "k", "y", "f", "e") == [("a", 0, 1, 1.0), ("a", 1, 0, 0.0), ("b", 1, 0, 0.0)]


def test_folds(spark):
    assert folds.sliding(0, 20, 5, 1, 4, 5) == [(0, 0, 5, 6, 10), (1, 5, 10, 11, 15), (2, 10, 15, 16, 20)]
    df = spark.range(100).withColumn("s", F.col("id") % 2)
    sizes = folds.stratified(df, "id", "s", 5).groupBy("s", "fold").count().collect()
    assert {r["count"] for r in sizes} == {10}


def test_text(spark):
    df = spark.createDataFrame([("RT @me see http://x.y/z #tag the 12 I'm Sooo good!!",), ("",), (None,)], "x string")
    rows = [r[0] for r in df.select(tx.clean("x", ("the",))).collect()]
    assert rows == ["see im sooo good", "", None]
    one = spark.createDataFrame([("not good no not bad",)], "x string")
    assert one.select(tx.negated("x")).first()[0] == ["not", "not_good", "no", "not_not", "not_bad"]
    assert one.select(tx.squeeze_letters(F.lit("sooooo"))).first()[0] == "soo"
    assert one.select(tx.char_ngrams(F.lit("ab"), 3)).first()[0] == [" ab", "ab "]


def test_rounding_is_stable(spark):
    assert spark.range(1).select(rounded(F.lit(2.00005), 4)).first()[0] == rounded_python(2.00005, 4)


def rounded_python(x, n):
    import math

    return math.floor(x * 10**n + 0.500001) / 10**n


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "k string, v double, t timestamp_ntz")
    assert encoders.dense_ids(empty, "k", "id").count() == 0
    assert agg.value_counts(empty, "k", normalize=True).count() == 0
    assert tabular.keep_top(empty, "k", 3, "x").count() == 0
    assert metrics.roc_auc(empty.select(F.col("v").alias("s"), F.lit(1).alias("y")), "s", "y").first().auc is None


def test_reach_has_no_limit(spark):
    from marlstone.operators import graph

    chain = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (None, 3)], "a long, b long")
    start = spark.createDataFrame([(0,)], "node long")
    assert {r.node: r.hops for r in graph.reach(chain, "a", "b", start, "node").collect()} == {k: k for k in range(61)}
    goals = spark.createDataFrame([(4,), (9,), (100,)], "node long")
    assert [tuple(r) for r in graph.nearest(chain, "a", "b", start, "node", goals).collect()] == [(4, 4)]
    assert graph.nearest(chain, "a", "b", start, "node", goals.where("node = 100")).count() == 0


def test_user_functions(spark):
    from marlstone.operators import userfuncs

    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None), (None, 5.0), ("a", None)], "k string, v double").repartition(3)
    spread = userfuncs.Aggregate(lambda x: [x.min(), x.max()], lambda a, b: [min(a[0], b[0]), max(a[1], b[1])], lambda s: s[1] - s[0])
    assert {tuple(r) for r in userfuncs.aggregate(df, ["k"], "v", spread, "s").collect()} == {("a", 2.0, 2), ("b", None, 0), (None, 0.0, 1)}
    assert userfuncs.aggregate(df.limit(0), ["k"], "v", spread, "s").count() == 0
    rows = userfuncs.table_function(df.where("v is not null"), ["k"], ["v"], lambda v: ((i, i * 2.0) for i in range(int(v))), "i long, d double")
    assert rows.count() == 9 and rows.columns == ["k", "i", "d"]


def test_percentiles(spark):
    import numpy as np

    from marlstone.operators import ordering

    values = [float(x) for x in np.random.default_rng(3).integers(0, 40, 501)] + [None]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    row = ordering.percentiles(df, "x", {"a": 0.01, "b": 0.5, "c": 0.99}).first()
    assert np.allclose(tuple(row), np.percentile(values[:-1], [1, 50, 99]))
    row = ordering.percentiles(df, "x", {"a": 0.0, "b": 0.5, "c": 1.0}, interpolate=False).first()
    assert tuple(row) == tuple(np.percentile(values[:-1], [0, 50, 100], method="inverted_cdf"))


def test_accents_of_every_script(spark):
    from marlstone.functions import text as tx

    df = spark.createDataFrame([("śčő ﬁ é",), (None,), ("",), ("“a” – b…",)], "x string")
    got = [tuple(r) for r in df.select(tx.strip_accents("x"), tx.plain_punctuation("x")).collect()]
    assert got == [("sco fi e", "śčő ﬁ é"), (None, None), ("", ""), ("“a” – b...", '"a" - b...')]
