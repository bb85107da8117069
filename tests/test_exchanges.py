"""What operators send through a shuffle."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from marlstone import plans
from marlstone.operators import encoders, joins, userfuncs, vocabulary


def test_rows_of_a_group_meet_before_they_are_reduced(spark):
    """40 parts with one row of each group: no state is made for a single row."""
    longest = userfuncs.Aggregate(partial=lambda x: [len(x)], merge=lambda a, b: [min(a[0], b[0])], finish=lambda s: s[0])
    d = spark.range(40, numPartitions=40).crossJoin(spark.createDataFrame([("a",), ("b",), (None,)], "k string")).select("k", F.col("id").cast("double").alias("v"))
    d = d.union(spark.createDataFrame([("c", None)], "k string, v double"))
    got = {r.k: (r.least, r.n) for r in userfuncs.aggregate(d, ["k"], "v", longest, "least").collect()}
    assert got["c"] == (None, 0)
    assert all(got[k][1] == 40 and got[k][0] >= 2 for k in ("a", "b", None))


def test_nested_impact_by_one_row_for_each_value(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice(["a", "b", "c", None]), rng.choice([1.0, 2.5, 7.0, None]), rng.randrange(4), rng.randrange(3)) for i in range(60)] + [(60, "once", 5.0, 1, 1)]
    d = spark.createDataFrame(rows, "i int, k string, y double, f long, g long")
    coded, table, default = encoders.nested_impact(d, "k", "y", "f", "g", 4, 3, "code")
    assert "NestedLoop" not in coded._jdf.queryExecution().executedPlan().toString()
    known = [r[2] for r in rows if r[2] is not None]
    assert default == pytest.approx(sum(known) / len(known))

    def code(k, f):
        out = []
        for g in range(3):
            ys = [y for _, kk, y, ff, gg in rows if kk == k and ff != f and gg != g and y is not None]
            out.append(sum(ys) / len(ys) if ys else default)
        return sum(out) / 3

    got = {r.i: r.code for r in coded.collect()}
    assert got == pytest.approx({i: default if k is None else code(k, f) for i, k, _, f, _ in rows})
    by_key = defaultdict(float, {r.k: r.code for r in table.collect()})
    assert by_key == pytest.approx({k: sum(code(k, f) for f in range(4)) / 4 for k in ("a", "b", "c", "once")})


def test_only_the_last_words_are_joined(spark):
    d = spark.createDataFrame([(1, "a b a c a"), (2, "b"), (3, ""), (4, None)], "k int, t string")
    out = vocabulary.sequences(d, "k", F.split("t", " "), 3)
    assert {r.k: r.padded for r in out.collect()} == {1: [1, 3, 1], 2: [0, 0, 2]}
    assert "slice(array_remove(" in out._jdf.queryExecution().optimizedPlan().toString()


def test_a_replaced_word_has_one_row_for_a_chunk(spark):
    texts = ["a  b\ta gone", "", None, " c "] + ["b gone a"] * 300
    d = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    e = spark.createDataFrame([("a", "x y"), ("gone", None), ("b", "2"), ("b", "1"), ("unseen", "u")], "old string, new string")
    out = vocabulary.replace_words(d, "k", "t", e)
    assert {r.k: r.t for r in out.collect()} == {0: "x y 1 x y", 1: "", 2: None, 3: "c"} | {i: "1 x y" for i in range(4, 304)}
    assert "posexplode" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_replacements_meet_their_chunk_without_a_list_of_a_row(spark, monkeypatch):
    from marlstone.operators import grams

    monkeypatch.setattr(grams, "CHUNK_WORDS", 50)
    d = spark.createDataFrame([(i, f"a b w{i}") for i in range(400)], "k long, t string").coalesce(1)
    entries = spark.createDataFrame([("a", "x"), ("b", None)], "old string, new string")
    out = vocabulary.replace_words(d, "k", "t", entries)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "Sort [((chunk" in plan
    assert {r.k: r.t for r in out.collect()} == {i: f"x w{i}" for i in range(400)}


def test_only_the_earlier_interval_is_copied_to_cells(spark):
    rng = random.Random(15)
    spans = [(a, a + rng.choice([0, 1, 5, 40, 400])) for a in (rng.randrange(-200, 2_000_000_000 if k % 9 == 0 else 300) for k in range(200))]
    spans += [(7, 10), (7, 10), (7, 7), (10, 10), (11, 10), (None, 3), (3, None)]
    d = spark.createDataFrame([(k, *s) for k, s in enumerate(spans)], "k int, lo int, hi int")
    kept = [(k, a, b) for k, (a, b) in enumerate(spans) if a is not None and b is not None and a <= b]
    want = sorted((x[0], y[0]) for x in kept for y in kept if x[0] < y[0] and x[1] <= y[2] and y[1] <= x[2])
    for width in (1.0, 30.0, 1000.0):
        out = joins.overlapping_pairs(d, "k", "lo", "hi", width)
        assert sorted((r.x, r.y) for r in out.collect()) == want
        assert out._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 1
    query = plans.queries()["j15_interval_overlap"](spark, "/root/testdata/sf0.001")
    assert query._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 1
