"""Free slots and unions of unlike frames."""

import random

import pytest

from marlstone.operators import ordering, slots
from marlstone.sources import unions


def brute(floors, taken):
    out = {}
    for f, n in floors:
        used = {s for g, s in taken if g == f and s is not None and 1 <= s <= n}
        free = [s for s in range(1, n + 1) if s not in used]
        runs = []
        for s in free:
            if runs and runs[-1][1] == s - 1:
                runs[-1][1] = s
            else:
                runs.append([s, s])
        out[f] = (free[0] if free else None, len(free), [tuple(r) for r in runs])
    return out


@pytest.mark.parametrize("rows", [20_000, 10])
def test_free_slots(spark, monkeypatch, rows):
    monkeypatch.setattr(ordering, "RANGE_ROWS", rows)
    rng = random.Random(2)
    floors = [(f, rng.choice([0, 1, 5, 30])) for f in range(20)] + [(99, 3), (100, 200)]
    taken = [(f, rng.randint(-1, n + 2)) for f, n in floors for _ in range(n)] + [(99, s) for s in (1, 2, 3, 3)] + [(7, None), (500, 1)]
    a, b = spark.createDataFrame(floors, "floor int, n int"), spark.createDataFrame(taken, "floor int, slot int")
    want = brute(floors, taken)
    got = {r.floor: (r.first_free, r.free) for r in slots.first_free(a, b, "floor", "slot", "n").collect()}
    assert got == {f: w[:2] for f, w in want.items()}
    runs = {}
    for r in slots.gaps(a, b, "floor", "slot", "n").collect():
        runs.setdefault(r.floor, []).append((r["first"], r["last"]))
    assert {f: sorted(r) for f, r in runs.items()} == {f: w[2] for f, w in want.items() if w[2]}


def test_union_of_many_unlike_frames(spark, tmp_path):
    kinds = [("a int, b string", (1, "x")), ("b string, c double", ("y", 2.5)), ("c float, a bigint", (1.5, 2**40)), ("d date, a smallint", (None, 3))]
    frames = [spark.createDataFrame([row], schema) for schema, row in kinds]
    many = unions.union_all(frames * 75)
    assert [f"{n} {t}" for n, t in many.dtypes] == ["a bigint", "b string", "c double", "d date"]
    assert many.count() == 300
    assert {tuple(r) for r in many.distinct().collect()} == {(1, "x", None, None), (None, "y", 2.5, None), (2**40, None, 1.5, None), (3, None, None, None)}
    for k, f in enumerate(frames * 3):
        f.coalesce(1).write.parquet(str(tmp_path / f"t{k}"))
    paths = [str(tmp_path / f"t{k}") for k in range(12)]
    assert len(unions.schemas_of(spark, paths)) == 4
    back = unions.read_all(spark, paths)
    assert back.count() == 12 and dict(back.dtypes) == {"a": "bigint", "b": "string", "c": "double", "d": "date"}


def test_conflicts(spark):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([("one",)], "x string")
    with pytest.raises(ValueError, match="'x' is int in one input and string in another"):
        unions.union_all([a, b])
    assert sorted(r.x for r in unions.union_all([a, b], "text").collect()) == ["1", "one"]
    with pytest.raises(ValueError, match="bigint"):
        unions.union_all([spark.createDataFrame([(2**60,)], "x bigint"), spark.createDataFrame([(1.0,)], "x double")])
    s, t = spark.createDataFrame([((1,),)], "s struct<p:int>"), spark.createDataFrame([((2, "q"),)], "s struct<p:bigint,q:string>")
    assert dict(unions.union_all([t, s.selectExpr("named_struct('p', s.p, 'q', cast(null as string)) as s")]).dtypes) == {"s": "struct<p:bigint,q:string>"}
    with pytest.raises(ValueError):
        unions.union_all([])
