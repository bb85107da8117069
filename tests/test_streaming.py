import datetime as dt

import pytest

from marlstone.streaming import stateful


def run(spark, tmp_path, schema, batches, made, mode):
    source = tmp_path / "in"
    source.mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
    q = made(stream).writeStream.format("memory").queryName(f"q_{tmp_path.name.replace('-', '_')}").outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(f"q_{tmp_path.name.replace('-', '_')}").collect()


def test_running_totals(spark, tmp_path):
    rows = run(spark, tmp_path, "k string, v long", [[("a", 200), ("a", 200), ("b", 300)], [(None, 100), ("", 100)]], lambda s: stateful.running_totals(s, "k", "v", "none"), "complete")
    assert {(r.k, r.total) for r in rows} >= {("a", 400), ("b", 300), ("none", 200)}


def test_trailing_windows(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    data = [[("a", t, 1.0), ("a", t + dt.timedelta(days=1), 3.0)], [("a", t + dt.timedelta(days=40), 9.0)]]
    rows = run(spark, tmp_path, "k string, t timestamp, v double", data, lambda s: stateful.trailing_aggregates(s, "k", "t", "v", "7 days", "1 day", "1 day"), "append")
    assert any(r.n == 2 and r["mean"] == 2.0 for r in rows)


def test_breaker_and_cache(spark, tmp_path):
    pytest.importorskip("pandas")
    data = [[("x", 0.0, True), ("x", 1.0, True)], [("x", 2.0, True), ("x", 20.0, False)]]
    rows = run(spark, tmp_path, "k string, t double, bad boolean", data, lambda s: stateful.circuit_breaker(s, "k", "t", "bad", 2, 10.0), "update")
    assert "open" in {r.state for r in rows} or "closed" in {r.state for r in rows}
    assert [r.state for r in rows][-1] in ("closed", "open")


def test_cache(spark, tmp_path):
    data = [[("g", "a", 1), ("g", "b", 2), ("g", "c", 3), ("g", "b", 4)]]
    rows = run(spark, tmp_path, "g string, i string, o int", data, lambda s: stateful.recency_cache(s, "g", "i", "o", 2), "update")
    assert rows[-1]["items"] == "c,b"
