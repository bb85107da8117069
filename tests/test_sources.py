import json
import zipfile

from pyspark.sql import functions as F

from marlstone.sources import readers, writers


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1.5), (2, None, None)], "i int, s string, x double")
    for how in ("none", "gzip"):
        writers.csv(df, str(tmp_path / how), how)
        back = readers.csv(spark, str(tmp_path / how), "i int, s string, x double")
        assert sorted(map(tuple, back.collect())) == [(1, "a", 1.5), (2, None, None)]
    assert readers.csv(spark, str(tmp_path / "none"), "i int, s string, x double", ["i"]).columns == ["i"]
    assert dict(readers.text_table(spark, str(tmp_path / "none")).dtypes)["i"] == "string"


def test_zipped_csv(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.csv.zip", "w") as z:
        z.writestr("a.csv", "i,s\n1,x\n2,\n")
    got = readers.zipped_csv(spark, str(tmp_path / "*.zip"), "i int, s string").collect()
    assert sorted(map(tuple, got)) == [(1, "x"), (2, None)]


def test_json_documents_and_files(spark, tmp_path):
    for name in ("p-1", "p-2", "q"):
        (tmp_path / f"{name}.json").write_text(json.dumps({"score": len(name)}, indent=1))
    rows = readers.json_documents(spark, str(tmp_path), "score int").collect()
    assert sorted((r.id, r.ordinal or 0, r.score) for r in rows) == [("p", 1, 3), ("p", 2, 3), ("q", 0, 1)]
    assert sorted((r.key, r.size > 0) for r in readers.files(spark, str(tmp_path)).collect()) == [("p", True), ("p", True), ("q", True)]


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, "a:b", None), (2, 0, None, 2.5)], "i int, y int, c string, n double")
    lines = {r.i: r.v for r in df.select("i", writers.vw_lines("y", ["n"], ["c"]).alias("v")).collect()}
    assert lines == {1: "1 1.0 |num  |cat c_ab", 2: "-1 1.0 |num n:2.5 |cat "}
    ffm = {r.i: r.value for r in writers.libffm_lines(df, "i", "y", ["c"]).collect()}
    assert ffm == {1: "1 0:1:1", 2: "0 0:2:1"}
    writers.text(df.select(F.lit("x").alias("v")), "v", str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t")).count() == 2
    assert [r.value for r in writers.feature_map(df).orderBy("position").collect()][0] == "0\ti\tq"


def test_inferred_csv_and_numbered_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("i,x,d,s\n1,1.5,2024-01-02,a\n2,,2024-01-03,\n")
    df = readers.csv_inferred(spark, str(tmp_path / "a.csv"))
    assert [t for _, t in df.dtypes] == ["int", "double", "date", "string"] and df.where("x is null").count() == 1
    assert readers.csv_inferred(spark, str(tmp_path / "a.csv"), ["s", "i"]).columns == ["s", "i"]
    docs = spark.createDataFrame([("a", 1), ("a", 2), ("a", 4), ("b", 2), ("c", None), ("c", 1)], "id string, ordinal int")
    assert sorted(tuple(r) for r in readers.until_gap(docs).collect()) == [("a", 1), ("a", 2), ("c", 1)]
