"""Chunked scans that stop and go on, members of archives, image headers, missing files."""

import json
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from marlstone.sources import archives, chunks, images, readers

SCHEMA = "i long, s string"


def test_chunks_stop_and_go_on(spark, tmp_path):
    path, out, progress = (str(tmp_path / x) for x in ("in", "out", "progress"))
    spark.range(1000).select(F.col("id").alias("i"), F.lit("x").alias("s")).repartition(7).write.parquet(path)
    begun = []

    def work(chunk, number, stop_at=None):
        begun.append(number)
        if number == stop_at:
            chunk.limit(3).write.mode("overwrite").parquet(f"{out}/chunk={number}")  # half-done work of a crash
            raise RuntimeError("crash")
        return chunk.groupBy().agg(F.count("*").alias("n"), F.sum("i").alias("total"))

    with pytest.raises(Exception, match="crash"):
        chunks.process_in_chunks(spark, path, SCHEMA, lambda c, k: work(c, k, 3), out, progress, files=1)
    assert begun == [0, 1, 2, 3]
    got = chunks.process_in_chunks(spark, path, SCHEMA, work, out, progress, files=1)
    assert begun == [0, 1, 2, 3, 3, 4, 5, 6]  # only the chunk that had not ended is repeated
    assert got.select("chunk").distinct().count() == 7
    whole = got.agg(F.sum("n"), F.sum("total")).first()
    assert tuple(whole) == (1000, 499_500)
    # nothing is left to do; what arrives later is further chunks
    assert chunks.process_in_chunks(spark, path, SCHEMA, work, out, progress, files=1).count() == 7
    spark.range(5).select(F.col("id").alias("i"), F.lit("y").alias("s")).coalesce(1).write.mode("append").parquet(path)
    assert chunks.process_in_chunks(spark, path, SCHEMA, work, out, progress, files=1).agg(F.sum("n")).first()[0] == 1005
    assert begun[8:] == [7]


def test_chunks_by_size_and_of_nothing(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.range(100).select(F.col("id").alias("i"), F.lit("x").alias("s")).repartition(6).write.csv(path)
    got = chunks.process_in_chunks(spark, path, SCHEMA, lambda c, _: c, str(tmp_path / "o"), str(tmp_path / "p"), size=1, form="csv")
    assert got.count() == 100 and got.select("chunk").distinct().count() == 6
    (tmp_path / "none").mkdir()
    none = chunks.process_in_chunks(spark, str(tmp_path / "none"), SCHEMA, lambda c, _: c.select("i"), str(tmp_path / "o2"), str(tmp_path / "p2"))
    assert none.count() == 0 and none.columns == ["i"]


def test_members_of_archives(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    want = []
    for a, where in enumerate((tmp_path / "a.zip", tmp_path / "deep" / "b.zip")):
        with zipfile.ZipFile(where, "w", zipfile.ZIP_DEFLATED) as z:
            for m in range(3):
                n = 40_000 if m == 2 else 3  # the last is larger than a block
                rows = [(a * 10**6 + m * 10**5 + k, f"v{k}" if k % 5 else None, k / 2) for k in range(n)]
                want += rows
                lines = "\n".join(f"{s or ''},{i},{x}" for i, s, x in rows)
                z.writestr(f"m{m}.csv", f"s,i,x\n{lines}\n")
            z.writestr("notes.txt", "no table")
            z.writestr("empty.csv", "")
    archives.register(spark)
    df = spark.read.format("archive_csv").schema("i long, s string, x double, absent date").option("block", 1 << 16).load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 8
    assert sorted((r.i, r.s, r.x) for r in df.collect()) == sorted(want)
    assert df.where("absent is not null").count() == 0
    one = spark.read.format("archive_csv").schema("i int").option("members", "m0*").load(f"file://{tmp_path}/a.zip")
    assert sorted(r.i for r in one.collect()) == [0, 1, 2]
    none = spark.read.format("archive_csv").schema("i int").option("archives", "*.nothing").load(str(tmp_path))
    assert none.count() == 0


def png(w, h):
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0" * (w + 1) * h)) + chunk(b"IEND", b"")


IMAGES = {
    "a-1.png": (png(7, 300), ("png", 7, 300)),
    "b.bmp": (b"BM" + struct.pack("<IHHIIiiHHIIiiII", 60, 0, 0, 54, 40, 5, -6, 1, 24, 0, 0, 0, 0, 0, 0) + b"\0" * 96, ("bmp", 5, 6)),
    "c.bmp": (b"BM" + struct.pack("<IHHIIHHHH", 60, 0, 0, 26, 12, 9, 4, 1, 24), ("bmp", 9, 4)),
    "d.ppm": (b"P6\n# a comment 1 2\n12 34\n255\n" + b"\0" * 99, ("netpbm", 12, 34)),
    "e.pgm": (b"P5 #" + b"x" * 5000 + b"\n 3\t4 # more\n255\n", ("netpbm", 3, 4)),
    "f.pam": (b"P7\nWIDTH 227\n# HEIGHT 9\nHEIGHT 149\nDEPTH 3\nENDHDR\n", ("netpbm", 227, 149)),
    "g.gif": (b"GIF89a" + struct.pack("<HH", 10, 20) + b"\0" * 20, ("gif", 10, 20)),
    "h.jpg": (b"\xff\xd8\xff\xe0" + struct.pack(">H", 300) + b"\0" * 298 + b"\xff\xff\xc2" + struct.pack(">HBHHB", 11, 8, 480, 640, 3) + b"\0" * 9, ("jpeg", 640, 480)),
    "i.txt": (b"no image", (None, None, None)),
    "k.bmp": (b"BM12", (None, None, None)),
    "l.pgm": (b"P5\n12", (None, None, None)),
}


def test_image_sizes(spark, tmp_path):
    for name, (data, _) in IMAGES.items():
        (tmp_path / name).write_bytes(data)
    rows = images.image_sizes(spark, str(tmp_path)).collect()
    assert {r.name: (r.kind, r.width, r.height) for r in rows} == {n: w for n, (_, w) in IMAGES.items()}
    assert {r.name: r["size"] for r in rows} == {n: len(d) for n, (d, _) in IMAGES.items()}
    assert {r.key for r in rows} >= {"a", "b"}


def test_missing_files_keep_their_keys(spark, tmp_path):
    for name in ("p-1", "p-2", "q"):
        (tmp_path / f"{name}.json").write_text(json.dumps({"score": len(name)}))
    keys = spark.createDataFrame([("p",), ("q",), ("gone",)], "id string")
    rows = readers.documents_of(keys, readers.json_documents(spark, str(tmp_path), "score int")).collect()
    assert sorted((r.id, r.score, r.found) for r in rows if r.found) == [("p", 3, True), ("p", 3, True), ("q", 1, True)]
    assert [(r.id, r.score) for r in rows if not r.found] == [("gone", None)]


def test_dictionary_lines(spark, tmp_path):
    (tmp_path / "d.txt").write_text("brb, be right back, soon\nlol,laugh\nno separator\n,x\n")
    assert sorted(map(tuple, readers.dictionary_lines(spark, str(tmp_path / "d.txt")).collect())) == [("", "x"), ("brb", "be right back, soon"), ("lol", "laugh")]
