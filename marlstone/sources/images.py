"""Widths and heights of image files from their first bytes; contents are not read."""

from __future__ import annotations

import re
import struct
import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.sources.archives import opened

cloudpickle.register_pickle_by_value(sys.modules[__name__])

HEAD = 64
#: Comments of a Netpbm header may be long: it is read up to here.
LONGEST = 1 << 16
Range = Callable[[int, int], bytes]  # offset, bytes


def netpbm(read: Range) -> tuple[int, int] | None:
    size = HEAD
    while True:
        head = read(0, size)
        plain = re.sub(rb"#[^\r\n]*(?:[\r\n]|$)", b" ", head)
        if head[1:2] == b"7":
            found = [re.search(rb"\n[ \t]*" + k + rb"[ \t]+(\d+)[ \t]*[\r\n]", plain) for k in (b"WIDTH", b"HEIGHT")]
            if all(found):
                return int(found[0][1]), int(found[1][1])
        elif m := re.match(rb"P[1-6]\s+(\d+)\s+(\d+)\s", plain):
            return int(m[1]), int(m[2])
        if len(head) < size or size >= LONGEST:
            return None
        size *= 4


def jpeg(read: Range) -> tuple[int, int] | None:
    at = 2
    while len(head := read(at, 10)) >= 9 and head[0] == 0xFF:
        kind = head[1]
        if kind == 0xFF:  # a fill byte
            at += 1
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", head[5:9])
            return width, height
        elif kind == 0x01 or 0xD0 <= kind <= 0xD8:
            at += 2
        else:
            at += 2 + struct.unpack(">H", head[2:4])[0]
    return None


def dimensions(read: Range) -> tuple[str, int, int] | None:
    """Kind, width, height; None for what is no image of a known kind or ends too early."""
    head = read(0, HEAD)
    found, kind = None, ""
    try:
        if head.startswith(b"\x89PNG\r\n\x1a\n") and head[12:16] == b"IHDR":
            kind, found = "png", struct.unpack(">II", head[16:24])
        elif head[:6] in (b"GIF87a", b"GIF89a"):
            kind, found = "gif", struct.unpack("<HH", head[6:10])
        elif head[:2] == b"BM":
            core = struct.unpack("<I", head[14:18])[0] == 12
            kind, found = "bmp", struct.unpack("<HH", head[18:22]) if core else struct.unpack("<ii", head[18:26])
            found = found[0], abs(found[1])  # a negative height is stored from the top
        elif re.match(rb"P[1-7][\s#]", head):
            kind, found = "netpbm", netpbm(read)
        elif head[:2] == b"\xff\xd8":
            kind, found = "jpeg", jpeg(read)
    except struct.error:
        return None
    return (kind, *found) if found else None


def image_sizes(spark: SparkSession, path: str) -> DataFrame:
    """name, size, key (the name before its first dash or dot), kind, width, height of every file; the last three are null where it is no image.

    Files are listed by Spark, which leaves out empty ones; each task reads 64 bytes of its files (a few more
    of long headers) by ranges.
    """
    listed = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for where, size in zip(batch["path"], batch["size"], strict=True):
                system, plain = opened(where)
                with system.open_input_file(plain) as f:
                    found = dimensions(lambda at, n, f=f, size=size: f.read_at(max(0, min(n, size - at)), min(at, size)))
                rows.append((where, size, *(found or (None, None, None))))
            yield pd.DataFrame(rows, columns=["path", "size", "kind", "width", "height"]).astype({"width": "Int32", "height": "Int32"})

    seen = listed.mapInPandas(look, "path string, size long, kind string, width int, height int")
    name = F.element_at(F.split("path", "/"), -1)
    return seen.select(name.alias("name"), "size", F.regexp_extract(name, r"^([^.\-]+)", 1).alias("key"), "kind", "width", "height")
