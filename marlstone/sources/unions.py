"""Many frames or files of unlike schemas as one table."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Each type and what it widens to without loss, narrow ones first.
WIDER = ("tinyint", "smallint", "int", "bigint", "float", "double")
LOSSLESS = {("bigint", "float"), ("int", "float"), ("bigint", "double")}  # these lose digits and are reported


def wider(a: T.DataType, b: T.DataType, conflicts: str, name: str) -> T.DataType:
    """The type that holds both; where there is none, text (``conflicts="text"``) or a ValueError."""
    x, y = a.simpleString(), b.simpleString()
    if x == y or y == "void":
        return a
    if x == "void":
        return b
    if x in WIDER and y in WIDER:
        low, high = sorted((x, y), key=WIDER.index)
        if (low, high) not in LOSSLESS:
            return a if x == high else b
        if (low, high) == ("int", "float"):
            return T.DoubleType()
    if {x, y} in ({"date", "timestamp"}, {"date", "timestamp_ntz"}):
        return a if y == "date" else b
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(wider(a.elementType, b.elementType, conflicts, name))
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        return merged([a, b], conflicts, f"{name}.")
    if conflicts == "text":
        return T.StringType()
    raise ValueError(f"column {name!r} is {x} in one input and {y} in another")


def merged(schemas: Sequence[T.StructType], conflicts: str = "report", prefix: str = "") -> T.StructType:
    """All columns in the order of their first appearance, each of the type that holds all of its kinds."""
    out: dict[str, T.DataType] = {}
    for s in schemas:
        for f in s.fields:
            out[f.name] = wider(out[f.name], f.dataType, conflicts, prefix + f.name) if f.name in out else f.dataType
    return T.StructType([T.StructField(n, t) for n, t in out.items()])


def aligned(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The frame with these columns: reordered, widened, null where it has none."""
    have = set(df.columns)
    return df.select(*[(F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def union_all(frames: Sequence[DataFrame], conflicts: str = "report") -> DataFrame:
    """All rows of all frames, by name. The plan is a flat union, whatever their number."""
    if not frames:
        raise ValueError("no frame to unite")
    schema = merged([f.schema for f in frames], conflicts)
    parts = [aligned(f, schema) for f in frames]
    while len(parts) > 1:  # a tree, so that the plan is not as deep as there are frames
        parts = [parts[i].union(parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def schemas_of(spark: SparkSession, paths: Sequence[str]) -> list[tuple[str, list[str]]]:
    """(schema as JSON, files) for each distinct schema of Parquet files; footers are read in tasks."""
    found = spark.read.format("binaryFile").load(list(paths)).select("path").where("path like '%.parquet'")

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        import pyarrow.parquet as pq
        from pyarrow import fs

        for batch in batches:
            rows = []
            for path in batch["path"]:
                plain = re.sub(r"^file:/+", "/", path)
                system = fs.LocalFileSystem() if plain.startswith("/") else None
                if system is None:
                    system, plain = fs.FileSystem.from_uri(path)
                with system.open_input_file(plain) as f:
                    arrow = pq.read_schema(f)
                rows.append((path, (arrow.metadata or {}).get(b"org.apache.spark.sql.parquet.row.metadata", b"").decode(), "|".join(f"{c.name}:{c.type}" for c in arrow)))
            yield pd.DataFrame(rows, columns=["path", "spark", "arrow"])

    kinds = found.mapInPandas(look, "path string, spark string, arrow string").groupBy("spark", "arrow").agg(F.array_sort(F.collect_list("path")).alias("files"))
    out = []
    for r in sorted(kinds.collect(), key=lambda r: r["files"][0]):
        out.append((r["spark"] or spark.read.parquet(r["files"][0]).schema.json(), r["files"]))
    return out


def read_all(spark: SparkSession, paths: Sequence[str], conflicts: str = "report") -> DataFrame:
    """Parquet files of unlike schemas as one table: one scan for each distinct schema, not for each file."""
    kinds = schemas_of(spark, paths)
    return union_all([spark.read.schema(T.StructType.fromJson(json.loads(s))).parquet(*files) for s, files in kinds], conflicts)
