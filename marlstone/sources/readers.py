"""Readers with declared schemas."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def csv(spark: SparkSession, path: str, schema: str | T.StructType, columns: list[str] | None = None, timestamps: str | None = None) -> DataFrame:
    """CSV with a header and declared types; only ``columns`` are parsed."""
    reader = spark.read.option("header", True).schema(schema).option("enforceSchema", True)
    if timestamps:
        reader = reader.option("timestampFormat", timestamps).option("timestampNTZFormat", timestamps)
    df = reader.csv(path)
    return df.select(*columns) if columns else df


def csv_inferred(spark: SparkSession, path: str, columns: list[str] | None = None, share: float = 1.0, missing: str = "") -> DataFrame:
    """CSV with a header and types found from the data (one more pass, over ``share`` of the lines)."""
    reader = spark.read.option("header", True).option("inferSchema", True).option("samplingRatio", share).option("nullValue", missing)
    df = reader.csv(path)
    return df.select(*columns) if columns else df


def text_table(spark: SparkSession, path: str) -> DataFrame:
    """CSV as text columns, nothing inferred."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def zipped_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV files inside zip archives. A zip file cannot be split, so each archive is read by one task, in pieces."""
    fields = T._parse_datatype_string(schema)
    names = [f.name for f in fields]

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for member in archive.namelist():
                        with archive.open(member) as f:
                            for piece in pd.read_csv(f, dtype=str, keep_default_na=False, chunksize=50_000):
                                yield piece[names]

    raw = spark.read.format("binaryFile").load(path).select("content")
    texts = raw.mapInPandas(unpack, ", ".join(f"`{n}` string" for n in names))
    return texts.select(*[F.nullif(F.col(f.name), F.lit("")).try_cast(f.dataType).alias(f.name) for f in fields])


def json_documents(spark: SparkSession, path: str, schema: str, key: str = "id") -> DataFrame:
    """One JSON document a file; the key is the file name without its ending, its part behind the last dash is ``ordinal``."""
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    name = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.json$", "")
    return df.select(F.regexp_replace(name, r"-(\d+)$", "").alias(key), F.nullif(F.regexp_extract(name, r"-(\d+)$", 1), F.lit("")).cast("int").alias("ordinal"), *df.columns)


def documents_of(keys: DataFrame, documents: DataFrame, key: str = "id") -> DataFrame:
    """Every key with its documents; a key whose file is missing is kept, its fields are null. ``found`` tells the two apart."""
    return keys.select(key).join(documents.withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def dictionary_lines(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """Lines ``key<separator>value`` as two text columns, the value up to the line's end; lines without a separator are left out."""
    lines = spark.read.text(path)
    at = F.instr("value", separator)
    return lines.where(at > 0).select(F.trim(F.substring(F.col("value"), F.lit(1), at - 1)).alias("key"), F.trim(F.substring(F.col("value"), at + len(separator), F.length("value"))).alias("entry"))


def until_gap(documents: DataFrame, key: str = "id", ordinal: str = "ordinal") -> DataFrame:
    """The numbered documents 1, 2, ... of each key up to the first number that is absent."""
    from pyspark.sql.window import Window

    place = F.dense_rank().over(Window.partitionBy(key).orderBy(ordinal))
    return documents.where(F.col(ordinal) >= 1).withColumn("__place", place).where(F.col("__place") == F.col(ordinal)).drop("__place")


def files(spark: SparkSession, path: str) -> DataFrame:
    """The files under a path as a table: name, size, key (the name before its first dash or dot). Contents are not read."""
    df = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return df.select(name.alias("name"), F.col("length").alias("size"), F.regexp_extract(name, r"^([^.\-]+)", 1).alias("key"))


def record(df: DataFrame, key: str, value: object) -> DataFrame:
    """The rows of one id: a filter that reaches the scan replaces an offset index."""
    return df.where(F.col(key) == value)
