"""A large input read in chunks, one after another, that goes on where it stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def process_in_chunks(spark: SparkSession, path: str, schema: str | T.StructType, work: Callable[[DataFrame, int], DataFrame], out: str, progress: str, files: int | None = None, size: int | None = None, form: str = "parquet", **options: object) -> DataFrame:
    """``work(chunk, number)`` of every chunk, written to ``out`` as ``chunk=<number>``; returns all of it.

    A chunk has ``files`` files or ``size`` bytes of them, at least one file;
    a file larger than that is a chunk of its own, which Spark still reads in
    splits. The plan of each chunk is kept in the folder ``progress`` before its
    work begins and its end after: a run that is started again after a crash
    repeats only the chunk that had not ended, over the same files and over what
    that had written. Files that have arrived since are further chunks. An empty
    input has no chunk and gives no rows.
    """
    reader = spark.readStream.format(form).schema(schema).options(**options)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    if size:
        reader = reader.option("maxBytesPerTrigger", size)
    made: list[T.StructType] = []

    def one(chunk: DataFrame, number: int) -> None:
        result = work(chunk, number)
        made.append(result.schema)
        result.write.mode("overwrite").parquet(f"{out}/chunk={number}")

    one_file = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = one_file.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(one_file) and system.getFileStatus(one_file).isFile():
        path = f"{path[:-1]}[{path[-1]}]"  # streams read folders and patterns
    stream = reader.load(path).writeStream.foreachBatch(one).option("checkpointLocation", progress).trigger(availableNow=True).start()
    stream.awaitTermination()
    where = spark._jvm.org.apache.hadoop.fs.Path(out)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.read.parquet(out)
    return work(spark.createDataFrame([], schema), -1).limit(0)
