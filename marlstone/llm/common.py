"""What several operators share: shared-folder tables, content keys, words."""

from __future__ import annotations

import gc
import pickle
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the white space that separates words.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SMALL_TABLE = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where a session on one machine has none, one is made and set; on a cluster
    that is an error, as executors do not see each other's folders.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="marlstone-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table.

    The result no longer depends on any executor or on the plan of ``df``.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._marlstone_path = path
    block = _SCRATCH.get()
    if block is not None:
        block.append(out)
    return out


#: Tables written inside the scratch block that is open in this thread.
_SCRATCH: ContextVar[list[DataFrame] | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A block whose written tables are deleted at its end, but for those passed to the function it gives."""
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    written: list[DataFrame] = []
    token = _SCRATCH.set(written)
    try:
        yield keep
    finally:
        _SCRATCH.reset(token)
        for df in written:
            if not any(df is k for k in kept):
                discard(df)
        outer = _SCRATCH.get()
        if outer is not None:
            outer.extend(kept)


def discard(df: DataFrame) -> None:
    """Delete a table that ``materialize`` wrote, when nothing reads it any more."""
    path = getattr(df, "_marlstone_path", None)
    if path:
        jvm, jsc = df.sparkSession._jvm, df.sparkSession._jsc
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(jsc.hadoopConfiguration()).delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def release(spark: SparkSession) -> None:
    """Lets the driver drop what finished steps have shuffled and broadcast: it does so only when it collects garbage."""
    for _ in range(2):  # what the first frees may hold the rest
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of a few MB, so that a Python worker's memory follows neither row counts nor text lengths.

    A lazy plan reads these settings when it runs, so they stay set; values that the caller has chosen are left alone.
    """
    for name, usual, value in (("maxRecordsPerBatch", "10000", "2000"), ("maxBytesPerBatch", str(64 << 20), str(4 << 20))):
        key = f"spark.sql.execution.arrow.{name}"
        if spark.conf.get(key, usual) in (usual, "64MB", "67108864b"):
            spark.conf.set(key, value)


def text_of(column: str | Column) -> Column:
    """The text, a null as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def content_key(column: str | Column) -> Column:
    """16 bytes of SHA-256 that stand for the content of a text."""
    return F.substring(F.unhex(F.sha2(F.encode(text_of(column), "UTF-8"), 256)), 1, 16)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def share(spark: SparkSession, value: object) -> Broadcast:
    """Broadcasts an object together with its class, so that workers need no package; read it with ``shared``."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def shared(value: Broadcast) -> object:
    return pickle.loads(value.value)  # noqa: S301  made by ``share``


def spread(df: DataFrame) -> DataFrame:
    """A small table in fewer files than there are cores, dealt out anew; any other as it is.

    Rows of one row group are read by one task, which for a table of a few MB
    leaves most cores idle. Only where rows are computed changes.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size <= SMALL_TABLE and len(df.inputFiles()) < cores:
        return df.repartition(cores)
    return df
