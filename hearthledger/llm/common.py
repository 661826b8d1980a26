"""Helpers shared by the training-data operators.

Words are maximal runs outside the ASCII white space ``[\\x20\\x09-\\x0D]``; on UTF-8 bytes that is
exactly what ``bytes.split()`` yields, on the JVM it is the ``WORD`` pattern.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthledger.sources.session import table

__all__ = ["BATCH", "WORD", "durable", "from_columns", "in_batches", "scratch", "shared_dir", "table", "text_or_empty", "utf8"]

WORD = r"[^\x20\x09-\x0D]+"
#: Rows, and about so many bytes, of an Arrow batch sent to a worker: executor and worker each hold whole batches beside the heap.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 512, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}
_LOCAL_DIR: list[str] = []
_SCRATCH: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one where it is unset and the master is local (tests)."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _LOCAL_DIR:
        _LOCAL_DIR.append(tempfile.mkdtemp(prefix="hearthledger-"))
    return f"file://{_LOCAL_DIR[0]}"


def durable(df: DataFrame, tag: str, keep: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: a lineage cut that survives lost executors.

    Inside ``scratch`` the table goes when that ends, unless ``keep`` is set.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    if _SCRATCH:
        _SCRATCH[max(0, len(_SCRATCH) - 1 - keep)].extend([path] if not keep or len(_SCRATCH) > 1 else [])
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``durable`` writes inside are deleted at the end, when nothing reads them any more; kept ones belong to the scratch around this one, if any."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def in_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``df.mapInArrow(run, schema)`` in batches of at most BATCH. Spark reads the bounds from the session when it plans; smaller ones stay."""
    conf, size = df.sparkSession.conf, df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for key, most in BATCH.items():
        now = conf.get(key)
        if now.startswith("-") or not 0 < size(now) <= most:
            conf.set(key, str(most))
    return df.mapInArrow(run, schema)


def from_columns(spark: SparkSession, rows: list[tuple[int, ...]], *names: str) -> DataFrame:
    """A small table of longs, made on the driver by Arrow: a list of tuples would start further Python workers on the executors."""
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return spark.createDataFrame(pa.table([pa.array(c, pa.int64()) for c in columns], list(names)))


def text_or_empty(c: str = "text") -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def utf8(column: pa.Array, step: int = 256) -> Iterator[bytes]:
    """The texts of an Arrow column as UTF-8 bytes, null as empty, a few rows at a time."""
    for i in range(0, len(column), step):  # only a slice is copied
        for x in column.slice(i, step).cast(pa.large_string()).cast(pa.large_binary()).to_pylist():
            yield b"" if x is None else x
