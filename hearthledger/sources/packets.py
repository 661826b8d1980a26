"""Sources and sinks of case packets: files by their magic bytes, requests as JSON, payloads as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Magic bytes and the kind of file they begin. Fixed by the formats.
MAGIC = (("25504446", "pdf"), ("FFD8FF", "jpeg"), ("89504E47", "png"), ("49492A00", "tiff"), ("4D4D002A", "tiff"), ("47494638", "gif"), ("424D", "bmp"))
REQUEST = T.StructType([T.StructField(n, T.StringType()) for n in ("caseId", "caseNumber", "certificationType", "fundingProgram")])


def binary_files(spark: SparkSession, path: str, limit_mb: int = 200) -> DataFrame:
    """Files as rows, oversized ones left to the reader's own filter on length, which is pushed to the listing."""
    return spark.read.format("binaryFile").load(path).filter(F.col("length") <= limit_mb * 1_000_000)


def sniff_kind(content: Column) -> Column:
    """Kind of a file from its first bytes, not its name; null when unknown."""
    head = F.hex(F.substring(content, 1, 8))
    case = F.when(F.lit(False), "")
    for magic, kind in MAGIC:
        case = case.when(head.startswith(magic), kind)
    return case


def parse_request(body: Column) -> Column:
    """A request of known fields with the names of unknown ones; null when the text is no JSON object."""
    every = F.from_json(body, T.MapType(T.StringType(), T.StringType()))
    known = F.from_json(body, REQUEST)
    return F.struct(*(known[f.name].alias(f.name) for f in REQUEST), F.array_sort(F.array_except(F.map_keys(every), F.array(*(F.lit(f.name) for f in REQUEST)))).alias("unknown"))


def write_payloads(rows: DataFrame, path: str) -> None:
    rows.select(F.to_json(F.struct("*")).alias("value")).write.text(path)


def parse_model_output(body: Column, schema: T.DataType) -> Column:
    """Model output as rows of strings: broken escapes are mended, truncated text is null."""
    mended = F.regexp_replace(body, r'\\(?!["\\/bfnrtu])', r"\\\\")
    return F.from_json(mended, schema, {"mode": "PERMISSIVE"})


def retained(files: DataFrame, age_days: int, cap_bytes: int, as_of: Column) -> DataFrame:
    """path, size, keep: not older than ``age_days`` and, newest first, within ``cap_bytes``.

    The running sum goes over days first (bounded), then within a day, so that no single task orders all files."""
    from pyspark.sql import Window as W

    day = files.select("path", "size", "modified", F.to_date("modified").alias("day"))
    days = day.groupBy("day").agg(F.sum("size").alias("total"))
    newer = days.select("day", (F.coalesce(F.sum("total").over(W.orderBy(F.desc("day")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).alias("before"))
    inside = F.sum("size").over(W.partitionBy("day").orderBy(F.desc("modified"), "path"))
    young = F.datediff(as_of, F.col("day")) <= age_days
    return day.join(newer, "day").select("path", "size", (young & (F.col("before") + inside <= cap_bytes)).alias("keep"))
