"""Session helpers shared by the package."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_LOCAL = [f"file://{tempfile.gettempdir()}/hearthledger-steps"]
ROOT = str(Path(__file__).resolve().parents[2])


def visible(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package when the driver found it by another way than PYTHONPATH."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    return spark


def written(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared folder (spark.checkpoint.dir; a temporary one where unset and local) and read back."""
    spark = df.sparkSession
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    base = base or _LOCAL[0]
    path = f"{base.rstrip('/')}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; columns are pruned and filters pushed by whoever uses it."""
    return visible(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
