"""Reading the driver's tables, and folders that the cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under spark.checkpoint.dir. Where that is unset, a local session gets a temporary one; a cluster has to name it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that the cluster shares")
    if not base:
        made = tempfile.mkdtemp(prefix="quiverlake-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        base = f"file://{made}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/quiverlake/{name}-{uuid.uuid4().hex}"


MOST_PARTITIONS = 100_000


def file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """Arrow's file system for a Spark path, and the path in it."""
    return pyarrow.fs.FileSystem.from_uri("s3" + path[3:] if path.startswith(("s3a:", "s3n:")) else path)


def partitions_for(df: DataFrame, each: int = 128 << 20) -> int:
    """How many partitions to deal df into: the session's number, or more if the plan's size asks for them."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    number = -(-size // each) if size < 1 << 50 else 0  # more means that the plan doesn't know
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(number, MOST_PARTITIONS))
