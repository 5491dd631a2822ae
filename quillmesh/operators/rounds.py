"""What operators that work in rounds share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _prepare(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir, which driver and executors share. Only a local session may lack one; it gets a temporary folder, as in tests."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="quillmesh-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's name below the one that driver and executors share."""
    return f"{_prepare(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """df written to the shared folder and cut from its lineage."""
    _prepare(df.sparkSession)
    return df.checkpoint()


def small_batches(spark: SparkSession, rows: int = 1_000, size: int = 4 << 20) -> None:
    """Whole texts and their tokens go to Python by at most `rows` and about `size` bytes; a session's larger Arrow batches are lowered to that."""
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def ranked(df: DataFrame, *order, name: str = "rank") -> DataFrame:
    """df with each row's place in an order, from 0: sorted by ranges, numbered within them, and the ranges' begins added."""
    rows = checkpoint(df.orderBy(*order).withColumn("_n", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_n", 33))
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    # A row a partition.
    begins = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_begin"))
    return rows.join(F.broadcast(begins), "_part").withColumn(name, F.col("_begin") + F.col("_n").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_n", "_begin")
