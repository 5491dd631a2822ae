"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the separator of "words" in several operators.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the one in spark.checkpoint.dir. Only a local session may go without it;
    it then gets a temporary folder of its own, as in tests.
    """
    sc = spark.sparkContext
    if found := sc.getCheckpointDir():
        return found
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quillmesh-")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def small_batches(spark: SparkSession, rows: int = 1_000, size: int = 4 << 20) -> None:
    """Send whole texts to Python by at most `rows` and about `size` bytes: a session's larger Arrow batches are lowered to that."""
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: its lineage ends there."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo folds."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


#: Lists of row numbers are broadcast up to this many (8 MB); longer ones are joined by shuffling.
BROADCAST_IDS = 1_000_000
#: A key is hot from this share of all rows on, so there are at most so many hot keys.
HOT_KEYS = 10_000
#: Tasks over which a component's centre is dealt.
SALTS = 8


def small_side(df: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """df, marked for broadcasting if its rows, which are counted, are few enough. It should hold a few numbers a row."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def lookup(left: DataFrame, right: DataFrame, key: str | list[str], size: str) -> DataFrame:
    """Left join with a table that has one row a key; `size` of it: how many rows of left have the key, as it is known.

    Keys that a ten-thousandth of all rows or more have are looked up in a broadcast of at most
    HOT_KEYS rows and their rows of left are not moved; all others are shuffled. `right` should be materialised.
    """
    total = right.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    hot = F.col(size) >= max(1_000, -(-total // HOT_KEYS))
    heavy = F.broadcast(right.where(hot).drop(size))
    near = left.join(heavy, key)
    far = left.join(heavy.select(key), key, "left_anti").join(right.where(~hot).drop(size), key, "left")
    return near.unionByName(far)


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node has one edge to a smaller one, or edges to larger ones alone."""
    end = lambda node, up: F.struct(F.col(node).alias("node"), F.lit(up).alias("up"))
    ends = edges.select(F.inline(F.array(end("u", 1), end("v", 0))))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("least")).where("up > 1 OR (up = 1 AND least = 0)").isEmpty()


def connected_components(edges: DataFrame, left: str, right: str, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has an edge; component is the smallest node it reaches.

    Alternates large-star and small-star steps on the edge table until it holds a star of
    each component and no more, which may be so from the start. Every round is one
    checkpoint in the shared folder; only whether there are stars comes to the driver.
    Self links and nulls are ignored.
    """
    spark = edges.sparkSession
    shared_dir(spark)
    e = (
        edges.where(F.col(left) != F.col(right))
        .select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
        .distinct()
        .checkpoint()
    )
    for _ in range(max_rounds + 1):
        if _are_stars(e):
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m"))
        # A star's centre is the hot key of this join; it is dealt over SALTS tasks. Only nodes with an edge are in it.
        dealt = e.withColumn("_salt", F.pmod(F.xxhash64("u"), F.lit(SALTS)).cast("int"))
        large = dealt.join(low.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["v", "_salt"]).select("u", F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(
                F.array(
                    F.struct(F.col("u"), F.col("m").alias("v")),
                    F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                )
            ).alias("x")
        )
        e = small.select("x.u", "x.v").where("u != v").distinct().checkpoint()
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
