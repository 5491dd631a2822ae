"""Token counts of the documents in flat token files.

A flat file holds nothing but token ids, two or four bytes each (little-endian), with an
end-of-document id after each document: no header and no index. Files are cut into byte
ranges; each task searches its ranges for the identifier with one vectorised comparison
and reports the documents that end there. A prefix scan over the ranges' summaries then
numbers documents and joins a document's parts on both sides of a cut.

Tokens after a file's last identifier are a last, open document. A file of no tokens has
no document. Two identifiers in a row enclose a document of no tokens. A file must hold a
whole number of ids; otherwise the scan fails.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, new_folder

#: Ids in a range.
RANGE_IDS = 1 << 22
TYPES = {2: np.dtype("<u2"), 4: np.dtype("<u4")}


def _uri(path: str) -> str:
    """Hadoop writes file:/a where others write file:///a."""
    return "file:///" + path[5:].lstrip("/") if path.startswith("file:") else path


def write_token_files(df: DataFrame, key: str, ids: str, end: int, folder: str, width: int = 2) -> DataFrame:
    """Write column `ids` (array<int>) as flat files, one a partition, and tell which document is where.

    Returns (key, file, position): the document's place in its file, from 0. Null ids make
    a document of no tokens. The files come by way of a temporary name, so that a task that
    is run again, or twice, leaves one whole file. The returned rows are themselves part
    of the writing: materialise them once.
    """
    kind = TYPES[width]
    key_type = df.schema[key].dataType
    target = _uri(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        where, path = fs.FileSystem.from_uri(target)
        where.create_dir(path, recursive=True)
        name = f"tokens-{context.partitionId():06d}.bin"
        temporary = f"{path}/_{name}.{context.taskAttemptId()}"
        position = 0
        with where.open_output_stream(temporary) as out:
            for batch in batches:
                lists = batch.column(1)
                size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                flat = lists.drop_null().flatten().to_numpy(zero_copy_only=False)
                if len(flat) and (int(flat.max()) > np.iinfo(kind).max or int(flat.min()) < 0):
                    raise ValueError(f"an id does not fit into {width} bytes")
                if (flat == end).any():
                    raise ValueError("a document holds the end-of-document id")
                ends = np.cumsum(size)
                stream = np.full(len(flat) + len(size), end, kind)
                inside = np.ones(len(stream), bool)
                inside[ends + np.arange(len(size))] = False
                stream[inside] = flat
                out.write(stream.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array([name] * len(size), pa.string()),
                        pa.array(np.arange(position, position + len(size)), pa.int64()),
                    ],
                    names=[key, "file", "position"],
                )
                position += len(size)
        where.move(temporary, f"{path}/{name}")

    schema = f"`{key}` {key_type.simpleString()}, file string, position bigint"
    return df.select(key, ids).mapInArrow(write, schema)


def token_ranges(spark: SparkSession, folder: str, width: int = 2, range_ids: int = RANGE_IDS) -> DataFrame:
    """(file, path, part, begin, n_ids) of each range of the files of a folder; only their sizes are read."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.bin")
        .load(folder)
        .select("path", "length", F.element_at(F.split("path", "/"), -1).alias("file"))
    )
    span = range_ids * width
    whole = F.when(F.col("length") % width != 0, F.raise_error(F.concat(F.lit("not whole ids: "), "path"))).otherwise(F.col("length"))
    return (
        files.withColumn("length", whole)
        .where("length > 0")
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.ceil(F.col("length") / span).cast("int") - 1)))
        .withColumn("begin", F.col("part").cast("long") * range_ids)
        .withColumn("n_ids", F.least(F.lit(range_ids).cast("long"), (F.col("length") / width).cast("long") - F.col("begin")))
        .select("file", "path", "part", "begin", "n_ids")
    )


def scan_range(ids: np.ndarray, end: int) -> tuple[np.ndarray, int]:
    """Token counts of the documents that end in a range, the first from the range's begin; tokens left after them."""
    at = np.flatnonzero(ids == end)
    return np.diff(at, prepend=-1) - 1, len(ids) - (int(at[-1]) + 1 if len(at) else 0)


def count_tokens(spark: SparkSession, folder: str, end: int, width: int = 2, range_ids: int = RANGE_IDS) -> DataFrame:
    """(file, position, n_tokens, closed) of each document of the flat files in a folder."""
    kind = TYPES[width]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                where, path = fs.FileSystem.from_uri(_uri(row["path"]))
                with where.open_input_file(path) as source:
                    data = source.read_at(row["n_ids"] * width, row["begin"] * width)
                counts, rest = scan_range(np.frombuffer(data, kind), end)
                yield pa.RecordBatch.from_pylist(
                    [{"file": row["file"], "part": row["part"], "counts": counts.tolist(), "rest": rest}], schema=arrow
                )

    arrow = pa.schema([("file", pa.string()), ("part", pa.int32()), ("counts", pa.list_(pa.int64())), ("rest", pa.int64())])
    ranges = token_ranges(spark, folder, width, range_ids)
    # One range a task at a time; neighbours need not be together, as the scan below joins them.
    found = ranges.repartition(F.col("file"), F.col("part")).mapInArrow(scan, "file string, part int, counts array<bigint>, rest bigint")
    scanned = materialise(found.select("file", "part", "counts", "rest", F.size("counts").cast("long").alias("n")), "range-counts")

    # The prefix scan: a range's first document takes what is left open before it, which
    # reaches back to the last range with an end in it. It goes over three numbers a range; the counts stay where they are.
    order = Window.partitionBy("file").orderBy("part")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    summaries = (
        scanned.select("file", "part", "n", "rest")
        .withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .withColumn("_total", F.sum("rest").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_base", F.when(F.col("n") > 0, F.col("_total") - F.col("rest")))
        .withColumn("_open", F.coalesce(F.lag("_total").over(order), F.lit(0)) - F.coalesce(F.last("_base", True).over(before), F.lit(0)))
        .withColumn("_last", F.lead("part").over(order).isNull())
    )
    offsets = materialise(summaries.select("file", "part", "n", "rest", "first", "_open", "_last"), "range-offsets")
    ended = scanned.where("n > 0").select("file", "part", "counts").join(offsets.hint("merge"), ["file", "part"]).select(
        "file", "first", "_open", F.posexplode("counts").alias("_k", "count")
    ).select(
        "file",
        (F.col("first") + F.col("_k")).alias("position"),
        (F.col("count") + F.when(F.col("_k") == 0, F.col("_open")).otherwise(0)).alias("n_tokens"),
        F.lit(True).alias("closed"),
    )
    tail = offsets.where(F.col("_last")).select(
        "file",
        (F.col("first") + F.col("n")).alias("position"),
        (F.col("rest") + F.when(F.col("n") == 0, F.col("_open")).otherwise(0)).alias("n_tokens"),
        F.lit(False).alias("closed"),
    ).where("n_tokens > 0")
    return ended.unionByName(tail)


def document_token_counts(docs: DataFrame, encoded_ids: str = "token_ids", key: str = "doc_id", end: int = 50256) -> DataFrame:
    """Write documents' ids as flat files into the shared folder, then count them from the files alone.

    Returns (key, n_tokens). The places of documents that writing tells are joined with the
    counts by file and position.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "flat-tokens")
    places = new_folder(spark, "flat-places")
    written = write_token_files(docs, key, encoded_ids, end, folder)
    written.write.parquet(places)
    placed = spark.read.schema(written.schema).parquet(places)
    counts = count_tokens(spark, folder, end) if placed.limit(1).count() else None
    if counts is None:
        return placed.select(key, F.lit(0).cast("long").alias("n_tokens"))
    # Both sides have a row a document: neither may be broadcast.
    return placed.join(counts.hint("merge"), ["file", "position"], "left").select(key, F.col("n_tokens"))
