"""Streams: incremental index maintenance and request metrics.

The windows below are extensions; the batch forms give the same rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.commits import CommitLog


class DeltaIndex:
    """A table of entries by key, kept as small files of changes that are merged when they are read.

    A change writes only entries that are new or whose hash differs, and a tombstone for each entry that goes; what
    it writes is made visible by a commit. Readers take of each key the latest entry of a commit's files; compaction writes
    them as one file. A change that names its batch is applied once, however often it is tried.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str = "id", hash_: str = "input_hash") -> None:
        self.spark, self.folder, self.key, self.hash = spark, folder.rstrip("/"), key, hash_
        self.log = CommitLog(spark, f"{self.folder}/log")

    def apply(self, rows: DataFrame, removed: DataFrame | None = None, batch: int | None = None) -> int:
        """Add or change entries (key, hash, values), take away those of `removed` (key), and tell the commit's number. No key stands twice in rows, or in both."""
        base = self.log.head()
        state = self.log.read(base)
        if batch is not None and batch <= state.get("batch", -1):
            return base
        new = rows.withColumn("_gone", F.lit(False))
        if state.get("deltas"):
            now = self.read(base).select(F.col(self.key), F.col(self.hash).alias("_h"), F.lit(True).alias("_there"))
            same = F.coalesce(F.col("_there"), F.lit(False)) & F.col("_h").eqNullSafe(F.col(self.hash))
            new = new.join(now, self.key, "left").where(~same).select(*rows.columns, "_gone")
            if removed is not None:
                out = now.join(removed.select(self.key), self.key, "left_semi")
                gone = [F.lit(True).alias("_gone"), *(F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema if f.name != self.key)]
                new = new.unionByName(out.select(self.key, *gone))
        return self.log.commit(base, {"deltas": [*state.get("deltas", []), self._write(new)], "batch": state.get("batch", -1) if batch is None else batch})

    def _write(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.folder}/deltas/delta={name}")
        return name

    def delta(self, number: int) -> DataFrame:
        """What a commit wrote: entries, and tombstones by _gone."""
        return self.spark.read.parquet(f"{self.folder}/deltas/delta={self.log.read(number)['deltas'][-1]}")

    def read(self, number: int | None = None) -> DataFrame:
        """The entries of a commit, the latest by default."""
        deltas = self.log.read(number)["deltas"]
        places = F.create_map(*(F.lit(x) for k, name in enumerate(deltas) for x in (name, k)))
        rows = self.spark.read.option("basePath", f"{self.folder}/deltas").parquet(*(f"{self.folder}/deltas/delta={x}" for x in deltas))
        values = [c for c in rows.columns if c not in (self.key, "delta")]
        # The partition column's values may look like numbers, so they are taken as text.
        place = places[F.regexp_extract(F.col("_metadata.file_path"), "delta=([0-9a-f]+)", 1)]
        latest = rows.select(self.key, place.alias("_place"), F.struct(*values).alias("_x")).groupBy(self.key).agg(F.max_by("_x", "_place").alias("_x"))
        return latest.where("NOT _x._gone").select(self.key, *(F.col(f"_x.{c}").alias(c) for c in values if c != "_gone"))

    def compact(self) -> int:
        """Write all entries as one file. Fails where another writer commits meanwhile."""
        base = self.log.head()
        state = self.log.read(base)
        return self.log.commit(base, state | {"deltas": [self._write(self.read(base).withColumn("_gone", F.lit(False)))]})


def maintain_index(changes: DataFrame, build: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, key: str = "id") -> StreamingQuery:
    """Keep a DeltaIndex up to date from a stream of changed cards, batch by batch.

    A batch writes its entries whose input_hash changed; a batch that is run again after a
    restart changes nothing.
    """

    def apply(batch: DataFrame, number: int) -> None:
        DeltaIndex(batch.sparkSession, path, key).apply(build(batch), batch=number)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def metrics(events: DataFrame, time: str, route: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, route, n, total, largest) by tumbling windows; a stream drops what is later than `late`."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return (
        rows.groupBy(F.window(time, width).alias("w"), F.col(route).alias("route"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.max(value).alias("largest"))
        .select(F.col("w.start").alias("start"), "route", "n", "total", "largest")
    )
