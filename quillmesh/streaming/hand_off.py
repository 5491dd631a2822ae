"""Ingestions that are handed from step to step, kept as state by a stream of what their files do.

A file of an ingestion arrives or is taken away. What counts for a file is its latest change, so changes that are repeated
or out of order make no difference, and a stream ends with the rows of the batch form.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.contracts import INGESTION_FILES, ingestion_stage
from ..operators.rounds import shared_folder

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_CHANGE = "identity string, provider string, file string, at timestamp, gone boolean, digest string, micros long"
_FOUND = "identity string, change long, provider string, files array<string>, same boolean, last long, stalled boolean"
_STATE = "change long, provider string, last long, micros array<long>, gone array<boolean>, digest array<string>"
_OUT = "identity string, change long, provider string, files string, stage string, waiting_for string, issue string, stalled boolean, last timestamp"


def _changes(rows: DataFrame) -> DataFrame:
    """What can be a change of an ingestion: an identity, a time and a known file."""
    known = rows.withColumn("at", F.col("at").cast("timestamp")).where(F.col("identity").isNotNull() & F.col("at").isNotNull() & F.col("file").isin(*INGESTION_FILES))
    return known.select(
        F.col("identity").cast("string").alias("identity"), F.col("provider").cast("string").alias("provider"), "file", "at",
        F.coalesce("gone", F.lit(False)).alias("gone"), F.coalesce(F.col("digest").cast("string"), F.lit("")).alias("digest"), F.unix_micros("at").alias("micros"),
    )


def _latest_in_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each Arrow batch the latest change of each file and provider alone, so an ingestion with very many changes sends few to its task."""
    for batch in batches:
        yield batch.sort_values(["micros", "gone", "digest"], kind="stable").drop_duplicates(["identity", "provider", "file"], keep="last")


class _Ingestion(StatefulProcessor):
    """The latest change of each file, and a timer that runs out when nothing has changed for `wait` milliseconds."""

    def __init__(self, wait: int) -> None:
        self.wait = wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("ingestion", _STATE)

    def _row(self, identity: str, state: tuple, stalled: bool) -> Row:
        change, provider, last, micros, gone, digest = state
        files = [f for f, m, g in zip(INGESTION_FILES, micros, gone, strict=True) if m is not None and not g]
        same = digest[INGESTION_FILES.index("handoff")] == digest[INGESTION_FILES.index("judgement")]
        return Row(identity=identity, change=change, provider=provider, files=files, same=same, last=last, stalled=stalled)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        n = len(INGESTION_FILES)
        old = tuple(self.state.get()) if self.state.exists() else (0, None, None, [None] * n, [False] * n, [""] * n)
        change, provider, last, micros, gone, digest = old[:3] + tuple(list(x) for x in old[3:])
        for row in rows:
            k = INGESTION_FILES.index(row.file)
            if micros[k] is None or (row.micros, row.gone, row.digest) > (micros[k], gone[k], digest[k]):
                micros[k], gone[k], digest[k] = row.micros, row.gone, row.digest
            last = row.micros if last is None else max(last, row.micros)
            provider = min((p for p in (provider, row.provider) if p is not None), default=None)
        new = (change, provider, last, micros, gone, digest)
        if new != old:
            new = (change + 1, *new[1:])
            self.state.update(new)
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(last // 1000 + self.wait)
            yield self._row(key[0], new, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        state = tuple(self.state.get())
        if any(m is not None and not g for m, g in zip(state[3], state[4], strict=True)):
            state = (state[0] + 1, *state[1:])
            self.state.update(state)
            yield self._row(key[0], state, True)
        else:
            # All its files are gone, and changes as old as these come too late to be read.
            self.state.clear()

    def close(self) -> None:
        pass


def _staged(found: DataFrame) -> DataFrame:
    """The stage of each row of _FOUND."""
    has = {f: F.array_contains("files", f) for f in INGESTION_FILES}
    rows = found.withColumn("_s", ingestion_stage(F.col("provider"), has, F.col("same")))
    return rows.select("identity", "change", "provider", F.array_join("files", ",").alias("files"), "_s.stage", "_s.waiting_for", "_s.issue", "stalled", F.timestamp_micros("last").alias("last"))


def follow(changes: DataFrame, wait: str, late: str) -> DataFrame:
    """Stages of ingestions from a stream of changes: a row each time an ingestion changes in a batch, and one when it stalls.

    changes: identity, provider, file (of INGESTION_FILES), at, gone (the file is taken away; null: it is not), digest (what a
    hand-off or judgement is bound to). Changes without identity or time, or of unknown files, are left out; changes that are older than the
    watermark (`late`) are not read. An ingestion stalls when it has files and the watermark is `wait` past its last change. State is a row of seven files
    an ingestion; it is dropped where all files are gone and the time is up. The least provider that is not null counts.
    """
    spark = changes.sparkSession
    few = _changes(changes).mapInPandas(_latest_in_batch, _CHANGE).withWatermark("at", late)
    found = few.groupBy("identity").transformWithState(_Ingestion(_millis(spark, wait)), _FOUND, "append", "eventTime")
    return _staged(found)


def _span(interval: str) -> Column:
    """An interval such as "2 HOURS" in milliseconds."""
    return F.unix_millis(F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL {interval}"))


def _millis(spark: SparkSession, wait: str) -> int:
    return spark.range(1).select(_span(wait)).first()[0]


def run(changes: DataFrame, out: str, checkpoint: str, wait: str, late: str) -> StreamingQuery:
    """Append what follow() gives to the Parquet folder `out`, until all that has arrived is read; a restart goes on after the last batch."""
    spark = changes.sparkSession
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    # State with timers needs this store; a query keeps the setting that it starts with.
    spark.conf.set(key, _ROCKS)
    try:
        return follow(changes, wait, late).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.set(key, before)


def current(spark: SparkSession, out: str) -> DataFrame:
    """The last row of each ingestion in run()'s folder."""
    rows = spark.read.schema(_OUT).parquet(out)
    x = F.struct(*(c for c in rows.columns if c not in ("identity", "change")))
    return rows.groupBy("identity").agg(F.max_by(x, "change").alias("_x")).select("identity", "_x.*")


def stages(changes: DataFrame, wait: str, late: str) -> DataFrame:
    """current()'s rows of a table of changes, as they are after its last change."""
    rows = _changes(changes)
    order = F.struct("micros", "gone", "digest")
    files = rows.groupBy("identity", "file").agg(F.max(order).alias("x"), F.min("provider").alias("provider"))
    digest = lambda f: F.coalesce(F.max(F.when(F.col("file") == f, F.col("x.digest"))), F.lit(""))
    there = F.collect_set(F.when(~F.col("x.gone"), F.col("file")))
    kept = F.filter(F.array(*map(F.lit, INGESTION_FILES)), lambda f: F.array_contains("_files", f))
    one = files.groupBy("identity").agg(F.min("provider").alias("provider"), there.alias("_files"), (digest("handoff") == digest("judgement")).alias("same"), F.max("x.micros").alias("last"))
    # One value: the time that the watermark has reached.
    now = rows.agg(F.unix_millis(F.max("at")) - _span(late)).scalar()
    over = F.floor(F.col("last") / 1000) + _span(wait) <= now
    found = one.select("identity", F.lit(1).cast("long").alias("change"), "provider", kept.alias("files"), "same", "last", (over & (F.size("_files") > 0)).alias("stalled"))
    return _staged(found).drop("change")


def stream_stages(read: DataFrame, wait: str, late: str) -> DataFrame:
    """current()'s rows of a stream that is read to its end, through new folders below the shared one."""
    folder = shared_folder(read.sparkSession, "hand-off")
    run(read, f"{folder}/rows", f"{folder}/checkpoint", wait, late).awaitTermination()
    return current(read.sparkSession, f"{folder}/rows")
