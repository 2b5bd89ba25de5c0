"""Domain profiles kept up to date from a stream of history files."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from leafmill.operators.profiles import fold_profiles
from leafmill.sources.tables import read_table, update_table

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_ROW = "ts timestamp, id long, quality_score double"


def profile_updater(root: str, checkpoint: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: fold a micro-batch into the profile table.

    A batch is folded like a whole history, so a domain that fills a third of it is
    shared between tasks; a keyed state function would put it on one. It continues from
    the newest version, whoever wrote that, and writes the next one. The log of versions
    holds the id of the query, which Spark keeps in the checkpoint and which is new for a new
    checkpoint, and the batch: one that Spark repeats after a failure is applied once.
    """

    def update(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stream = spark.read.schema("id string").json(f"{checkpoint}/metadata").first()["id"]
        update_table(
            spark, root, "domain_profiles", lambda prior: fold_profiles(batch, prior),
            stream=stream, batch=batch_id,
        )

    return update


def start_profile_stream(
    history: DataFrame, root: str, *, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Start the query over a streaming history (domain, ts, id, quality_score).

    The result equals the batch fold when rows arrive in (ts, id) order; late rows are
    applied when they arrive, and need a batch rebuild to be moved.
    """
    writer = history.writeStream.foreachBatch(profile_updater(root, checkpoint)).option(
        "checkpointLocation", checkpoint
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def current_profiles(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "domain_profiles")


class Waiting(StatefulProcessor):
    """Rows of one (domain, slice of time), kept until the watermark has passed the slice.

    State: the rows as a list, in arrival order, appended to without reading it. A timer at the
    slice's end hands all of them on and clears the list.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", _ROW)

    def handleInputRows(
        self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any
    ) -> Iterator[pd.DataFrame]:
        for batch in rows:
            values = batch[["ts", "id", "quality_score"]].astype(object)
            self.rows.appendList([tuple(r) for r in values.where(values.notna(), None).to_numpy()])
        self.handle.registerTimer(int(key[1]))
        return iter(())

    def handleExpiredTimer(
        self, key: Any, timerValues: Any, expiredTimerInfo: Any
    ) -> Iterator[pd.DataFrame]:
        held = list(self.rows.get())
        self.rows.clear()
        out = pd.DataFrame(held, columns=["ts", "id", "quality_score"])
        out.insert(0, "domain", key[0])
        yield out

    def close(self) -> None:
        pass


def in_time_order(history: DataFrame, *, delay: str, slice_seconds: int) -> DataFrame:
    """A streaming history whose rows are handed on slice by slice, each once it is complete.

    Keyed state by (domain, slice of ``slice_seconds``): slices are the salt of a hot domain, one
    that keeps the order of time, so shorter ones mean smaller groups. A slice is complete when
    the watermark, the latest time seen minus ``delay``, has passed its end; it comes after all
    earlier slices of its domain. Rows older than the watermark when they arrive are
    dropped and counted by Spark (``numRowsDroppedByWatermark`` of the state operator); rows
    without a time are not taken. A null domain is a domain like any other.
    """
    end = (F.floor(F.unix_seconds("ts") / slice_seconds) + 1) * (slice_seconds * 1000)
    rows = history.select(
        "domain",
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("id").cast("long").alias("id"),
        F.col("quality_score").cast("double").alias("quality_score"),
    ).where(F.col("ts").isNotNull())
    return (
        rows.withWatermark("ts", delay)
        .withColumn("_slice", end.cast("long"))
        .groupBy("domain", "_slice")
        .transformWithStateInPandas(Waiting(), f"domain string, {_ROW}", "Append", "EventTime")
    )


def start_ordered_profile_stream(
    history: DataFrame,
    root: str,
    *,
    checkpoint: str,
    delay: str = "1 hour",
    slice_seconds: int = 60,
    available_now: bool = False,
) -> StreamingQuery:
    """Like ``start_profile_stream``, but rows that arrive out of order are put in order first.

    Rows wait in keyed state (see ``in_time_order``) and are folded when their slice is complete,
    so the profiles equal the batch fold of all rows that were no later than ``delay``, in
    whatever order they came. ``ordered_profiles`` adds the rows that still wait. The state is in
    the checkpoint, so a query that is started again goes on from it.
    """
    spark = history.sparkSession
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)  # a query takes the settings of its start with it
    try:
        rows = in_time_order(history, delay=delay, slice_seconds=slice_seconds)
        writer = (
            rows.writeStream.outputMode("append")
            .foreachBatch(profile_updater(root, checkpoint))
            .option("checkpointLocation", checkpoint)
        )
        if available_now:
            writer = writer.trigger(availableNow=True)
        return writer.start()
    finally:
        spark.conf.set(_PROVIDER, before)


def waiting_rows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The rows that still wait in the state of ``start_ordered_profile_stream``."""
    held = spark.read.format("statestore").option("stateVarName", "rows").load(checkpoint)
    return held.select(F.col("key.domain").alias("domain"), "list_element.*")


def ordered_profiles(spark: SparkSession, root: str, checkpoint: str) -> DataFrame:
    """Profiles as if all slices were complete: the table, and the waiting rows folded onto it.

    To be read between micro-batches or while the query is stopped: a batch that is under way
    may have its rows in both.
    """
    return fold_profiles(waiting_rows(spark, checkpoint), current_profiles(spark, root))
