"""Streaming twins of batch operators: the same transformations over unbounded input."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, StructField, StructType

from querygrove.operators import errors as er
from querygrove.operators import files as fi
from querygrove.options import options
from querygrove.prims import spread
from querygrove.sources.files import FILES_SCHEMA, move, relative, subfolders


def stream_scan(spark: SparkSession, root: str) -> DataFrame:
    """Files below ``root`` classified as they land; state is the file source's own log."""
    files = (
        spark.readStream.format("binaryFile").schema(FILES_SCHEMA).option("recursiveFileLookup", "true").load(root)
    )
    return classify_stream(relative(files, root))


def classify_stream(files: DataFrame) -> DataFrame:
    return fi.classify_files(fi.prune_paths(fi.describe_paths(files))).select("path", "classification", "skip_reason")


def stream_triage(errors: DataFrame, window: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Best diagnosis counts per catalogue entry and window; late events are dropped.

    ``errors`` has ``ts, dialect, error_text``. The best match of an event is
    picked inside the row, by the same constant tests as in a batch.
    """
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    return (
        er.best_match(errors).withWatermark("ts", late).groupBy(span.alias("w"), "catalog_id").agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("window_start"), "catalog_id", "n")
    )


def stream_counters(events: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "name").agg(
        F.sum("n").alias("value")).select(F.col("w.start").alias("window_start"), "name", "value")


class TaskClock(StatefulProcessor):
    """Creation time of a task; a timer at creation plus time to live clears it.

    Uses do not move the timer, so expiry counts from the creation. The uses of
    a batch are searched, not walked: one search per creation.
    """

    def __init__(self, ttl: int) -> None:
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.created = handle.getValueState("created", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        uses = sorted({int(at) for batch in rows for at in batch["at_s"].unique()})
        created = self.created.get()[0] if self.created.exists() else None
        out = []
        nxt = 0 if created is None else bisect_right(uses, created + self.ttl)
        while nxt < len(uses):
            created = uses[nxt]
            out.append((key[0], created))
            nxt = bisect_right(uses, created + self.ttl, nxt + 1)
        if created is not None:
            self.created.update((created,))
            if out:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer((created + self.ttl) * 1000 + 1)
        if out:
            yield pd.DataFrame(out, columns=["task_id", "created"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        self.created.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_task_ttl(refs: DataFrame, ttl: int | None = None, late: str = "1 hour") -> DataFrame:
    """Creations of tasks from a stream of uses with ``task_id, at_s, ts``.

    Needs the RocksDB state store. Runs on event time.
    """
    ttl = options()["task_ttl_seconds"] if ttl is None else ttl
    return refs.withWatermark("ts", late).select("task_id", "at_s", "ts").groupBy("task_id").transformWithStateInPandas(
        statefulProcessor=TaskClock(ttl), outputStructType="task_id string, created long", outputMode="append",
        timeMode="EventTime")


def stream_dedupe(events: DataFrame, ttl: str = "1 hour") -> DataFrame:
    """A key that comes again within the watermark is let through once."""
    return events.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["key"])


def session_activity(events: DataFrame, gap: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Sessions per user, split by inactivity."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(
        F.count(F.lit(1)).alias("n")).select(
        "user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")


def run_to_table(stream: DataFrame, folder: str, mode: str = "append") -> None:
    """Runs a stream over what is there and stops; results go to Parquet below ``folder``."""
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        query = writer.outputMode("append").format("parquet").option("path", f"{folder}/out").start()
    else:
        # update mode: every micro-batch is a folder of its own; readers take the last value of a key
        def save(batch: DataFrame, epoch: int) -> None:
            batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{folder}/out/epoch={epoch:08d}")

        query = writer.outputMode("update").foreachBatch(save).start()
    query.awaitTermination()


def replay(rows: DataFrame, step: str, build: Callable[[DataFrame], DataFrame], folder: str, mode: str = "append") -> DataFrame:
    """Feeds ``rows`` to the stream ``build`` makes, one micro-batch per value of the whole number ``step``, in its order.

    The files of a step land once the run over the steps before has ended, and
    every run goes on from the checkpoint of the last. Within a step rows keep
    no order. Watermarks move between steps, as a run ends with a batch without
    data if its rows moved the mark: windows close, and rows of later steps
    that are behind the mark are dropped. No rows at all: an empty result.
    """
    spark = rows.sparkSession
    # files of a step for every task: a stream is read by no more tasks than that
    spread(rows).write.partitionBy(step).parquet(f"{folder}/staged")
    landing = f"{folder}/landing"
    steps = sorted(subfolders(spark, f"{folder}/staged", f"{step}=*"), key=lambda path: int(path.rsplit("=", 1)[1]))
    spark.createDataFrame([], rows.drop(step).schema).write.parquet(landing)
    stream = build(spark.readStream.schema(rows.drop(step).schema).option("recursiveFileLookup", "true").parquet(landing))
    for number, path in enumerate(steps):
        move(spark, path, f"{landing}/step-{number:06d}")
        run_to_table(stream, folder, mode)
    schema = stream.schema if mode == "append" else StructType([*stream.schema.fields, StructField("epoch", IntegerType())])
    if not steps:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{folder}/out")
