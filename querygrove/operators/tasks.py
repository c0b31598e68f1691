"""Task continuity and tool metrics."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querygrove import refdata
from querygrove.options import options
from querygrove.prims import rule_table, segmented, spread_by


def active_tasks(refs: DataFrame, ttl: int | None = None) -> DataFrame:
    """Creations of each task: first use, then the first use after each expiry.

    Expiry counts from the creation and is not moved by later uses. Uses are
    first reduced to distinct seconds per span of one time to live, combined
    map-side, which bounds every list by ``ttl`` however many rows a task has.
    Creations are more than a time to live apart, so a span has one at most:
    the spans of a task pass through a fold of one search each, whose state is
    the current creation time.
    """
    ttl = options()["task_ttl_seconds"] if ttl is None else ttl
    spans = refs.groupBy("task_id", F.floor(F.col("at_s") / ttl).cast("long").alias("span")).agg(
        F.array_sort(F.collect_set("at_s")).alias("uses"))
    ordered = spread_by(spans, "task_id").sortWithinPartitions("task_id", "span")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, created = None, 0
        for batch in batches:
            out: list[tuple[str, int]] = []
            for name, uses in zip(batch["task_id"], batch["uses"]):
                first = bisect_right(uses, created + ttl) if name == task else 0
                if first < len(uses):
                    task, created = name, int(uses[first])
                    out.append((task, created))
            yield pd.DataFrame(out, columns=["task_id", "created"])

    return ordered.mapInPandas(fold, "task_id string, created long")


def task_refs(refs: DataFrame) -> DataFrame:
    """First reference per task and key, with its place in the task's order."""
    return refs.groupBy("task_id", "cache_key").agg(
        F.min(F.struct("at_s", "event_id", "artifact_type")).alias("_r")
    ).select("task_id", "cache_key", "_r.*")


def resolve_refs(refs: DataFrame, results: DataFrame) -> DataFrame:
    """Latest live artefact per task and type; dangling references resolve to null."""
    live = results.select(F.col("key").alias("cache_key"), "value").withColumn("_live", F.lit(True))
    found = refs.join(live, "cache_key", "left")
    order = F.when(F.col("_live"), F.struct("at_s", "event_id"))
    return found.groupBy("task_id", "artifact_type").agg(
        F.max_by("cache_key", order).alias("cache_key"), F.max_by("value", order).alias("value"),
        F.count_if(F.col("_live").isNull()).alias("dangling"))


def counters(events: DataFrame) -> DataFrame:
    return events.groupBy("name").agg(F.sum("n").alias("value"))


def counter_projection(values: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """All known names; those without events read 0."""
    known = rule_table(values.sparkSession, [(n,) for n in names], "name string")
    return values.join(known, "name", "right").select("name", F.coalesce("value", F.lit(0).cast("long")).alias("value"))


def redact_fields(events: DataFrame) -> DataFrame:
    """Values of sensitive field names replaced; names that merely contain one survive."""
    fields = F.from_json("fields_json", "map<string,string>")
    return events.withColumn("fields", F.transform_values(
        fields, lambda k, v: F.when(k.isin(*refdata.REDACT_KEYS), "<redacted>").otherwise(v)))


def usage_by_user_window(events: DataFrame, gap: int = 3600, tiles: int = 4) -> DataFrame:
    """Per event of a user: neighbours, session start, running count and quartile.

    One segmented scan: a user with very many events, on one day or on many,
    fills several ranges and is scanned in as many tasks.
    """
    at = F.struct("at_s", "event_id")
    rows = segmented(events.select("event_id", "user_id", "at_s"), ["user_id"], ["at_s", "event_id"], {
        "running": ("sum", F.lit(1)), "_prev": ("max_before", at), "_next": ("next", at), "_total": ("total", F.lit(1))})
    base, extra = F.floor(F.col("_total") / tiles), F.col("_total") % tiles
    long_part = extra * (base + 1)
    tile = F.when(F.col("running") <= long_part, F.ceil(F.col("running") / (base + 1))).otherwise(
        extra + F.ceil((F.col("running") - long_part) / base))
    prev_at = F.col("_prev.at_s")
    return rows.select(
        "event_id", "user_id", prev_at.alias("prev_at"), F.col("_next.at_s").alias("next_at"), "running",
        (prev_at.isNull() | (F.col("at_s") - prev_at > gap)).alias("session_start"), tile.cast("int").alias("quartile"))
