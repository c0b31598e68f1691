"""Streaming queries (survey group M), run over several micro-batches and read back.

Rows arrive in steps of equal time. Every tenth arrives two steps late, behind
the watermark, and is dropped where its window has closed; the oracles follow
the same marks. Counting queries run in update mode and keep the last value of
every window; sessions run in append mode and show those that have closed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querygrove.sources import files as src
from querygrove.sources.views import view
from querygrove.streaming import streams as st
from querygrove.workloads.errors import MATCHES
from querygrove.workloads.files import _CLASSED
from querygrove.workloads.history import _TTL, _creations
from querygrove.workloads.registry import query


def _as_stream(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` as a file stream, through the shared folder."""
    spark = df.sparkSession
    folder = src.shared_folder(spark, name)
    df.write.parquet(folder)
    return spark.readStream.schema(df.schema).parquet(folder)


def _run(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    spark = stream.sparkSession
    folder = src.shared_folder(spark, name)
    st.run_to_table(stream, folder, mode)
    return spark.read.parquet(f"{folder}/out")


def _latest(updates: DataFrame, keys: list[str], value: str) -> DataFrame:
    return updates.groupBy(*keys).agg(F.max_by(value, "epoch").alias(value))


STEPS = 4


def _replayed(rows: DataFrame, build, name: str, mode: str = "append", late: bool = True, align: bool = False) -> DataFrame:
    """``rows`` (``event_id, at_s, ...``) through the stream ``build(rows, seconds of a step)``, in steps of equal time.

    ``align`` stamps rows with the begin of their step.
    """
    spark = rows.sparkSession
    ends = rows.agg(F.min("at_s").alias("low"), F.max("at_s").alias("high")).first()
    low = ends["low"] or 0
    size = ((ends["high"] or 0) - low) // STEPS + 1
    own = F.expr(f"(at_s - {low}) div {size}")
    behind = F.when(F.col("event_id") % 10 == 7, 2).otherwise(0) if late else F.lit(0)
    stamped = rows.withColumn("step", own + behind).withColumn("ts", F.timestamp_seconds(low + own * size if align else F.col("at_s")))
    return st.replay(stamped, "step", lambda stream: build(stream, size), src.shared_folder(spark, name), mode)


def _marks(rows: str, late: str = "3600", align: bool = False, span: str = "r") -> str:
    """``b``: ``rows`` by step with the watermark ``mark`` they meet; ``mk``: the mark after every step. Steps divide the times of ``span``."""
    at = "low + (at_s - low) // size * size" if align else "at_s"
    return f"""r AS ({rows}), lim AS (SELECT min(at_s) AS low, (max(at_s) - min(at_s)) // {STEPS} + 1 AS size FROM {span}), b0 AS (
  SELECT r.* REPLACE ({at} AS at_s), (at_s - low) // size + CASE WHEN event_id % 10 = 7 THEN 2 ELSE 0 END AS step FROM r, lim), mk AS (
  SELECT step, max(max(at_s)) OVER (ORDER BY step) - (SELECT {late} FROM lim) AS mark FROM b0 GROUP BY step), b AS (
  SELECT b0.*, coalesce((SELECT max(mark) FROM mk WHERE mk.step < b0.step), -1) AS mark FROM b0)"""


@query("stream_scan", "v_files", _CLASSED + "SELECT path, classification, skip_reason FROM d")
def stream_scan(spark: SparkSession, sf: str) -> DataFrame:
    files = view(spark, sf, "v_files").select("path", "size", "mtime_ns", "content")
    return _run(st.classify_stream(_as_stream(files, "landing")), "scan")


_DAY = "CAST(floor(at_s / 86400) * 86400 AS BIGINT)"


@query("stream_triage", "v_errors", MATCHES + ", " + _marks(
        "SELECT event_id, at_s, catalog_id FROM rk WHERE rank = 1", span="v_errors") + f""", w AS (
  SELECT 'tumbling' AS form, {_DAY} AS window_start, catalog_id, mark FROM b
  UNION ALL SELECT 'sliding', CAST((floor(at_s / 21600) - k) * 21600 AS BIGINT), catalog_id, mark FROM b, (VALUES (0), (1), (2), (3)) s(k))
  SELECT form, window_start, catalog_id, count(*) AS n FROM w WHERE window_start + 86400 > mark GROUP BY ALL""")
def stream_triage(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["window_start", "catalog_id"]
    # the mark follows the errors that have a diagnosis: Spark filters before it looks at the times
    errors = view(spark, sf, "v_errors").select("event_id", "at_s", "dialect", "error_text")
    tumbling = _latest(_replayed(errors, lambda s, _: st.stream_triage(s), "triage", "update"), keys, "n")
    sliding = _latest(_replayed(errors, lambda s, _: st.stream_triage(s, "1 day", "6 hours"), "triage", "update"), keys, "n")
    both = tumbling.withColumn("form", F.lit("tumbling")).unionByName(sliding.withColumn("form", F.lit("sliding")))
    return both.withColumn("window_start", F.unix_seconds("window_start"))


@query("stream_counters", "v_tool_events", ", " + _marks("SELECT event_id, at_s, name, n FROM v_tool_events") + f"""
  SELECT {_DAY} AS window_start, name, CAST(sum(n) AS BIGINT) AS value FROM b WHERE {_DAY} + 86400 > mark GROUP BY ALL""")
def stream_counters(spark: SparkSession, sf: str) -> DataFrame:
    events = view(spark, sf, "v_tool_events").select("event_id", "at_s", "name", "n")
    counted = _latest(_replayed(events, lambda s, _: st.stream_counters(s), "counters", "update"), ["window_start", "name"], "value")
    return counted.withColumn("window_start", F.unix_seconds("window_start"))


@query("stream_task_ttl", "", _creations())
def stream_task_ttl(spark: SparkSession, sf: str) -> DataFrame:
    """Uses in their order, so that every creation is found; timers clear what expires between the steps."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        refs = view(spark, sf, "v_task_refs").select("event_id", "task_id", "at_s")
        return _replayed(refs, lambda s, _: st.stream_task_ttl(s, _TTL), "tasks", late=False)
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def _let_through() -> str:
    """Keys that pass, step by step: a passed key waits in ``st`` until the mark reaches its stamp plus the time to live."""
    text = "st_ AS (SELECT '' AS key, CAST(0 AS BIGINT) AS until WHERE false)"
    before = "st_"
    for k in range(STEPS + 2):
        text += f""", in{k} AS (SELECT DISTINCT key, at_s FROM b WHERE step = {k} AND at_s > mark AND key NOT IN (SELECT key FROM {before})),
  st{k} AS (SELECT * FROM (SELECT * FROM {before} UNION ALL SELECT key, at_s + (SELECT size FROM lim) FROM in{k}) x
    WHERE until > (SELECT max(mark) FROM mk WHERE step <= {k}))"""
        before = f"st{k}"
    passed = " UNION ALL ".join(f"SELECT key, at_s FROM in{k}" for k in range(STEPS + 2))
    return f"{text} SELECT key, at_s AS step_start FROM ({passed}) x"


@query("stream_dedupe", "v_task_refs", ", " + _marks(
    "SELECT event_id, at_s, task_id || ':' || cache_key AS key FROM v_task_refs", "size", align=True) + ", " + _let_through())
def stream_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """Keys with the step they pass in; one that expired passes again."""
    refs = view(spark, sf, "v_task_refs").select("event_id", "at_s", F.concat_ws(":", "task_id", "cache_key").alias("key"))
    passed = _replayed(refs, lambda s, size: st.stream_dedupe(s, f"{size} seconds"), "dedupe", align=True)
    return passed.select("key", F.unix_seconds("ts").alias("step_start"))


def _sessions() -> str:
    """Sessions step by step: open ones in ``st`` meet the rows of the next step; those that end by the mark are out."""
    text = "st_ AS (SELECT CAST(0 AS BIGINT) AS user_id, CAST(0 AS BIGINT) AS s, CAST(0 AS BIGINT) AS e, CAST(0 AS BIGINT) AS n WHERE false)"
    before = "st_"
    for k in range(STEPS + 2):
        text += f""", u{k} AS (SELECT user_id, at_s AS s, at_s + 3600 AS e, 1 AS n FROM b WHERE step = {k} AND at_s + 3600 > mark UNION ALL SELECT * FROM {before}),
  g{k} AS (SELECT *, CASE WHEN s < max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM u{k}),
  i{k} AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS sid FROM g{k}),
  m{k} AS (SELECT user_id, min(s) AS s, max(e) AS e, CAST(sum(n) AS BIGINT) AS n FROM i{k} GROUP BY user_id, sid),
  st{k} AS (SELECT * FROM m{k} WHERE e > (SELECT max(mark) FROM mk WHERE step <= {k}))"""
        before = f"st{k}"
    out = " UNION ALL ".join(f"SELECT * FROM m{k} WHERE e <= (SELECT max(mark) FROM mk WHERE step <= {k})" for k in range(STEPS + 2))
    return f"{text} SELECT user_id, s AS session_start, e AS session_end, n FROM ({out}) x"


@query("session_activity", "v_tool_events", ", " + _marks("SELECT event_id, user_id, at_s FROM v_tool_events") + ", " + _sessions())
def session_activity(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions that have closed by the end of the stream."""
    events = view(spark, sf, "v_tool_events").select("event_id", "user_id", "at_s")
    closed = _replayed(events, lambda s, _: st.session_activity(s), "sessions")
    return closed.withColumn("session_start", F.unix_seconds("session_start")).withColumn("session_end", F.unix_seconds("session_end"))
