"""Queries over result history, tasks and metrics (survey groups J, K and L)."""

from __future__ import annotations

from pyspark.sql import functions as F

from querygrove.operators import results as re_
from querygrove.operators import tasks as ta
from querygrove.sources.views import oracle, table, view
from querygrove.workloads.registry import query

NOW = 946_684_800  # 2000-01-01, the moment the registered queries look at the history
_R = "v_results"
LIVE = f", lv AS (SELECT * FROM v_results WHERE ttl IS NULL OR {NOW} - created <= ttl)\n"
LATEST = """, up AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY created DESC, write_id DESC) AS rn FROM v_results) x WHERE rn = 1)
"""


def accessed(spark, sf):
    """The latest result of every key with the time of its last read or write."""
    stored = view(spark, sf, _R)
    latest = re_.upsert_results(stored, stored.limit(0))
    reads = view(spark, sf, "v_task_refs").select(F.col("cache_key").alias("key"), "at_s")
    return re_.last_access(latest, reads)


@query("result_keys", "v_statements", """
  SELECT unit_id, sha256('dialect=' || dialect || '|domain=analysis|lint_ruleset_version=1|schema_hash=|schema_model_version=1|sql_hash=' || sha256(sql)) AS analysis_key,
    sha256('dialect=' || dialect || '|domain=security|files=|input_mode=sql|resolved_role=' || input_role || '|security_ruleset_version=1|sql_hash=' || sha256(sql)) AS security_key
  FROM v_statements""")
def result_keys(spark, sf):
    fingerprint = re_.text_hash(F.col("sql"))
    return view(spark, sf, "v_statements").select(
        "unit_id",
        re_.result_key("analysis", sql_hash=fingerprint, dialect=F.col("dialect")).alias("analysis_key"),
        re_.result_key("security", input_mode="sql", sql_hash=fingerprint, dialect=F.col("dialect"),
                       resolved_role=F.col("input_role")).alias("security_key"),
    )


_SHORT = 70_000_000


@query("pending_work", _R, f""", lv AS (SELECT * FROM v_results WHERE {NOW} - created <= {_SHORT})
  SELECT 'k' || c_custkey AS key, c_custkey FROM customer WHERE 'k' || c_custkey NOT IN (SELECT key FROM lv)""")
def pending_work(spark, sf):
    inputs = table(spark, sf, "customer").select(F.concat(F.lit("k"), F.col("c_custkey").cast("string")).alias("key"), "c_custkey")
    return re_.pending_work(inputs, re_.live_results(view(spark, sf, _R), NOW, ttl=_SHORT))


@query("live_results", _R, LIVE + "SELECT key, write_id, ttl FROM lv")
def live_results(spark, sf):
    return re_.live_results(view(spark, sf, _R), NOW).select("key", "write_id", "ttl")


@query("retain_by_count", _R, "SELECT key, write_id FROM v_results ORDER BY created DESC, write_id DESC LIMIT 4096")
def retain_by_count(spark, sf):
    return re_.retain_by_count(view(spark, sf, _R), 4096).select("key", "write_id")


@query("retain_by_size", "v_results v_task_refs", LATEST + """, rd AS (
  SELECT cache_key AS key, max(at_s) AS r FROM v_task_refs GROUP BY 1), la AS (
  SELECT key, write_id, size, greatest(created, coalesce(r, created)) AS last_access FROM up LEFT JOIN rd USING (key))
  SELECT key, write_id, running FROM (SELECT *, CAST(sum(size) OVER (ORDER BY last_access DESC, write_id DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM la) x
  WHERE running <= 50000000""")
def retain_by_size(spark, sf):
    """The most recently read or written results that fit."""
    return re_.retain_by_size(accessed(spark, sf), 50_000_000, "last_access", "running").select("key", "write_id", "running")


@query("reject_poisoned", _R, """
  SELECT write_id, contains(value, '"rows"') AS valid FROM v_results""")
def reject_poisoned(spark, sf):
    return re_.reject_poisoned(view(spark, sf, _R)).select("write_id", "valid")


@query("upsert_results", _R, LATEST + "SELECT key, write_id, domain, value FROM up")
def upsert_results(spark, sf):
    stored = view(spark, sf, _R)
    return re_.upsert_results(stored.filter("write_id % 2 = 0"), stored.filter("write_id % 2 = 1")).select(
        "key", "write_id", "domain", "value")


@query("last_access", "v_results v_task_refs", LATEST + """, rd AS (
  SELECT cache_key AS key, max(at_s) AS r FROM v_task_refs GROUP BY 1)
  SELECT key, write_id, greatest(created, coalesce(r, created)) AS last_access FROM up LEFT JOIN rd USING (key)""")
def last_access(spark, sf):
    return accessed(spark, sf).select("key", "write_id", "last_access")


@query("hit_rate", _R, f"""
  SELECT domain, count(*) FILTER (f AND v) AS hits, count(*) FILTER (NOT f) AS stale, count(*) FILTER (f AND NOT v) AS misses, count(*) AS lookups
  FROM (SELECT domain, ttl IS NULL OR {NOW} - created <= ttl AS f, contains(value, '"rows"') AS v FROM v_results) x GROUP BY domain""")
def hit_rate(spark, sf):
    return re_.hit_rate(view(spark, sf, _R), NOW)


_T = "v_task_refs"
_TTL = 86_400


# the next creation of a task is its first use later than the last creation plus the time to live
def _creations() -> str:
    body = oracle(_T, "SELECT task_id, at_s FROM v_task_refs")
    return f"""WITH RECURSIVE u AS MATERIALIZED ({body}), c AS (
      SELECT task_id, min(at_s) AS created FROM u GROUP BY task_id
      UNION ALL
      SELECT c.task_id, (SELECT min(u.at_s) FROM u WHERE u.task_id = c.task_id AND u.at_s - c.created > {_TTL}) AS created
      FROM c WHERE EXISTS (SELECT 1 FROM u WHERE u.task_id = c.task_id AND u.at_s - c.created > {_TTL}))
      SELECT task_id, created FROM c"""


@query("active_tasks", "", _creations())
def active_tasks(spark, sf):
    return ta.active_tasks(view(spark, sf, _T), _TTL)


@query("task_refs", _T, """
  SELECT task_id, cache_key, at_s, event_id, artifact_type FROM (SELECT *, row_number() OVER (PARTITION BY task_id, cache_key ORDER BY at_s, event_id) AS rn
    FROM v_task_refs) x WHERE rn = 1""")
def task_refs(spark, sf):
    return ta.task_refs(view(spark, sf, _T))


@query("resolve_refs", "v_task_refs v_results", f""", fr AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task_id, cache_key ORDER BY at_s, event_id) AS rn FROM v_task_refs) x WHERE rn = 1), up AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY created DESC, write_id DESC) AS rn FROM v_results) x
  WHERE rn = 1 AND (ttl IS NULL OR {NOW} - created <= ttl)), j AS (
  SELECT fr.*, up.key IS NOT NULL AS live, up.value FROM fr LEFT JOIN up ON up.key = fr.cache_key), o AS (
  SELECT *, row_number() OVER (PARTITION BY task_id, artifact_type ORDER BY live DESC, at_s DESC, event_id DESC) AS pick FROM j)
  SELECT task_id, artifact_type, max(cache_key) FILTER (pick = 1 AND live) AS cache_key, max(value) FILTER (pick = 1 AND live) AS value,
    count(*) FILTER (NOT live) AS dangling FROM o GROUP BY task_id, artifact_type""")
def resolve_refs(spark, sf):
    stored = view(spark, sf, _R)
    live = re_.live_results(re_.upsert_results(stored, stored.limit(0)), NOW)
    return ta.resolve_refs(ta.task_refs(view(spark, sf, _T)), live)


_E = "v_tool_events"
_NAMES = ("cache_hits", "click", "error", "explain_failures", "purchase", "signup", "view")


@query("counters", _E, "SELECT name, CAST(sum(n) AS BIGINT) AS value FROM v_tool_events GROUP BY name")
def counters(spark, sf):
    return ta.counters(view(spark, sf, _E))


@query("counter_projection", _E, f"""
  SELECT k.name, CAST(coalesce(sum(n), 0) AS BIGINT) AS value FROM v_tool_events e RIGHT JOIN (VALUES {', '.join(f"('{n}')" for n in _NAMES)}) k(name) USING (name) GROUP BY k.name""")
def counter_projection(spark, sf):
    return ta.counter_projection(ta.counters(view(spark, sf, _E)), _NAMES)


@query("redact_fields", _E, """
  SELECT event_id, '<redacted>' AS token, '<redacted>' AS url, 'DB_URL' AS env, CAST(event_id % 9 AS VARCHAR) AS k FROM v_tool_events""")
def redact_fields(spark, sf):
    return ta.redact_fields(view(spark, sf, _E)).select(
        "event_id", F.col("fields")["token"].alias("token"), F.col("fields")["url"].alias("url"),
        F.col("fields")["database_url_env"].alias("env"), F.col("fields")["k"].alias("k"))


@query("usage_by_user_window", _E, """
  SELECT event_id, user_id, lag(at_s) OVER w AS prev_at, lead(at_s) OVER w AS next_at, row_number() OVER w AS running,
    coalesce(at_s - lag(at_s) OVER w > 3600, true) AS session_start, CAST(ntile(4) OVER w AS INT) AS quartile
  FROM v_tool_events WINDOW w AS (PARTITION BY user_id ORDER BY at_s, event_id)""")
def usage_by_user_window(spark, sf):
    return ta.usage_by_user_window(view(spark, sf, _E))
