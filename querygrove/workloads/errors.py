"""Queries over error logs (survey group F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from querygrove import refdata
from querygrove.operators import errors as op
from querygrove.sources.views import view
from querygrove.workloads.registry import query


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_ROWS = ", ".join(
    f"({n}, {', '.join(sql_text(x) for x in row[:6])}, {row[6]})" for n, row in enumerate(refdata.ERROR_CATALOG, 1)
)
CATALOG = f""", cat(ordinal, catalog_id, pattern, scope, diagnosis, fix_guidance, severity, specificity) AS (VALUES {_ROWS})
"""
MATCHES = CATALOG + """, acc AS (
  SELECT *, CASE WHEN regexp_matches(error_text, '\\S') THEN 'text' ELSE 'blank' END AS input_kind FROM v_errors), m AS (
  SELECT acc.event_id, acc.user_id, acc.at_s, cat.* FROM acc JOIN cat ON cat.scope IN ('any', acc.dialect)
    AND regexp_matches(acc.error_text, cat.pattern, 'i')), rk AS (
  SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY specificity DESC, ordinal) AS rank,
    rank() OVER (PARTITION BY event_id ORDER BY specificity DESC) AS tie_rank,
    dense_rank() OVER (PARTITION BY event_id ORDER BY specificity DESC) AS tie_dense_rank,
    count(*) OVER (PARTITION BY event_id) AS total FROM m)
"""


def errors_of(spark, sf):
    return view(spark, sf, "v_errors")


@query("match_errors", "v_errors", MATCHES + "SELECT event_id, catalog_id, severity, specificity, diagnosis, fix_guidance FROM m")
def match_errors(spark, sf):
    return op.match_errors(errors_of(spark, sf)).select("event_id", "catalog_id", "severity", "specificity", "diagnosis", "fix_guidance")


@query("ranked_matches", "v_errors", MATCHES + "SELECT event_id, catalog_id, rank, tie_rank, tie_dense_rank FROM rk")
def ranked_matches(spark, sf):
    return op.ranked_matches(errors_of(spark, sf)).select("event_id", "catalog_id", "rank", "tie_rank", "tie_dense_rank")


@query("capped_matches", "v_errors", MATCHES + """
  SELECT event_id, catalog_id, rank, greatest(total - 1, 0) AS suppressed_count, total > 1 AS truncated FROM rk WHERE rank <= 1""")
def capped_matches(spark, sf):
    return op.capped_matches(errors_of(spark, sf), cap=1).select("event_id", "catalog_id", "rank", "suppressed_count", "truncated")


@query("unmatched_errors", "v_errors", MATCHES + """
  SELECT event_id, error_text, input_kind FROM acc WHERE event_id NOT IN (SELECT event_id FROM m WHERE specificity >= 2)""")
def unmatched_errors(spark, sf):
    return op.unmatched_errors(errors_of(spark, sf)).select("event_id", "error_text", "input_kind")


PROFILE = """
  SELECT severity, catalog_id, day, count(*) AS n, count(DISTINCT user_id) AS users,
    CAST(GROUPING(severity) * 4 + GROUPING(catalog_id) * 2 + GROUPING(day) AS BIGINT) AS gid
  FROM (SELECT severity, catalog_id, user_id, CAST(floor(at_s / 86400) AS BIGINT) AS day FROM m) x
  GROUP BY GROUPING SETS ((), (severity), (severity, catalog_id), (severity, catalog_id, day))"""


@query("error_profile", "v_errors", MATCHES + PROFILE)
def error_profile(spark, sf):
    return op.error_profile(errors_of(spark, sf)).select("severity", "catalog_id", "day", "n", "users", F.col("gid").cast("long").alias("gid"))


@query("error_profile_approx", "v_errors", MATCHES + f"SELECT severity, catalog_id, day, n, true AS within_bound FROM ({PROFILE}) p")
def error_profile_approx(spark, sf):
    """Is the estimate of distinct users within three standard errors (of 1 %) of the exact count?"""
    bound = F.greatest(F.lit(1.0), 0.03 * F.col("users"))
    return op.error_profile(errors_of(spark, sf)).select(
        "severity", "catalog_id", "day", "n", (F.abs(F.col("approx_users") - F.col("users")) <= bound).alias("within_bound"))


@query("top_diagnosis_per_day", "v_errors", MATCHES + """
  SELECT CAST(floor(at_s / 86400) AS BIGINT) AS day, catalog_id, count(*) AS n FROM rk WHERE rank = 1 GROUP BY ALL""")
def top_diagnosis_per_day(spark, sf):
    best = op.best_match(errors_of(spark, sf))
    return best.groupBy(F.floor(F.col("at_s") / 86_400).cast("long").alias("day"), "catalog_id").agg(F.count(F.lit(1)).alias("n"))
