"""Queries for the composite reports (survey groups C, E, F and I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from querygrove.operators import errors as er
from querygrove.operators import reports as op
from querygrove.operators import rewrite as rw
from querygrove.plans.captured import redact_literals
from querygrove.prims import joined
from querygrove.workloads.duck import FINDINGS
from querygrove.workloads.errors import MATCHES, errors_of
from querygrove.workloads.lint import CROSS, FACTS, IMPACT, LINT, STARS, catalogue, failing_statements, statements
from querygrove.workloads.registry import query


@query("analyze_sql", "v_statements", FACTS + LINT + """, fa AS (
  SELECT unit_id, string_agg(value, '|' ORDER BY i) FILTER (fact_kind = 'table') AS tables, string_agg(value, '|' ORDER BY i) FILTER (fact_kind = 'column') AS columns,
    string_agg(value, '|' ORDER BY i) FILTER (fact_kind = 'join') AS joins, string_agg(value, '|' ORDER BY i) FILTER (fact_kind = 'predicate') AS predicates FROM fx GROUP BY unit_id), lr AS (
  SELECT unit_id, string_agg(rule_id, '|' ORDER BY rule_id) AS lint_rules FROM lx GROUP BY unit_id)
  SELECT v.unit_id, CASE WHEN v.unit_id % 32 IN (23, 29) THEN 0 ELSE 1 END AS statements, CASE WHEN v.unit_id % 32 IN (23, 29) THEN 'parse_error' END AS kind,
    coalesce(tables, '') AS tables, coalesce(columns, '') AS columns, coalesce(joins, '') AS joins, coalesce(predicates, '') AS predicates,
    coalesce(lint_rules, '') AS lint_rules, false AS truncated FROM v_statements v LEFT JOIN fa USING (unit_id) LEFT JOIN lr USING (unit_id)""")
def analyze_sql(spark, sf):
    report = op.analyze_sql(statements(spark, sf), *catalogue(spark, sf))
    for name in ("tables", "columns", "joins", "predicates", "lint_rules"):
        report = report.withColumn(name, joined(name))
    return report


@query("optimize_report", "v_statements", LINT + STARS + """, e AS (
  SELECT unit_id, 'finding' AS entry, rule_id, row_number() OVER (PARTITION BY unit_id ORDER BY rule_id) AS rank, NULL AS sql2 FROM lx
  UNION ALL SELECT unit_id, 'candidate', 'select_star_expansion', 1, rewritten_sql FROM se WHERE validation_status = 'validated')
  SELECT unit_id, entry, rule_id, rank, coalesce(sql2, '') AS rewritten_sql FROM e WHERE rank <= 1""")
def optimize_report(spark, sf):
    report = op.optimize_report(statements(spark, sf), *catalogue(spark, sf), max_findings=1)
    return report.select("unit_id", "entry", "rule_id", "rank",
                         F.when(F.col("entry") == "candidate", F.col("value")).otherwise("").alias("rewritten_sql"))



@query("refactor_report", "v_statements v_units", FINDINGS + LINT + STARS + IMPACT + """, a AS (
  SELECT CAST(unit_id AS BIGINT) AS unit_id, string_agg(DISTINCT rule_id, '|' ORDER BY rule_id) AS security_rules FROM fnd WHERE rule_id > 'SEC-002' GROUP BY 1), b AS (
  SELECT unit_id, string_agg(rule_id, '|' ORDER BY rule_id) AS lint_rules FROM lx GROUP BY 1), i AS (
  SELECT unit_id, string_agg(name, '|' ORDER BY name) FILTER (missing = 'table') AS missing_tables, string_agg(name, '|' ORDER BY name) FILTER (missing = 'column') AS missing_columns FROM ix GROUP BY 1)
  SELECT v.unit_id, coalesce(security_rules, '') AS security_rules, coalesce(lint_rules, '') AS lint_rules, coalesce(rewritten_sql, '') AS candidates,
    coalesce(missing_tables, '') AS missing_tables, coalesce(missing_columns, '') AS missing_columns
  FROM v_statements v LEFT JOIN a USING (unit_id) LEFT JOIN b USING (unit_id) LEFT JOIN se ON se.unit_id = v.unit_id LEFT JOIN i ON i.unit_id = v.unit_id""")
def refactor_report(spark, sf):
    report = op.refactor_report(statements(spark, sf), *catalogue(spark, sf))
    for name in ("security_rules", "lint_rules", "candidates", "missing_tables", "missing_columns"):
        report = report.withColumn(name, joined(name))
    return report


@query("proposed_changes", "v_statements v_units", FINDINGS + STARS + """, fx(rule_id, fix) AS (VALUES
  ('SEC-003', 'Review whether the table drop is intentional. Consider renaming or archiving instead.'),
  ('SEC-005', 'Add a WHERE clause to limit the scope of deletion.'), ('SEC-006', 'Add a WHERE clause to limit the scope of the update.'))
  SELECT CAST(unit_id AS BIGINT) AS unit_id, 1 AS rank, '[' || rule_id || '] ' || fix AS change, 0 AS suppressed_count, false AS truncated FROM fnd JOIN fx USING (rule_id)
  UNION ALL SELECT unit_id, 1, 'Apply rewrite: ' || rewritten_sql, 0, false FROM se WHERE validation_status = 'validated'""")
def proposed_changes(spark, sf):
    columns, _, warnings = catalogue(spark, sf)
    return op.proposed_changes(statements(spark, sf), columns, warnings)


# --- error triage with a schema -----------------------------------------------------------

IMPACTS = CROSS + """, im AS (
  SELECT event_id, string_agg(name, ', ' ORDER BY name) FILTER (missing = 'table') AS mt, string_agg(name, ', ' ORDER BY name) FILTER (missing = 'column') AS mc
  FROM cx WHERE event_id IN (SELECT event_id FROM acc) GROUP BY event_id)
"""
HYPOTHESES = IMPACTS + """, hy AS (
  SELECT event_id, 1 AS b, rank AS o, diagnosis AS statement, 'catalog' AS basis, fix_guidance AS next_diagnostic FROM rk
  UNION ALL SELECT event_id, 2, 1, 'The query references table(s) not present in the repo schema: ' || mt || '. The migration creating them may be missing or unapplied.',
    'schema', 'Check migration ordering and application state.' FROM im WHERE mt IS NOT NULL
  UNION ALL SELECT event_id, 3, 1, 'The query references column(s) not present in the repo schema: ' || mc || '.', 'schema', 'Verify column names against the repo DDL (analyze_sql).' FROM im WHERE mc IS NOT NULL), hr AS (
  SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY b, o) AS hrank FROM hy), nx AS (
  SELECT coalesce(g.event_id, i.event_id) AS event_id, concat_ws('|', g.steps, CASE WHEN i.mt IS NOT NULL THEN 'Run find_context to locate migrations for the missing tables.' END) AS steps
  FROM (SELECT event_id, string_agg(fix_guidance, '|' ORDER BY rank) AS steps FROM rk GROUP BY event_id) g
  FULL JOIN (SELECT * FROM im WHERE mt IS NOT NULL) i ON i.event_id = g.event_id)
"""


def impact(spark, sf):
    """Missing names per error; both lists are bounded by the statement."""
    found = rw.schema_cross_check(failing_statements(spark, sf), catalogue(spark, sf)[0])
    return found.groupBy(F.col("unit_id").alias("event_id")).agg(
        F.array_sort(F.collect_set(F.when(F.col("missing") == "table", F.col("name")))).alias("missing_tables"),
        F.array_sort(F.collect_set(F.when(F.col("missing") == "column", F.col("name")))).alias("missing_columns"))


@query("hypotheses", "v_errors", MATCHES + HYPOTHESES + "SELECT event_id, hrank AS rank, statement, basis, next_diagnostic FROM hr")
def hypotheses(spark, sf):
    return er.hypotheses(errors_of(spark, sf), impact(spark, sf)).select("event_id", "rank", "statement", "basis", "next_diagnostic")


@query("next_diagnostics", "v_errors", MATCHES + HYPOTHESES + "SELECT event_id, steps AS next_diagnostics FROM nx")
def next_diagnostics(spark, sf):
    return er.next_diagnostics(errors_of(spark, sf), impact(spark, sf)).withColumn("next_diagnostics", joined("next_diagnostics"))


@query("escalation_worklist", "v_errors", MATCHES + r""", op AS (
  SELECT event_id, regexp_replace(regexp_replace(error_text, '''[^'']*''', '"<string>"', 'g'), '(^|[^A-Za-z0-9_$.])([0-9]+(?:\.[0-9]+)?)', '\1"<number>"', 'g') AS prompt
  FROM acc WHERE event_id NOT IN (SELECT event_id FROM m WHERE specificity >= 2)), t AS (
  SELECT *, CAST(ceil(strlen(prompt) / 4.0) AS BIGINT) AS tokens FROM op), r AS (
  SELECT *, CAST(sum(tokens) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_tokens FROM t)
  SELECT event_id, prompt, tokens, running_tokens, CASE WHEN running_tokens > 5000 THEN 'budget_exhausted' ELSE 'pending' END AS status FROM r""")
def escalation_worklist(spark, sf):
    return er.escalation_worklist(er.unmatched_errors(errors_of(spark, sf)), redact_literals, 4000, total_budget=5000).drop("truncated")


@query("debug_report", "v_errors", MATCHES + HYPOTHESES + """, bm AS (
  SELECT event_id, string_agg(catalog_id, '|' ORDER BY rank) AS ms, max(specificity) AS best FROM rk GROUP BY event_id), hc AS (
  SELECT event_id, count(*) AS n, min_by(statement, hrank) AS top FROM hr GROUP BY event_id)
  SELECT acc.event_id, acc.dialect, acc.input_kind, coalesce(ms, '') AS catalog_matches, coalesce(n, 0) AS n_hypotheses, top AS top_hypothesis,
    coalesce(replace(mt, ', ', '|'), '') AS missing_tables, coalesce(replace(mc, ', ', '|'), '') AS missing_columns, coalesce(steps, '') AS next_diagnostics,
    coalesce(best, 0) >= 2 AS conclusive
  FROM acc LEFT JOIN bm USING (event_id) LEFT JOIN hc USING (event_id) LEFT JOIN im USING (event_id) LEFT JOIN nx USING (event_id)""")
def debug_report(spark, sf):
    report = er.debug_report(errors_of(spark, sf), impact(spark, sf))
    for name in ("catalog_matches", "missing_tables", "missing_columns", "next_diagnostics"):
        report = report.withColumn(name, joined(name))
    return report
