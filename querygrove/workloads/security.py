"""Queries of the security rules (survey group C, first half)."""

from __future__ import annotations

from pyspark.sql import functions as F

from querygrove import refdata
from querygrove.operators import security as op
from querygrove.prims import joined
from querygrove.sources.views import view
from querygrove.workloads.duck import FINDINGS
from querygrove.workloads.errors import sql_text
from querygrove.workloads.registry import query

_U = "v_units"


@query("resolve_units", "v_files", r"""
  SELECT path AS unit_id, CASE WHEN ends_with(path, '.py') THEN 'python_source' ELSE 'sql' END AS input_kind,
    CASE WHEN regexp_matches(name, '^[0-9]+_.*\.sql$') OR regexp_matches(name, '^V[0-9]+__.*\.sql$', 'i') OR ends_with(name, '.migration.sql')
      THEN 'migration' ELSE 'script' END AS input_role FROM v_files""")
def resolve_units(spark, sf):
    return op.resolve_units(view(spark, sf, "v_files")).drop("content")


_RULES = ", ".join(f"({sql_text(r[0])}, {sql_text(r[4])}, {sql_text(r[5])}, {str(r[6]).lower()})" for r in refdata.SECURITY_RULES)
COVERAGE = f""", rl(rule_id, kind, roles, dia) AS (VALUES {_RULES}), cov AS (
  SELECT unit_id, repo, rule_id, CASE WHEN kind <> input_kind THEN 'input_kind_mismatch'
    WHEN NOT list_contains(string_split(roles, ','), input_role) THEN 'input_role_mismatch'
    WHEN dia AND dialect = 'unknown' THEN 'dialect_mismatch' END AS reason FROM v_units CROSS JOIN rl), cv AS (
  SELECT *, CASE WHEN reason IS NULL THEN 'evaluated' WHEN reason = 'dialect_mismatch' THEN 'skipped' ELSE 'not_applicable' END AS status FROM cov)
"""


@query("rule_coverage", _U, COVERAGE + "SELECT unit_id, rule_id, status, reason FROM cv")
def rule_coverage(spark, sf):
    return op.rule_coverage(view(spark, sf, _U)).drop("repo")


def found(spark, sf):
    return op.findings(view(spark, sf, _U))


_MESSAGES = {
    "SEC-001": "Detected potentially unsafe dynamic SQL construction (f-string interpolation with SQL keywords).",
    "SEC-002": "Detected potentially unsafe dynamic SQL construction (string concatenation with SQL keywords).",
    "SEC-003": None,
    "SEC-004": "TRUNCATE TABLE (destructive data operation — removes all rows).",
    "SEC-005": "DELETE without WHERE clause (unbounded deletion).",
    "SEC-006": "UPDATE without WHERE clause (unbounded update).",
    "SEC-007": "DROP TABLE in migration context (irreversible — data loss cannot be rolled back after migration applies).",
    "SEC-008": None,
    "SEC-009": "EXECUTE statement detected. Verify the SQL is not dynamically constructed from untrusted input.",
}
_SPECIAL = {
    "SEC-003": "'DROP TABLE (destructive schema operation)' || CASE WHEN contains(note, 'IF EXISTS') THEN ' — IF EXISTS present (suppresses error, does not prevent destruction)' ELSE '' END",
    "SEC-008": "'ALTER TABLE DROP COLUMN ' || note || ' (data loss — column data is destroyed).'",
}
_KEYS = ("sec_001", "sec_002", "sec_003", "sec_004", "sec_005", "sec_006", "sec_007", "sec_008", "sec_009")


def _register(key: str, rule_id: str) -> None:
    message = _SPECIAL.get(rule_id) or sql_text(_MESSAGES[rule_id])

    @query(key, _U, FINDINGS + f"SELECT unit_id, rule_id, severity, line, {message} AS message FROM fnd WHERE rule_id = '{rule_id}'")
    def run(spark, sf):
        # only the units a rule applies to are looked at
        units = view(spark, sf, _U)
        part = op.source_findings(units) if rule_id in ("SEC-001", "SEC-002") else op.statement_findings(units)
        severity = next(r[2] for r in refdata.SECURITY_RULES if r[0] == rule_id)
        return part.filter(F.col("rule_id") == rule_id).select("unit_id", "rule_id", F.lit(severity).alias("severity"), "line", "message")


for _key in _KEYS:
    _register(_key, _key.upper().replace("_", "-"))


@query("dynamic_execute_calls", "v_source", """
  SELECT unit_id, g.line_no, g.method FROM v_source JOIN (VALUES (0, -1, 3, 'execute'), (1, -1, 3, 'execute'), (4, -1, 3, 'executemany'), (5, -1, 3, 'execute'),
    (7, 2, 5, 'execute'), (7, 3, 2, 'execute'), (7, 3, 2, 'executemany')) g(t, u, line_no, method)
    ON p_partkey % 8 = g.t AND (u = -1 OR (p_partkey // 8) % 4 = u)""")
def dynamic_execute_calls(spark, sf):
    return op.dynamic_execute_calls(view(spark, sf, "v_source"))


@query("parameterized_files", "v_source", "SELECT unit_id, p_partkey % 8 IN (1, 2, 5) AS safe FROM v_source")
def parameterized_files(spark, sf):
    return op.parameterized_files(view(spark, sf, "v_source"))


@query("ranked_findings", _U, FINDINGS + """, rk AS (
  SELECT *, row_number() OVER (PARTITION BY repo ORDER BY stmt_idx, line, rule_id, unit_id, note) AS rank FROM fnd)
  SELECT repo, rank, unit_id, stmt_idx, line, rule_id FROM rk WHERE rank <= 10""")
def ranked_findings(spark, sf):
    return op.ranked_findings(found(spark, sf), cap=10).select("repo", "rank", "unit_id", "stmt_idx", "line", "rule_id")


@query("security_scan", _U, FINDINGS + COVERAGE.replace(", rl(", ", rl(", 1) + """, ro AS (
  SELECT repo, count(*) AS units, CASE WHEN count(DISTINCT input_role) > 1 THEN 'mixed' ELSE min(input_role) END AS role FROM v_units GROUP BY repo), fs AS (
  SELECT repo, count(*) AS found, count(*) FILTER (severity = 'high') AS high, string_agg(DISTINCT rule_id, '|' ORDER BY rule_id) AS rules FROM fnd GROUP BY repo), rk AS (
  SELECT *, row_number() OVER (PARTITION BY repo ORDER BY stmt_idx, line, rule_id, unit_id, note) AS rank FROM fnd), fl AS (
  SELECT repo, string_agg(unit_id || ':' || stmt_idx || ':' || line || ':' || rule_id || ':' || severity, '|' ORDER BY rank) AS findings FROM rk WHERE rank <= 10 GROUP BY repo), cs AS (
  SELECT repo, count(*) FILTER (status = 'evaluated') AS evaluated, count(*) FILTER (status = 'skipped') AS skipped,
    count(*) FILTER (status = 'not_applicable') AS not_applicable FROM cv GROUP BY repo)
  SELECT ro.repo, units, evaluated, skipped, not_applicable, coalesce(found, 0) AS found, coalesce(high, 0) AS high, coalesce(rules, '') AS rules,
    role AS input_role_resolved, coalesce(found, 0) > 10 AS truncated, greatest(coalesce(found, 0) - 10, 0) AS suppressed_count, '1' AS ruleset_version,
    coalesce(findings, '') AS findings
  FROM ro JOIN cs USING (repo) LEFT JOIN fs USING (repo) LEFT JOIN fl USING (repo)""")
def security_scan(spark, sf):
    listed = F.array_join(F.transform("findings", lambda f: F.concat_ws(
        ":", f["unit_id"].cast("string"), f["stmt_idx"].cast("string"), f["line"].cast("string"), f["rule_id"], f["severity"])), "|")
    return op.security_scan(view(spark, sf, _U), cap=10).withColumn("rules", joined("rules")).withColumn("findings", listed)


@query("severity_rollup", _U, FINDINGS + """
  SELECT 'severity' AS report, severity AS a, rule_id AS b, count(*) AS n, CAST(GROUPING(severity) * 2 + GROUPING(rule_id) AS BIGINT) AS gid
  FROM fnd GROUP BY ROLLUP (severity, rule_id)
  UNION ALL SELECT 'role', rule_id, input_role, count(*), CAST(GROUPING(rule_id) * 2 + GROUPING(input_role) AS BIGINT) FROM fnd GROUP BY CUBE (rule_id, input_role)""")
def severity_rollup(spark, sf):
    return op.severity_rollup(found(spark, sf))
