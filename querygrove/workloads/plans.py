"""Queries over captured plans (survey group E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from querygrove.plans import captured as op
from querygrove.prims import joined
from querygrove.sources.views import view
from querygrove.workloads.registry import query

_P = "v_plans"
#: The same plans in node form: path, depth and preorder of line n of an order.
NODES = """, nd AS (
  SELECT *, CASE WHEN n = 1 THEN '' WHEN n <= 7 THEN CASE n WHEN 2 THEN '0' WHEN 3 THEN '1' WHEN 4 THEN '0.0' WHEN 5 THEN '0.1' WHEN 6 THEN '1.0' ELSE '1.1' END
      ELSE '1.1.' || CAST(n - 8 AS VARCHAR) END AS path,
    CASE WHEN n = 1 THEN 1 WHEN n <= 3 THEN 2 WHEN n <= 7 THEN 3 ELSE 4 END AS depth,
    CASE n WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 4 THEN 2 WHEN 5 THEN 3 WHEN 3 THEN 4 WHEN 6 THEN 5 ELSE n - 1 END AS ord
  FROM v_plan_lines WHERE query_id % 50 NOT IN (7, 8, 9, 10)), pn AS (
  SELECT query_id, path, depth, CAST(row_number() OVER (PARTITION BY query_id ORDER BY ord) - 1 AS INT) AS preorder, op,
    CASE WHEN op IN ('Seq Scan', 'Index Scan') THEN relation END AS relation, CASE WHEN op = 'Index Scan' THEN 'i_' || relation END AS index,
    cost + 0.25::DOUBLE AS total_cost, n_rows, CASE WHEN n % 4 = 0 THEN NULL ELSE 8 END AS width, lit FROM nd)
"""


def good(spark, sf):
    return op.good_plans(view(spark, sf, _P))


def nodes(spark, sf, **bounds):
    return op.plan_nodes(good(spark, sf), **bounds)


@query("plan_ingest", _P, """
  SELECT query_id, CASE query_id % 50 WHEN 7 THEN 'invalid_json' WHEN 8 THEN 'unexpected_structure' WHEN 9 THEN 'missing_plan' WHEN 10 THEN 'missing_plan' END AS error,
    CASE WHEN query_id % 3 = 0 AND query_id % 50 NOT IN (7, 8, 9, 10) THEN 0.5::DOUBLE END AS planning_time FROM v_plans""")
def plan_ingest(spark, sf):
    return op.plan_ingest(view(spark, sf, _P)).select(
        "query_id", "error", F.when(F.col("error").isNull(), op.planning_time(F.col("doc"))).alias("planning_time"))


@query("plan_nodes", _P, NODES + "SELECT query_id, preorder, path, depth, op, relation, index, total_cost, n_rows, width FROM pn")
def plan_nodes(spark, sf):
    return nodes(spark, sf).filter("kept").select(
        "query_id", "preorder", F.array_join(F.col("path").cast("array<string>"), ".").alias("path"), "depth", "op", "relation", "index",
        "total_cost", "n_rows", "width")


@query("plan_bounds", _P, NODES + """, k AS (SELECT *, preorder < 4 AND depth <= 2 AS kept FROM pn WHERE depth <= 3), c AS (
  SELECT k.*, coalesce(p.kept, true) AS parent_kept FROM k LEFT JOIN k p ON p.query_id = k.query_id AND k.path <> '' AND p.path = CASE WHEN contains(k.path, '.')
    THEN regexp_replace(k.path, '\\.[0-9]+$', '') ELSE '' END)
  SELECT query_id, count(*) FILTER (kept) AS nodes, count(*) FILTER (NOT kept AND parent_kept) AS nodes_suppressed,
    bool_or(NOT kept AND parent_kept) AS truncated, NULL AS error FROM c GROUP BY query_id""")
def plan_bounds(spark, sf):
    return op.plan_bounds(good(spark, sf), max_nodes=4, max_depth=2).select(
        "query_id", "nodes", "nodes_suppressed", "truncated", "error")


@query("plan_conditions", _P, NODES + """
  SELECT query_id, preorder, 0 AS ordinal, 'index_cond' AS kind, '(id = "<number>")' AS expression FROM pn WHERE op = 'Index Scan'
  UNION ALL SELECT query_id, preorder, 0, 'filter', '(a = "<string>")' FROM pn WHERE op = 'Seq Scan'
  UNION ALL SELECT query_id, preorder, 1, 'filter', '(b > "<number>")' FROM pn WHERE op = 'Seq Scan'
  UNION ALL SELECT query_id, preorder, 0, 'hash_cond', '(x.id = y.id)' FROM pn WHERE op = 'Hash Join'""")
def plan_conditions(spark, sf):
    return op.plan_conditions(nodes(spark, sf))


@query("redact_literals", "v_documents", """
  SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN '<redacted-unparsed-expression>'
    ELSE '(note = "<string>" AND n = "<number>" AND lang <> col_1 AND price >= "<number>")' END AS expression FROM v_documents""")
def redact_literals(spark, sf):
    return view(spark, sf, "v_documents").select("doc_id", op.redact_literals(F.col("expression")).alias("expression"))


@query("plan_settings", _P, """
  SELECT query_id, CAST(query_id % 64 AS VARCHAR) || 'MB' AS work_mem, 'off' AS jit, 2 AS kept FROM v_plans WHERE query_id % 50 NOT IN (7, 8, 9, 10)""")
def plan_settings(spark, sf):
    return op.plan_settings(good(spark, sf)).select(
        "query_id", F.col("settings")["work_mem"].alias("work_mem"), F.col("settings")["jit"].alias("jit"), F.size("settings").alias("kept"))


SUMMARY = NODES + """, sm AS (
  SELECT query_id, max(op) FILTER (preorder = 0) AS root_op, max(relation) FILTER (preorder = 0) AS root_relation,
    max(total_cost) FILTER (preorder = 0) AS root_total_cost, max(n_rows) FILTER (preorder = 0) AS root_rows, count(*) AS node_count,
    coalesce(string_agg(op, '|' ORDER BY preorder) FILTER (contains(op, 'Scan')), '') AS scan_ops,
    coalesce(string_agg(op, '|' ORDER BY preorder) FILTER (op IN ('Hash Join', 'Nested Loop')), '') AS join_ops FROM pn GROUP BY query_id)
"""


@query("plan_summary", _P, SUMMARY + "SELECT * FROM sm")
def plan_summary(spark, sf):
    return op.plan_summary(good(spark, sf)).drop("truncated").withColumn("scan_ops", joined("scan_ops")).withColumn("join_ops", joined("join_ops"))


DELTA = """, dl AS (
  SELECT query_id, relation, round(candidate_cost - original_cost, 6) AS cost_delta,
    CASE WHEN original_cost > 0 THEN round((candidate_cost - original_cost) / original_cost * 100.0, 6) END AS cost_delta_pct,
    candidate_rows - original_rows AS rows_delta,
    coalesce(original_rows > 0 AND candidate_rows > 0 AND abs(candidate_rows - original_rows) / original_rows::DOUBLE > 0.1, false) AS cardinality_changed
  FROM v_plan_pairs)
"""


def deltas(spark, sf):
    return op.plan_delta(view(spark, sf, "v_plan_pairs")).withColumn("cost_delta", F.round("cost_delta", 6)).withColumn(
        "cost_delta_pct", F.round("cost_delta_pct", 6))


@query("plan_delta", "v_plan_pairs", DELTA + "SELECT query_id, cost_delta, cost_delta_pct, rows_delta, cardinality_changed FROM dl")
def plan_delta(spark, sf):
    return deltas(spark, sf).select("query_id", "cost_delta", "cost_delta_pct", "rows_delta", "cardinality_changed")


ELIGIBLE = """, el AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY candidate_id) AS position FROM v_candidates
    WHERE validation_status = 'validated' AND security_status <> 'withheld' AND NOT starts_with(sql, 'DELETE') AND NOT contains(sql, 'FOR UPDATE')) x WHERE position <= 5)
"""
ATTACHED = ELIGIBLE + """, at AS (
  SELECT c.query_id, c.candidate_id, el.position IS NOT NULL AS eligible, el.position IS NOT NULL AND c.failure IS NULL AND p.original_cost IS NOT NULL AS planned,
    c.candidate_cost - p.original_cost AS delta, CASE WHEN el.position IS NOT NULL AND p.original_cost IS NOT NULL THEN c.failure END AS runtime_failure,
    coalesce(p.original_rows > 0 AND c.candidate_rows > 0 AND abs(c.candidate_rows - p.original_rows) / p.original_rows::DOUBLE > 0.1, false) AS changed
  FROM v_candidates c LEFT JOIN el USING (query_id, candidate_id) LEFT JOIN v_plan_pairs p ON p.query_id = c.query_id)
""".replace(", at AS", ", ev AS")


@query("eligible_candidates", "v_candidates", ELIGIBLE + "SELECT query_id, candidate_id, position, sql FROM el")
def eligible_candidates(spark, sf):
    return op.eligible_candidates(view(spark, sf, "v_candidates"), 5).select("query_id", "candidate_id", "position", "sql")


def attached(spark, sf):
    return op.attach_plan_evidence(view(spark, sf, "v_candidates"), view(spark, sf, "v_plan_pairs"), 5)


@query("attach_plan_evidence", "v_candidates v_plan_pairs", ATTACHED + """
  SELECT query_id, candidate_id, eligible, CASE WHEN planned THEN 'runtime' ELSE 'schema' END AS evidence, CASE WHEN planned THEN delta END AS cost_delta,
    runtime_failure, CAST(planned AND changed AS INT) AS notes FROM ev""")
def attach_plan_evidence(spark, sf):
    return attached(spark, sf).select("query_id", "candidate_id", "eligible", "evidence", "cost_delta", "runtime_failure",
                                      F.size("preconditions").alias("notes"))


@query("evidence_status", "v_candidates v_plan_pairs", ATTACHED + """, st AS (
  SELECT query_id, count(*) FILTER (eligible) AS eligible, count(*) FILTER (planned) AS verified FROM ev GROUP BY query_id)
  SELECT p.query_id, coalesce(eligible, 0) AS eligible, coalesce(verified, 0) AS verified, CASE WHEN p.query_id % 9 = 0 THEN 'unavailable' WHEN original_cost IS NULL THEN 'failed'
    WHEN coalesce(eligible, 0) = coalesce(verified, 0) THEN 'available' ELSE 'partial' END AS status FROM v_plan_pairs p LEFT JOIN st USING (query_id)""")
def evidence_status(spark, sf):
    originals = view(spark, sf, "v_plan_pairs").withColumn("admitted", F.col("query_id") % 9 != 0)
    return op.evidence_status(attached(spark, sf), originals)


@query("plan_regressions", "v_plan_pairs v_plans", NODES + DELTA + """, w AS (
  SELECT 'worst' AS report, CAST(query_id AS VARCHAR) AS subject, cost_delta_pct AS value FROM dl WHERE cost_delta_pct IS NOT NULL ORDER BY cost_delta_pct DESC, query_id LIMIT 20)
  SELECT * FROM w UNION ALL SELECT 'seq_share', relation, round(count(*) FILTER (op = 'Seq Scan') / count(*)::DOUBLE, 6) FROM pn WHERE contains(op, 'Scan') GROUP BY relation""")
def plan_regressions(spark, sf):
    worst, shares = op.plan_regressions(view(spark, sf, "v_plan_pairs"), nodes(spark, sf))
    return worst.select(F.lit("worst").alias("report"), F.col("query_id").cast("string").alias("subject"),
                        F.round("cost_delta_pct", 6).alias("value")).unionByName(
        shares.select(F.lit("seq_share").alias("report"), F.col("relation").alias("subject"), F.col("seq_share").alias("value")))


@query("plan_report", _P, SUMMARY + """, nl AS (
  SELECT query_id, string_agg(concat_ws(':', preorder, path, depth, op, relation, index, n_rows, width), '|' ORDER BY preorder) AS nodes FROM pn GROUP BY query_id)
  SELECT coalesce(nl.nodes, '') AS nodes, p.query_id, sha256(plan_json) AS fingerprint, CASE p.query_id % 50 WHEN 7 THEN 'invalid_json' WHEN 8 THEN 'unexpected_structure' WHEN 9 THEN 'missing_plan' WHEN 10 THEN 'missing_plan' END AS error,
    CASE WHEN p.query_id % 3 = 0 AND sm.query_id IS NOT NULL THEN 0.5::DOUBLE END AS planning_time_ms, sm.root_op, sm.root_total_cost, sm.node_count
  FROM v_plans p LEFT JOIN sm USING (query_id) LEFT JOIN nl USING (query_id)""")
def plan_report(spark, sf):
    def text(node):
        path = F.array_join(node["path"].cast("array<string>"), ".")
        return F.concat_ws(":", node["preorder"].cast("string"), path, node["depth"].cast("string"), node["op"], node["relation"],
                           node["index"], node["n_rows"].cast("string"), node["width"].cast("string"))

    nodes = F.coalesce(F.array_join(F.transform("nodes", text), "|"), F.lit("")).alias("nodes")
    return op.plan_report(view(spark, sf, _P)).select(
        nodes, "query_id", "fingerprint", "error", "planning_time_ms", "root_op", "root_total_cost", "node_count")
