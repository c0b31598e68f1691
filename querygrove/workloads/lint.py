"""Queries over statement facts, lint rules and schema checks (survey groups B, C and D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from querygrove.operators import facts as fa
from querygrove.operators import lint as li
from querygrove.operators import rewrite as rw
from querygrove.sources.views import view
from querygrove.workloads.duck import by_template
from querygrove.workloads.registry import query

# Expected facts per statement template, names separated by commas.
TABLES = {
    0: "orders", 1: "customer", 2: "orders,customer", 3: "orders,lineitem", 4: "orders,recent", 5: "orders,gone",
    6: "orders,lineitem", 7: "orders", 8: "tmp_{k},orders", 9: "orders", 10: "orders", 11: "orders", 12: "orders",
    13: "orders", 14: "tmp_{k}", 15: "orders", 16: "lineitem", 19: "orders", 20: "customer", 21: "missing_tbl",
    22: "orders,lineitem", 24: "orders", 25: "orders", 26: "customer", 27: "orders", 28: "orders,customer",
    30: "tmp_{k}", 31: "lineitem",
}
COLUMNS = {
    0: "o_orderkey", 1: "c_name", 2: "o_orderkey,c_name,o_custkey,c_custkey,o_totalprice",
    3: "o_orderkey,o_totalprice,l_quantity,l_orderkey,o_orderkey", 4: "o_orderkey,o_custkey",
    5: "o_orderkey,o_orderkey,o_orderkey", 6: "o_orderkey,l_orderkey", 7: "o_orderkey,o_custkey", 8: "o_orderkey",
    9: "o_orderkey,o_custkey", 11: "o_orderkey", 12: "o_totalprice", 13: "o_totalprice,o_orderkey",
    19: "o_orderkey,o_orderkey,o_orderstatus", 20: "c_custkey,c_active,c_custkey", 21: "x,x",
    22: "o_missing,o_other,l_orderkey,o_orderkey", 25: "o_orderkey,ts,o_comment", 26: "c_name", 27: "o_orderkey",
    31: "l_shipdate,l_quantity",
}
JOINS = {
    2: ("left", "LEFT JOIN customer c ON o.o_custkey = c.c_custkey"),
    22: ("inner", "JOIN lineitem l ON l.l_orderkey = o.o_orderkey"), 28: ("comma", ", customer"),
}
PREDICATES = (
    (0, "where", "WHERE o_orderkey = {k}"), (1, "where", "WHERE c.c_name = 'n{k}'"), (2, "where", "WHERE o.o_totalprice > {k}.5"),
    (3, "where", "WHERE o_totalprice > (SELECT AVG(l_quantity) FROM lineitem WHERE lineitem.l_orderkey = orders.o_orderkey)"),
    (7, "where", "WHERE o_custkey = {k}"), (9, "where", "WHERE o_custkey = $1"), (11, "where", "WHERE o_orderkey = {k}"),
    (13, "where", "WHERE o_orderkey = {k}"), (19, "where", "WHERE o_orderkey = '{k}' AND o_orderstatus = 'F'"),
    (20, "where", "WHERE c_active = 1"), (20, "having", "HAVING COUNT(*) > 2"), (21, "where", "WHERE x = 1"),
    (25, "where", "WHERE o_comment ILIKE '%; drop table x%'"),
    (31, "where", "WHERE l_shipdate >= '2020-01-01' AND 5 < l_quantity"),
)
_K = "replace({}, '{{k}}', CAST(unit_id AS VARCHAR))".format
_ALL = (
    [(t, "table", i, None, v) for t, names in TABLES.items() for i, v in enumerate(names.split(","))]
    + [(t, "column", i, None, v) for t, names in COLUMNS.items() for i, v in enumerate(names.split(","))]
    + [(t, "join", 0, d, v) for t, (d, v) in JOINS.items()]
    + [(t, "predicate", int(d == "having"), d, v) for t, d, v in PREDICATES]
)
FACTS = f""", fx AS (
  SELECT unit_id, stmt_idx, repo, g.fact_kind, g.i, g.detail, {_K('g.value')} AS value
  FROM v_statements JOIN {by_template(_ALL, 'fact_kind, i, detail, value')} ON unit_id % 32 = g.t)
"""


def statements(spark, sf):
    return view(spark, sf, "v_statements")


def catalogue(spark, sf):
    columns = view(spark, sf, "v_cat_columns")
    indexes = view(spark, sf, "v_cat_indexes").withColumn("columns", F.split("cols", ","))
    return columns, indexes, view(spark, sf, "v_cat_warnings")


def _in_order(found):
    """Facts of a statement as one text; the list of one statement is bounded by its text."""
    return found.groupBy("unit_id", "stmt_idx").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("_v")).select(
        "unit_id", "stmt_idx", F.array_join(F.transform("_v", lambda v: v["value"]), ",").alias("found"))


@query("extract_tables", "v_statements", FACTS + """
  SELECT unit_id, stmt_idx, string_agg(value, ',' ORDER BY i) AS found FROM fx WHERE fact_kind = 'table' GROUP BY ALL""")
def extract_tables(spark, sf):
    return _in_order(fa.table_facts(fa.statement_tokens(statements(spark, sf))))


@query("extract_columns", "v_statements", FACTS + """
  SELECT unit_id, stmt_idx, string_agg(value, ',' ORDER BY i) AS found FROM fx WHERE fact_kind = 'column' GROUP BY ALL""")
def extract_columns(spark, sf):
    return _in_order(fa.column_facts(fa.statement_tokens(statements(spark, sf))))


def _clauses(spark, sf, kind):
    source = statements(spark, sf)
    return fa.clause_facts(fa.statement_tokens(source), source).filter(F.col("fact_kind") == kind).select(
        "unit_id", "stmt_idx", "detail", "value")


@query("extract_joins", "v_statements", FACTS + "SELECT unit_id, stmt_idx, detail, value FROM fx WHERE fact_kind = 'join'")
def extract_joins(spark, sf):
    return _clauses(spark, sf, "join")


@query("extract_predicates", "v_statements", FACTS + "SELECT unit_id, stmt_idx, detail, value FROM fx WHERE fact_kind = 'predicate'")
def extract_predicates(spark, sf):
    return _clauses(spark, sf, "predicate")


@query("bounded_facts", "v_statements", FACTS + """, n AS (
  SELECT *, row_number() OVER (PARTITION BY unit_id, fact_kind ORDER BY i) AS rank, count(*) OVER (PARTITION BY unit_id, fact_kind) AS total,
    CASE fact_kind WHEN 'table' THEN 1 WHEN 'column' THEN 2 ELSE 1 END AS cap FROM fx)
  SELECT unit_id, fact_kind, rank, value, total > cap AS truncated, greatest(total - cap, 0) AS suppressed_count FROM n WHERE rank <= cap""")
def bounded_facts(spark, sf):
    return fa.bounded_facts(fa.facts(statements(spark, sf)), {"table": 1, "column": 2, "join": 1, "predicate": 1}).select(
        "unit_id", "fact_kind", "rank", "value", "truncated", "suppressed_count")


_STAR = {0: "plain", 1: "qualified", 4: "plain", 27: "plain", 28: "plain", 31: "plain"}
_MISMATCH = {
    2: ("o_totalprice", "TEXT", "text", "numeric"), 19: ("o_orderkey", "INTEGER", "integer", "text"),
    20: ("c_active", "BOOLEAN", "boolean", "integer"), 31: ("l_shipdate", "TIMESTAMP", "date", "text"),
}
_UNINDEXED = {2: "o_totalprice", 3: "o_totalprice", 19: "o_orderstatus", 20: "c_active"}
LINT = f""", lx AS (
  SELECT unit_id, stmt_idx, repo, 'OPT-001' AS rule_id, 'info' AS severity, g.s AS subject FROM v_statements JOIN {by_template(list(_STAR.items()), 's')} ON unit_id % 32 = g.t
  UNION ALL SELECT unit_id, stmt_idx, repo, 'OPT-002', 'info', 'orders' FROM v_statements WHERE unit_id % 32 = 3
  UNION ALL SELECT unit_id, stmt_idx, repo, 'OPT-003', 'low', g.s FROM v_statements JOIN {by_template([(t, v[0]) for t, v in _MISMATCH.items()], 's')} ON unit_id % 32 = g.t WHERE dialect <> 'unknown'
  UNION ALL SELECT unit_id, stmt_idx, repo, 'OPT-004', 'low', g.s FROM v_statements JOIN {by_template(list(_UNINDEXED.items()), 's')} ON unit_id % 32 = g.t
    WHERE dialect <> 'unknown' AND NOT (g.t = 20 AND (repo % 5 = 0 OR repo % 7 = 0)))
"""


@query("opt_001", "v_statements", LINT + """SELECT unit_id, rule_id, severity, subject,
  CASE subject WHEN 'plain' THEN 'SELECT * present' ELSE 'SELECT t.* present' END AS title FROM lx WHERE rule_id = 'OPT-001'""")
def opt_001(spark, sf):
    return li.opt_001(statements(spark, sf)).select("unit_id", "rule_id", "severity", "subject", "title")


@query("opt_002", "v_statements", LINT + "SELECT unit_id, rule_id, severity, subject FROM lx WHERE rule_id = 'OPT-002'")
def opt_002(spark, sf):
    return li.opt_002(li.rule_tokens(statements(spark, sf))).select("unit_id", "rule_id", "severity", "subject")


@query("opt_003", "v_statements", f"""
  SELECT unit_id, 'OPT-003' AS rule_id, g.col AS subject, 'Schema model indicates column ' || g.col || ' is ' || g.ty || ' (class ' || g.cc
    || '); predicate compares to ' || g.lc || ' literal. Implicit conversion behavior depends on the database.' AS message
  FROM v_statements JOIN {by_template([(t, *v) for t, v in _MISMATCH.items()], 'col, ty, cc, lc')} ON unit_id % 32 = g.t WHERE dialect <> 'unknown'""")
def opt_003(spark, sf):
    return li.opt_003(li.compared_tokens(statements(spark, sf)), catalogue(spark, sf)[0]).select(
        "unit_id", "rule_id", "subject", "message")


@query("opt_004", "v_statements", LINT + "SELECT unit_id, rule_id, severity, subject FROM lx WHERE rule_id = 'OPT-004'")
def opt_004(spark, sf):
    return li.opt_004(li.compared_tokens(statements(spark, sf)), *catalogue(spark, sf)).select(
        "unit_id", "rule_id", "severity", "subject")


@query("lint", "v_statements", LINT + "SELECT unit_id, stmt_idx, repo, rule_id, severity, subject FROM lx")
def lint(spark, sf):
    return li.lint(statements(spark, sf), *catalogue(spark, sf)).select(
        "unit_id", "stmt_idx", "repo", "rule_id", "severity", "subject")


# a claim about an index needs the table it is about
@query("withhold_on_warnings", "v_cat_indexes v_cat_warnings", """
  SELECT i.repo, i.tbl, i.idx FROM v_cat_indexes i WHERE NOT EXISTS (
    SELECT 1 FROM v_cat_warnings w WHERE w.repo = i.repo AND w.object_name = i.tbl AND w.capability = 'column_enumeration')""")
def withhold_on_warnings(spark, sf):
    _, indexes, warnings = catalogue(spark, sf)
    return li.withhold_on_warnings(indexes, warnings, "column_enumeration").select("repo", "tbl", "idx")


_O = "orders.o_orderkey, orders.o_custkey, orders.o_orderstatus, orders.o_totalprice, orders.o_orderdate, orders.o_comment"
_EXPANDED = (
    (0, "orders", f"SELECT {_O} FROM orders WHERE o_orderkey = {{k}}", None),
    (1, "customer", "SELECT customer.c_custkey, customer.c_name, customer.c_active FROM customer c WHERE c.c_name = 'n{k}'", None),
    (4, None, None, "CTE obscures column set"), (27, None, None, "subquery in FROM not supported"),
    (28, None, None, "multi-table expansion not supported"),
    (31, "lineitem", "SELECT DISTINCT lineitem.l_orderkey, lineitem.l_quantity, lineitem.l_shipdate, lineitem.o_totalprice, 1 AS one "
     "FROM lineitem WHERE l_shipdate >= '2020-01-01' AND 5 < l_quantity", None),
)
STARS = f""", sx AS (
  SELECT unit_id, stmt_idx, repo, dialect, sha256(sql) AS original_hash, unit_id % 32 = 1 AND repo % 5 = 0 AS warned, g.tbl, {_K('g.sql2')} AS sql2, g.reason
  FROM v_statements JOIN {by_template(list(_EXPANDED), 'tbl, sql2, reason')} ON unit_id % 32 = g.t), se AS (
  SELECT unit_id, stmt_idx, repo, dialect, original_hash, CASE WHEN NOT warned THEN tbl END AS schema_dependency,
    CASE WHEN NOT warned THEN sql2 END AS rewritten_sql, CASE WHEN warned OR reason IS NOT NULL THEN 'withheld' ELSE 'validated' END AS validation_status,
    CASE WHEN warned THEN 'schema model has a completeness warning for this table' ELSE reason END AS reason FROM sx)
"""


@query("star_expansion", "v_statements", STARS + "SELECT * FROM se")
def star_expansion(spark, sf):
    columns, _, warnings = catalogue(spark, sf)
    return rw.star_expansion(statements(spark, sf), columns, warnings)


_IMPACT = [
    (3, "column", "orders.l_quantity"), (3, "column", "lineitem.o_orderkey"), (4, "table", "recent"), (5, "table", "gone"),
    (6, "column", "orders.l_orderkey"), (6, "column", "lineitem.o_orderkey"), (8, "table", "tmp_{k}"), (14, "table", "tmp_{k}"),
    (21, "table", "missing_tbl"), (22, "column", "orders.o_missing"), (22, "column", "lineitem.o_missing"),
    (25, "column", "orders.ts"), (30, "table", "tmp_{k}"),
]
IMPACT = f""", ix AS (
  SELECT unit_id, stmt_idx, repo, g.missing, {_K('g.name')} AS name FROM v_statements JOIN {by_template(_IMPACT, 'missing, name')} ON unit_id % 32 = g.t)
"""


@query("schema_impact", "v_statements", IMPACT + "SELECT unit_id, stmt_idx, missing, name FROM ix")
def schema_impact(spark, sf):
    return rw.schema_impact(statements(spark, sf), catalogue(spark, sf)[0])


CROSS = """, cx AS (
  SELECT event_id, g.missing, g.name FROM v_errors JOIN (VALUES (0, 'column', 'orders.o_gone'), (1, 'table', 'lost_table'),
    (2, 'column', 'lineitem.zzz'), (2, 'column', 'lineitem.c_custkey')) g(t, missing, name) ON event_id % 4 = g.t)
"""


def failing_statements(spark, sf):
    return view(spark, sf, "v_errors").filter(F.col("sql").isNotNull()).select(
        F.col("event_id").alias("unit_id"), F.lit(0).alias("stmt_idx"), "repo", "sql")


@query("schema_cross_check", "v_errors", CROSS + "SELECT event_id, missing, name FROM cx")
def schema_cross_check(spark, sf):
    return rw.schema_cross_check(failing_statements(spark, sf), catalogue(spark, sf)[0]).select(
        F.col("unit_id").alias("event_id"), "missing", "name")
