"""Queries over migrations and schema change logs (survey group D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from querygrove import refdata
from querygrove.operators import catalogue as op
from querygrove.operators import lint, rewrite
from querygrove.operators.lint import type_class
from querygrove.prims import joined
from querygrove.sources.views import oracle, view
from querygrove.workloads.registry import query

_M = "v_migrations"
#: Convention and version of each file, ambiguous repositories, and the order of the good ones.
ORDER = r""", cv AS (
  SELECT *, CASE WHEN regexp_matches(name, '^[0-9]{8}_') THEN 'date' WHEN regexp_matches(name, '^[0-9]{10}_') THEN 'timestamp'
    WHEN regexp_matches(name, '^V[0-9]+__') THEN 'flyway' WHEN regexp_matches(name, '^[0-9]+_') THEN 'numeric' END AS convention,
    TRY_CAST(regexp_extract(name, '^V?([0-9]+)_', 1) AS BIGINT) AS ver FROM v_migrations), od AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY repo ORDER BY ver, path) AS INT) AS file_ord FROM cv WHERE convention IS NOT NULL), mx AS (
  SELECT repo, 'ambiguous_migration_conventions' AS kind FROM od GROUP BY repo HAVING count(DISTINCT convention) > 1), tw AS (
  SELECT DISTINCT repo, 'duplicate_migration_version' AS kind FROM (SELECT repo, ver FROM od GROUP BY repo, ver HAVING count(*) > 1) x
  WHERE repo NOT IN (SELECT repo FROM mx)), am AS (SELECT * FROM mx UNION ALL SELECT * FROM tw), gd AS (
  SELECT od.*, CASE WHEN contains(content, 'CREATE TABLE orders') THEN 1 WHEN contains(content, 'CREATE TABLE items') THEN 2
    WHEN starts_with(content, 'DROP TABLE orders') THEN 31 WHEN starts_with(content, 'ALTER TABLE orders') THEN 32
    WHEN contains(content, 'CREATE VIEW') THEN 41 ELSE 42 END AS form FROM od WHERE repo NOT IN (SELECT repo FROM am))
"""
# expected change rows per content form: (form, statement, action, op, table, column, type, nullable, default, detail)
_EVENTS = [
    (1, 0, 0, "create_table", "users", None, None, None, None, None), (1, 0, 1, "add_column", "users", "id", "SERIAL", True, None, None),
    (1, 0, 2, "primary_key", "users", None, None, None, None, "id"),
    (1, 0, 3, "add_column", "users", "email", "VARCHAR(255)", False, None, None), (1, 0, 4, "unique", "users", None, None, None, None, "email"),
    (1, 0, 5, "add_column", "users", "age", "INT", True, "18", None), (1, 1, 0, "create_table", "orders", None, None, None, None, None),
    (1, 1, 1, "add_column", "orders", "id", "INT", True, None, None), (1, 1, 2, "add_column", "orders", "user_id", "INT", True, None, None),
    (1, 1, 3, "foreign_key", "orders", None, None, None, None, "user_id>users(id)"),
    (1, 1, 4, "add_column", "orders", "amount", "NUMERIC(10, 2)", False, None, None), (1, 1, 5, "primary_key", "orders", None, None, None, None, "id"),
    (1, 2, 0, "create_index", "users", None, None, None, None, "idx_email:email:u"),
    (2, 0, 0, "add_column", "users", "city_{k}", "TEXT", True, None, None), (2, 1, 0, "drop_column", "users", "age", None, None, None, None),
    (2, 2, 0, "create_table", "items", None, None, None, None, None), (2, 2, 1, "add_column", "items", "id", "BIGINT", True, None, None),
    (2, 2, 2, "add_column", "items", "order_id", "INT", True, None, None), (2, 2, 3, "add_column", "items", "qty", "INT", True, None, None),
    (2, 2, 4, "unsupported_table_expression", "items", None, None, None, None, None),
    (2, 2, 5, "foreign_key", "items", None, None, None, None, "order_id>orders(id)"),
    (2, 3, 0, "create_index", "items", None, None, None, None, "idx_qty:qty:p"), (2, 4, 0, "add_column", "nowhere", "x", "INT", True, None, None),
    (31, 0, 0, "drop_table", "orders", None, None, None, None, None), (31, 1, 0, "unsupported_type", None, None, None, None, None, None),
    (31, 2, 0, "add_column", "users", "feel", "MOOD", True, None, None), (42, 3, 0, "parse_failure", None, None, None, None, None, None),
    (32, 0, 0, "rename_column", "orders", "amount", None, None, None, "total"), (32, 1, 0, "drop_index", None, None, None, None, None, "idx_qty::"),
    (32, 2, 0, "create_index", "users", None, None, None, None, "idx_lower:lower(email):x"),
    (41, 0, 0, "create_table", "users", None, None, None, None, None), (41, 0, 1, "add_column", "users", "uid", "BIGINT", False, None, None),
    (41, 0, 2, "add_column", "users", "nick", "TEXT", True, None, None), (41, 1, 0, "unsupported_create", None, None, None, None, None, None),
    (42, 0, 0, "add_column", "items", "note", "VARCHAR(20)", True, None, None), (42, 2, 0, "unsupported_create", None, None, None, None, None, None),
]


def _lit(v) -> str:
    return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v + "'"


EVENTS = ORDER + f""", ev AS (
  SELECT repo, path, file_ord, g.si AS stmt_idx, g.ai AS action, g.op, g.tbl, replace(g.col, '{{k}}', CAST(repo AS VARCHAR)) AS col, g.ty AS data_type,
    g.nl AS nullable, g.df AS default_text, g.dt AS detail, file_ord * 1099511627776 + g.si * 32768 + g.ai AS seq
  FROM gd JOIN (VALUES {', '.join('(' + ', '.join(_lit(v) for v in row) + ')' for row in _EVENTS)}) g(form, si, ai, op, tbl, col, ty, nl, df, dt) USING (form) WHERE g.op <> 'parse_failure' OR repo % 5 = 0)
"""
LIVE = """, lt AS (
  SELECT repo, tbl, max(seq) AS born, max_by(op, seq) AS op FROM ev WHERE op IN ('create_table', 'drop_table') GROUP BY repo, tbl), lv AS (
  SELECT * FROM lt WHERE op = 'create_table')
"""


def migrations(spark, sf):
    return view(spark, sf, _M)


def events(spark, sf):
    return op.ddl_events(op.ordered_migrations(migrations(spark, sf)))


@query("migration_convention", _M, ORDER + "SELECT path, repo, convention FROM cv")
def migration_convention(spark, sf):
    return op.migration_convention(migrations(spark, sf)).select("repo", "path", "convention")


@query("migration_order", _M, ORDER + "SELECT repo, path, file_ord FROM od")
def migration_order(spark, sf):
    return op.migration_order(migrations(spark, sf)).select("repo", "path", "file_ord")


@query("ambiguous_migrations", _M, ORDER + "SELECT repo, kind FROM am")
def ambiguous_migrations(spark, sf):
    return op.ambiguous_migrations(migrations(spark, sf)).select("repo", "kind")


@query("ddl_events", _M, EVENTS + "SELECT repo, seq, op, tbl, col, data_type, nullable, default_text, detail FROM ev")
def ddl_events(spark, sf):
    cols = joined("cols", ",")
    detail = (
        F.when(F.col("op").isin("primary_key", "unique"), cols).when(F.col("op") == "rename_column", F.col("new_col"))
        .when(F.col("op") == "foreign_key", F.concat(cols, F.lit(">"), "ref_tbl", F.lit("("), joined("ref_cols", ","), F.lit(")")))
        .when(F.col("op") == "create_index", F.concat_ws(":", "idx", cols, F.concat(
            F.when(F.col("is_unique"), "u").otherwise(""), F.when(F.col("is_partial"), "p").otherwise(""), F.when(F.col("is_expression"), "x").otherwise(""))))
        .when(F.col("op") == "drop_index", F.concat("idx", F.lit("::"))))
    return events(spark, sf).select("repo", "seq", "op", "tbl", "col", "data_type", "nullable", "default_text", detail.alias("detail"))


def _replay(versions: str, source: str = "SELECT * FROM v_ddl_events", views: str = "v_ddl_events") -> str:
    """Oracle: for each (repo, version) one event per table and step, the columns of a table as a map."""
    body = oracle(f"{views} v_schema_requests", source)
    wanted = oracle(f"{views} v_schema_requests", versions)
    return f"""WITH RECURSIVE al AS MATERIALIZED ({body}), rq AS MATERIALIZED ({wanted}), ev AS MATERIALIZED (
      SELECT al.*, version FROM al JOIN rq ON al.repo = rq.repo AND seq <= version), b AS MATERIALIZED (
      SELECT repo, version, tbl, max(seq) AS born, max_by(op, seq) AS last FROM ev WHERE op IN ('create_table', 'drop_table') GROUP BY ALL), s AS MATERIALIZED (
      SELECT ev.*, row_number() OVER (PARTITION BY ev.repo, ev.version, ev.tbl ORDER BY seq) AS r FROM ev JOIN b USING (repo, version, tbl)
      WHERE b.last = 'create_table' AND seq > born AND op IN ('add_column', 'drop_column', 'rename_column')), f AS (
      SELECT repo, version, tbl, 0::BIGINT AS r, MAP(CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[])) AS m FROM b WHERE last = 'create_table'
      UNION ALL
      SELECT f.repo, f.version, f.tbl, s.r, CASE
          WHEN s.op = 'add_column' THEN map_concat(f.m, MAP([s.col], [s.data_type]))
          WHEN s.op = 'drop_column' THEN map_from_entries(list_filter(map_entries(f.m), lambda x: x.key <> s.col))
          WHEN s.op = 'rename_column' AND s.col <> s.new_col AND list_contains(map_keys(f.m), s.col) THEN
            map_concat(map_from_entries(list_filter(map_entries(f.m), lambda x: x.key <> s.col)), MAP([s.new_col], [f.m[s.col]]))
          ELSE f.m END
      FROM f JOIN s ON s.repo = f.repo AND s.version = f.version AND s.tbl = f.tbl AND s.r = f.r + 1), fin AS (
      SELECT repo, version, tbl, max_by(m, r) AS m FROM f GROUP BY ALL)
      SELECT repo, version, tbl, e.key AS col, e.value AS data_type FROM (SELECT repo, version, tbl, unnest(map_entries(m)) AS e FROM fin) x"""


_LAST = "SELECT repo, max(seq) AS version FROM v_ddl_events GROUP BY repo"


@query("schema_state", "", f"SELECT repo, tbl, col, data_type FROM ({_replay(_LAST)})")
def schema_state(spark, sf):
    return op.schema_state(view(spark, sf, "v_ddl_events"))


@query("schema_as_of", "", _replay("SELECT * FROM v_schema_requests"))
def schema_as_of(spark, sf):
    """The schemas of every repository at a third and at two thirds of the change log."""
    return op.schema_as_of(view(spark, sf, "v_ddl_events"), view(spark, sf, "v_schema_requests"))


FKS = EVENTS + """, fk AS (
  SELECT repo, seq, tbl, split_part(detail, '>', 1) AS cols, regexp_extract(detail, '>(\\w+)\\(', 1) AS ref_tbl FROM ev e WHERE op = 'foreign_key' AND NOT EXISTS (
    SELECT 1 FROM ev d WHERE d.repo = e.repo AND d.op = 'drop_table' AND d.seq > e.seq AND d.tbl IN (e.tbl, regexp_extract(e.detail, '>(\\w+)\\(', 1))))
"""


@query("drop_table_cascade", _M, FKS + "SELECT repo, tbl, cols, ref_tbl FROM fk")
def drop_table_cascade(spark, sf):
    return op.foreign_keys(events(spark, sf)).select("repo", "tbl", joined("cols", ",").alias("cols"), "ref_tbl")


@query("fk_graph", _M, FKS + "SELECT repo, tbl AS src, string_agg(ref_tbl, '|' ORDER BY seq) AS targets FROM fk GROUP BY repo, tbl")
def fk_graph(spark, sf):
    return op.fk_graph(op.foreign_keys(events(spark, sf))).withColumn("targets", joined("targets"))


@query("index_state", _M, EVENTS + LIVE + """, ix AS (
  SELECT repo, split_part(detail, ':', 1) AS idx, max(seq) AS seq, max_by(op, seq) AS op, max_by(tbl, seq) AS tbl, max_by(detail, seq) AS detail
  FROM ev WHERE op IN ('create_index', 'drop_index') GROUP BY ALL)
  SELECT ix.repo, ix.tbl, idx, split_part(detail, ':', 2) AS cols, contains(split_part(detail, ':', 3), 'u') AS is_unique,
    contains(split_part(detail, ':', 3), 'p') AS is_partial, contains(split_part(detail, ':', 3), 'x') AS is_expression
  FROM ix JOIN lv ON lv.repo = ix.repo AND lv.tbl = ix.tbl WHERE ix.op = 'create_index' AND ix.seq > born""")
def index_state(spark, sf):
    return op.index_state(events(spark, sf)).withColumn("cols", joined("cols", ","))


@query("ddl_warnings", _M, EVENTS + """, un AS (
  SELECT e.repo, min(e.seq) AS seq, e.path, 'alter_unknown_table' AS op FROM ev e WHERE op IN ('add_column', 'drop_column', 'rename_column')
    AND coalesce((SELECT max_by(d.op, d.seq) FROM ev d WHERE d.repo = e.repo AND d.tbl = e.tbl AND d.seq < e.seq AND d.op IN ('create_table', 'drop_table')), 'drop_table') = 'drop_table'
  GROUP BY e.repo, e.path, e.stmt_idx), w AS (
  SELECT repo, seq, path, op FROM ev WHERE starts_with(op, 'unsupported') OR op = 'parse_failure' UNION ALL SELECT * FROM un)
  SELECT repo, seq, path, op, CASE op WHEN 'unsupported_type' THEN 'column_type' WHEN 'parse_failure' THEN '{every}' ELSE '' END AS compromised,
    op IN ('unsupported_type', 'parse_failure') AS affects FROM w""".replace("{every}", "|".join(refdata.SCHEMA_CAPABILITIES)))
def ddl_warnings(spark, sf):
    return op.ddl_warnings(events(spark, sf)).select("repo", "seq", "path", "op", joined("compromised").alias("compromised"), "affects")


@query("schema_fingerprint", _M, ORDER + """
  SELECT repo, sha256(string_agg(part, '|' ORDER BY blk)) AS fingerprint FROM (
    SELECT repo, file_ord // 4096 AS blk, sha256(string_agg(path || ':' || sha256(content), '|' ORDER BY file_ord)) AS part FROM gd GROUP BY 1, 2) x GROUP BY repo""")
def schema_fingerprint(spark, sf):
    return op.schema_fingerprint(op.ordered_migrations(migrations(spark, sf)))


@query("type_class", _M, EVENTS + """
  SELECT repo, seq, data_type, CASE WHEN data_type IN ('SERIAL', 'INT', 'BIGINT') THEN 'integer' WHEN starts_with(data_type, 'NUMERIC') THEN 'numeric'
    WHEN data_type = 'TEXT' OR starts_with(data_type, 'VARCHAR') THEN 'text' END AS class FROM ev WHERE op = 'add_column'""")
def type_class_query(spark, sf):
    return events(spark, sf).filter(F.col("op") == "add_column").select("repo", "seq", "data_type", type_class(F.col("data_type")).alias("class"))


#: State of every repository's live tables: columns that were added and not dropped or renamed since, and renamed ones.
STATE = EVENTS + LIVE + """, rc AS (
  SELECT ev.* FROM ev JOIN lv ON lv.repo = ev.repo AND lv.tbl = ev.tbl WHERE ev.seq > born AND ev.op IN ('add_column', 'drop_column', 'rename_column')), ad AS (
  SELECT a.* FROM rc a WHERE op = 'add_column' AND NOT EXISTS (SELECT 1 FROM rc b WHERE b.repo = a.repo AND b.tbl = a.tbl AND b.seq > a.seq AND b.col = a.col)), st AS (
  SELECT repo, tbl, col, seq, data_type FROM ad UNION ALL
  SELECT r.repo, r.tbl, r.detail, r.seq, a.data_type FROM rc r JOIN rc a ON a.repo = r.repo AND a.tbl = r.tbl AND a.col = r.col AND a.op = 'add_column' AND a.seq < r.seq
  WHERE r.op = 'rename_column'), wn AS (
  SELECT DISTINCT repo, 'items' AS tbl FROM ev WHERE op = 'parse_failure'
  UNION SELECT st.repo, st.tbl FROM st WHERE data_type = 'MOOD'), ix AS (
  SELECT repo, split_part(detail, ':', 1) AS idx, max(seq) AS seq, max_by(op, seq) AS op, max_by(tbl, seq) AS tbl, max_by(detail, seq) AS detail
  FROM ev WHERE op IN ('create_index', 'drop_index') GROUP BY ALL), li AS (
  SELECT ix.repo, ix.tbl, split_part(detail, ':', 2) AS lead, split_part(detail, ':', 3) IN ('', 'u') AS plain
  FROM ix JOIN lv ON lv.repo = ix.repo AND lv.tbl = ix.tbl WHERE ix.op = 'create_index' AND ix.seq > born)
"""


def replayed(spark, sf):
    return op.replayed(events(spark, sf))


@query("completeness_warnings", _M, STATE + f"""
  SELECT repo, 'items' AS object_name, unnest({list(refdata.SCHEMA_CAPABILITIES)}) AS capability FROM (SELECT DISTINCT repo FROM ev WHERE op = 'parse_failure')
  UNION SELECT repo, tbl, 'column_type' FROM st WHERE data_type = 'MOOD'""")
def completeness_warnings(spark, sf):
    return replayed(spark, sf)[2]


@query("replayed_star_expansion", f"{_M} v_repo_statements", STATE + """, tb AS (
  SELECT repo, tbl, string_agg(tbl || '.' || col, ', ' ORDER BY seq) AS cols FROM st GROUP BY repo, tbl), q AS (
  SELECT unit_id, repo, CASE WHEN unit_id % 4 = 0 THEN 'users' ELSE 'items' END AS tbl FROM v_repo_statements WHERE unit_id % 4 < 2)
  SELECT unit_id, CASE WHEN n.repo IS NULL AND wn.repo IS NULL AND tb.cols IS NOT NULL THEN 'SELECT ' || cols || ' FROM ' || q.tbl END AS rewritten_sql,
    CASE WHEN n.repo IS NOT NULL THEN 'schema unavailable' WHEN wn.repo IS NOT NULL THEN 'schema model has a completeness warning for this table'
      WHEN tb.cols IS NULL THEN 'table ' || chr(39) || q.tbl || chr(39) || ' not found in schema model' END AS reason
  FROM q LEFT JOIN tb ON tb.repo = q.repo AND tb.tbl = q.tbl LEFT JOIN wn ON wn.repo = q.repo AND wn.tbl = q.tbl
  LEFT JOIN (SELECT DISTINCT repo FROM q WHERE repo NOT IN (SELECT repo FROM st)) n ON n.repo = q.repo""")
def replayed_star_expansion(spark, sf):
    """Stars of a repository's statements by the schema that its own migrations make; tables with unread DDL are withheld."""
    columns, _, warnings = replayed(spark, sf)
    return rewrite.star_expansion(view(spark, sf, "v_repo_statements"), columns, warnings).select("unit_id", "rewritten_sql", "reason")


@query("replayed_lint", f"{_M} v_repo_statements", STATE + """, c AS (
  SELECT v.unit_id, v.repo, CASE WHEN v.unit_id % 4 = 2 THEN 'items' ELSE 'users' END AS tbl, CASE WHEN v.unit_id % 4 = 2 THEN 'order_id' ELSE 'email' END AS col
  FROM v_repo_statements v WHERE v.unit_id % 4 > 1), f AS (
  SELECT c.*, st.data_type FROM c JOIN st ON st.repo = c.repo AND st.tbl = c.tbl AND st.col = c.col)
  SELECT unit_id, 'OPT-001' AS rule_id, 'plain' AS subject FROM v_repo_statements WHERE unit_id % 4 < 2
  UNION ALL SELECT unit_id, 'OPT-003', col FROM f WHERE starts_with(data_type, 'VARCHAR')
  UNION ALL SELECT unit_id, 'OPT-004', col FROM f WHERE EXISTS (SELECT 1 FROM li WHERE li.repo = f.repo AND li.tbl = f.tbl)
    AND NOT EXISTS (SELECT 1 FROM li WHERE li.repo = f.repo AND li.tbl = f.tbl AND li.lead = f.col AND li.plain)
    AND NOT EXISTS (SELECT 1 FROM wn WHERE wn.repo = f.repo AND wn.tbl = f.tbl)""")
def replayed_lint(spark, sf):
    """Lint findings by the replayed schema; claims about indexes of tables with unread DDL are withheld."""
    return lint.lint(view(spark, sf, "v_repo_statements"), *replayed(spark, sf)).select("unit_id", "rule_id", "subject")
