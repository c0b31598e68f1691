"""Queries over statement corpora (survey group B, first half)."""

from __future__ import annotations

from pyspark.sql import functions as F

from querygrove import refdata
from querygrove.functions.lexing import masked
from querygrove.operators import statements as op
from querygrove.prims import joined
from querygrove.sources.views import view
from querygrove.workloads.duck import KIND, SPLIT, by_template, lexed
from querygrove.workloads.errors import sql_text
from querygrove.workloads.registry import query


@query("tokenize", "v_scripts", f""", x AS (
  SELECT unit_id, unnest(t) AS text, CAST(generate_subscripts(t, 1) - 1 AS INT) AS pos
  FROM (SELECT unit_id, {lexed()} AS t FROM v_scripts) s)
  SELECT unit_id, pos, text, {KIND.format(t='text')} AS kind FROM x""")
def tokenize(spark, sf):
    return op.tokenize(view(spark, sf, "v_scripts"))


@query("split_statements", "v_scripts", SPLIT + "SELECT unit_id, stmt_idx, sql FROM st")
def split_statements(spark, sf):
    return op.split_statements(view(spark, sf, "v_scripts"))


@query("clean_scripts", "v_scripts", """
  SELECT unit_id, ltrim(sql, chr(65279)) AS sql FROM v_scripts WHERE trim(ltrim(sql, chr(65279))) <> ''""")
def clean_scripts(spark, sf):
    return op.clean_scripts(view(spark, sf, "v_scripts")).select("unit_id", "sql")


@query("statement_budget", "v_scripts", SPLIT + """
  SELECT unit_id, stmt_idx, sql, NULL AS error, 0 AS suppressed FROM st WHERE stmt_idx < 2
  UNION ALL SELECT unit_id, 2, NULL, 'statement_budget_exceeded', CAST(count(*) - 2 AS INT) FROM st GROUP BY unit_id HAVING count(*) > 2""")
def statement_budget(spark, sf):
    return op.statement_budget(view(spark, sf, "v_scripts"), cap=2)


@query("single_statement_only", "v_scripts", SPLIT + """
  SELECT v.unit_id, CAST(count(st.sql) AS INT) AS statements, CASE WHEN count(st.sql) = 1 THEN min(st.sql) END AS sql,
    CASE WHEN count(st.sql) > 1 THEN 'expected_one_statement' END AS error
  FROM v_scripts v LEFT JOIN st USING (unit_id) GROUP BY v.unit_id""")
def single_statement_only(spark, sf):
    return op.single_statement_only(view(spark, sf, "v_scripts"))


# which statement of which script form is malformed
@query("malformed_statements", "v_scripts", SPLIT + """
  SELECT st.unit_id, st.stmt_idx, g.error, st.sql FROM st JOIN (VALUES (3, 1, 'dangling_clause'), (6, 0, 'unbalanced_parentheses'),
    (6, 2, 'unclosed_quote'), (7, 3, 'unknown_statement'), (7, 4, 'no_statement')) g(t, i, error)
    ON st.unit_id % 8 = g.t AND st.stmt_idx = g.i""")
def malformed_statements(spark, sf):
    return op.malformed_statements(op.split_statements(view(spark, sf, "v_scripts"), ("dialect",)))


_KINDS = {
    "select": (0, 1, 2, 3, 4, 5, 7, 8, 9, 19, 20, 21, 22, 25, 26, 27, 28, 29, 31), "set_op": (6,), "delete": (10, 11),
    "update": (12, 13), "drop": (14, 30), "alter": (15,), "truncate": (16,), "execute": (17,), "explain": (18,),
    "unknown": (23,), "insert": (24,),
}
_KIND_ROWS = [(t, kind) for kind, ts in _KINDS.items() for t in ts]


@query("statement_kinds", "v_statements", f"""
  SELECT unit_id, stmt_idx, g.kind, upper(regexp_extract(sql, '^\\s*(\\w+)', 1)) AS lead
  FROM v_statements JOIN {by_template(_KIND_ROWS, 'kind')} ON unit_id % 32 = g.t""")
def statement_kinds(spark, sf):
    return op.statement_kinds(view(spark, sf, "v_statements"))


_REJECTED = {
    "writable_cte": (5,), "locking_clause": (7,), "select_into": (8,), "not_a_query": (10, 11, 12, 13, 14, 15, 16, 17, 24, 30),
    "explain_prefix": (18,), "empty": (23,), "parse_error": (29,),
}
_GATE_ROWS = [(t, reason) for reason, ts in _REJECTED.items() for t in ts]


@query("admit_read_only", "v_statements", f"""
  SELECT unit_id, stmt_idx, g.detail IS NULL AS admitted, CASE WHEN g.detail IS NOT NULL THEN 'statement_blocked' END AS reason,
    g.detail, unit_id % 32 = 9 AS has_placeholders,
    CASE WHEN g.detail IS NULL THEN regexp_replace(sql, ' -- .*$', '') END AS canonical_sql
  FROM v_statements LEFT JOIN {by_template(_GATE_ROWS, 'detail')} ON unit_id % 32 = g.t""")
def admit_read_only(spark, sf):
    return op.admit_read_only(view(spark, sf, "v_statements"))


@query("has_placeholders", "v_statements", r"""
  SELECT unit_id, regexp_matches(regexp_replace(sql, '''[^'']*''', '', 'g'), '\$[0-9]+') AS has_placeholders FROM v_statements""")
def has_placeholders(spark, sf):
    return view(spark, sf, "v_statements").select("unit_id", op.has_placeholders(masked(F.col("sql"))).alias("has_placeholders"))


_MARKERS = ", ".join(
    f"({n}, {sql_text(d)}, {o}, {sql_text(p)}, {sql_text(t)})" for n, (d, o, p, t) in enumerate(refdata.DIALECT_MARKERS))


@query("infer_dialect", "v_statements", f""", mk(n, dialect, ord, pattern, text) AS (VALUES {_MARKERS}), h AS (
  SELECT unit_id, stmt_idx, mk.dialect, ord, count(*) AS c, string_agg(text, ', ' ORDER BY n) AS ev
  FROM v_statements v JOIN mk ON regexp_matches(v.sql, mk.pattern, 'i') GROUP BY ALL)
  SELECT v.unit_id, v.stmt_idx, coalesce(string_agg(h.dialect, '|' ORDER BY c DESC, ord), '') AS candidates,
    least(coalesce(max(c), 0) / 10.0, 1.0)::DOUBLE AS rank_score,
    coalesce(string_agg(h.dialect || ': ' || ev, '|' ORDER BY c DESC, ord), '') AS evidence
  FROM v_statements v LEFT JOIN h USING (unit_id, stmt_idx) GROUP BY v.unit_id, v.stmt_idx""")
def infer_dialect(spark, sf):
    return op.infer_dialect(view(spark, sf, "v_statements")).select(
        "unit_id", "stmt_idx", joined("candidates").alias("candidates"), F.col("rank_score").cast("double").alias("rank_score"),
        joined("evidence").alias("evidence"))


_EXPLICIT = """CASE unit_id % 5 WHEN 0 THEN '  Postgres ' WHEN 1 THEN 'not_real' WHEN 2 THEN '  ' WHEN 3 THEN NULL ELSE dialect END"""
_CONFIGURED = """CASE unit_id % 3 WHEN 0 THEN 'MYSQL' WHEN 1 THEN NULL ELSE 'bogus' END"""
_KNOWN = ", ".join(f"'{d}'" for d in refdata.KNOWN_DIALECTS)


@query("resolve_dialect", "v_statements", f"""
  SELECT unit_id, CASE WHEN trim(coalesce(x, '')) <> '' THEN CASE WHEN lower(trim(x)) IN ({_KNOWN}) THEN lower(trim(x)) ELSE 'unknown' END
    WHEN trim(coalesce(c, '')) <> '' AND lower(trim(c)) IN ({_KNOWN}) THEN lower(trim(c)) ELSE 'unknown' END AS dialect
  FROM (SELECT unit_id, {_EXPLICIT} AS x, {_CONFIGURED} AS c FROM v_statements) s""")
def resolve_dialect(spark, sf):
    return view(spark, sf, "v_statements").select(
        "unit_id", op.resolve_dialect(F.expr(_EXPLICIT), F.expr(_CONFIGURED)).alias("dialect"))


@query("statement_fingerprint", "v_statements", """
  SELECT sha256(sql) AS fp, count(*) AS n, min(unit_id) AS first_unit FROM v_statements GROUP BY 1""")
def statement_fingerprint(spark, sf):
    return op.statement_fingerprint(view(spark, sf, "v_statements"))


@query("source_spans", "v_scripts", f""", pc AS (
  SELECT unit_id, unnest(t) AS text, generate_subscripts(t, 1) AS i
  FROM (SELECT unit_id, {lexed(pieces=True)} AS t FROM v_scripts) x), pf AS (
  SELECT *, coalesce(string_agg(text, '') OVER (PARTITION BY unit_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS pre,
    sum(CASE WHEN text = ';' THEN 1 ELSE 0 END) OVER (PARTITION BY unit_id ORDER BY i) AS seq FROM pc)
  SELECT unit_id, CAST(dense_rank() OVER (PARTITION BY unit_id ORDER BY seq) - 1 AS INT) AS stmt_idx, length(pre) AS start, text,
    1 + length(pre) - length(replace(pre, chr(10), '')) AS line, 1 + length(regexp_extract(pre, '[^\\n]*$')) AS col
  FROM pf WHERE trim(text, ' ' || chr(10)) <> '' AND text <> ';'""")
def source_spans(spark, sf):
    return op.source_spans(view(spark, sf, "v_scripts"))
