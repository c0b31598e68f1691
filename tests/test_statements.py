import pytest
from conftest import statements
from pyspark.sql import functions as F

from querygrove import prims
from querygrove.functions import lexing
from querygrove.operators import facts, lint, reports, security
from querygrove.operators import statements as op

ACCEPTED = [
    "SELECT 1", "SELECT * FROM users WHERE id = $1", "SELECT * FROM t WHERE a = $1 OR b = $1", "WITH c AS (SELECT 1) SELECT * FROM c",
    "SELECT a FROM t1 UNION SELECT b FROM t2", "SELECT 1 INTERSECT SELECT 2", "SELECT 1 EXCEPT SELECT 2", "SELECT 1; -- trailing comment",
    "(SELECT 1)", "SELECT 1 /* inline */", "select   1",
]
REJECTED = [
    "", "   \n\t  ", "SELECT 1; SELECT 2", "EXPLAIN SELECT 1", "EXPLAIN ANALYZE SELECT 1", "INSERT INTO t VALUES (1)", "UPDATE t SET x = 1",
    "DELETE FROM t", "DROP TABLE t", "CREATE TABLE t (id INT)", "ALTER TABLE t ADD COLUMN x INT", "TRUNCATE TABLE t",
    "SELECT * INTO new_t FROM t", "SELECT * FROM t FOR UPDATE", "SELECT * FROM t FOR SHARE",
    "WITH c AS (INSERT INTO t VALUES (1) RETURNING *) SELECT * FROM c", "BEGIN", "COMMIT", "ROLLBACK", "COPY t FROM stdin", "VACUUM",
    "CALL foo()", "GRANT ALL ON t TO public", "SELECT FROM WHERE", "SELECT 1; DELETE FROM t", "SELECT * FROM (DELETE FROM t RETURNING *) AS sub",
]


def test_admission(spark):
    rows = op.admit_read_only(statements(spark, ACCEPTED + REJECTED)).collect()
    got = {r.unit_id: r for r in rows}
    for i, text in enumerate(ACCEPTED):
        assert got[i].admitted, (text, got[i].detail)
    for i, text in enumerate(REJECTED, len(ACCEPTED)):
        assert not got[i].admitted, text
    assert got[ACCEPTED.index("select   1")].canonical_sql == "select 1"
    assert got[1].has_placeholders and not got[0].has_placeholders


def test_admission_size(spark):
    row = op.admit_read_only(statements(spark, ["SELECT " + "1" * 3000]), max_bytes=1000).first()
    assert row.reason == "input_too_large"


def test_split_and_recovery(spark):
    texts = ["SELECT 1; SELECT 2;", "SELECT 1; SELECT FROM WHERE; SELECT 3;", "SELECT 'hello; world'", "SELECT 1;;;", "﻿SELECT 1",
             "SELECT 1\r\nFROM users", "", "  \n ", "SELECT 'it''s; ok' /* a; b */ -- c; d\n; SELECT 2"]
    rows = op.split_statements(statements(spark, texts).drop("stmt_idx")).collect()
    count = {}
    for r in rows:
        count.setdefault(r.unit_id, []).append((r.stmt_idx, r.sql))
    assert [len(count.get(i, [])) for i in range(len(texts))] == [2, 3, 1, 1, 1, 1, 0, 0, 2]
    assert count[4] == [(0, "SELECT 1")]
    bad = op.malformed_statements(op.split_statements(statements(spark, texts).drop("stmt_idx"))).collect()
    assert [(r.unit_id, r.stmt_idx, r.error) for r in bad] == [(1, 1, "dangling_clause")]


def test_statement_budget_keeps_everything_accounted(spark):
    text = "; ".join(f"SELECT {i}" for i in range(5))
    rows = op.statement_budget(statements(spark, [text]).drop("stmt_idx"), cap=3).collect()
    assert len([r for r in rows if r.error is None]) == 3
    assert [(r.error, r.suppressed) for r in rows if r.error] == [("statement_budget_exceeded", 2)]


def test_deep_nesting_is_exact(spark):
    deep = "SELECT " + "(" * 40 + "1" + ")" * 40 + " FROM t WHERE a = 1"
    broken = "SELECT " + "(" * 40 + "1" + ")" * 39 + " FROM t"
    long_list = "INSERT INTO t VALUES " + ", ".join(f"({i}, 'x;{i}')" for i in range(5000))
    rows = {r.unit_id: r for r in lexing.with_profile(statements(spark, [deep, broken, long_list])).collect()}
    assert rows[0].problem is None and rows[0].kind == "select" and rows[0].prof.where0
    assert rows[1].problem == "unbalanced_parentheses"
    assert rows[2].problem is None and rows[2].kind == "insert"
    assert lexing.token_rows(statements(spark, [deep]), ("unit_id", "stmt_idx")).agg(F.max("inner")).first()[0] == 40


def test_large_script_splits_in_one_row(spark):
    text = ";\n".join(f"SELECT '{'a;' * 20}', {i}" for i in range(20_000))
    assert op.split_statements(statements(spark, [text]).drop("stmt_idx")).count() == 20_000


def test_dialects(spark):
    texts = ["SELECT id::text FROM users WHERE email ILIKE '%@%'", "SELECT * FROM users LIMIT 0, 10", "SELECT TOP 10 * FROM users", "SELECT 1"]
    rows = {r.unit_id: r for r in op.infer_dialect(statements(spark, texts)).collect()}
    assert rows[0].candidates == ["postgres"] and float(rows[0].rank_score) == 0.2
    assert rows[1].candidates == ["mysql"] and rows[2].candidates == ["tsql"] and rows[3].candidates == []
    df = spark.createDataFrame([("Postgres ", None), (None, "mysql"), ("not_real", "postgres"), (" ", " "), (None, None)], "a string, b string")
    got = [r[0] for r in df.select(op.resolve_dialect(F.col("a"), F.col("b"))).collect()]
    assert got == ["postgres", "mysql", "unknown", "unknown", "unknown"]


def test_facts(spark):
    texts = [
        "SELECT a.x, COUNT(*) AS n FROM s.big a JOIN (SELECT y FROM inner_t WHERE z = 1) b ON a.x = b.y, c WHERE a.x IN (SELECT q FROM d) GROUP BY a.x HAVING COUNT(*) > 1",
        "SELECT EXTRACT(YEAR FROM ts) FROM e WHERE a IS DISTINCT FROM b",
    ]
    df = statements(spark, texts)
    rows = facts.facts(df).orderBy("unit_id", "fact_kind", "pos").collect()
    of = lambda u, k: [r.value for r in rows if r.unit_id == u and r.fact_kind == k]
    assert of(0, "table") == ["big", "inner_t", "c", "d"]
    assert of(0, "column") == ["x", "y", "z", "x", "y", "x", "q", "x"]
    assert of(0, "join") == ["JOIN (SELECT y FROM inner_t WHERE z = 1) b ON a.x = b.y", ", c"]
    assert of(0, "predicate") == ["WHERE a.x IN (SELECT q FROM d)", "HAVING COUNT(*) > 1"]
    assert of(1, "table") == ["e"]


def test_token_rows_shuffle_text_not_tokens(spark):
    plan = lexing.token_rows(statements(spark, ["SELECT 1"]), ("unit_id", "stmt_idx"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.index("Exchange hashpartitioning") > plan.rindex("Generate explode(filter(transform")


@pytest.fixture(scope="module")
def units(spark):
    """Statements of three units and one without a key; one statement comes twice, one cannot be read. And their catalogue."""
    texts = [
        (1, 0, "SELECT * FROM orders, customer WHERE o_total = '1'"), (1, 1, "SELECT a FROM orders o LEFT JOIN customer c ON c.id = o.id"),
        (1, 2, "SELECT FROM WHERE"), (2, 0, "SELECT id FROM orders WHERE o_total > (SELECT AVG(q) FROM lines WHERE lines.id = orders.id)"),
        (3, 0, "SELECT FROM WHERE"), (4, 0, "DELETE FROM orders WHERE x = 1"), (4, 0, "DELETE FROM orders WHERE x = 1"),
        (None, 0, "SELECT b FROM lost WHERE c = 2"),
    ]
    stmts = spark.createDataFrame([(u, i, 7, "sql", "query", "postgres", t) for u, i, t in texts], statements(spark, []).schema)
    columns = spark.createDataFrame(
        [(7, "orders", 1, "o_total", 1, "NUMERIC(12,2)"), (7, "lines", 2, "o_total", 1, "TEXT"), (8, "orders", 1, "c", 1, "TEXT")],
        "repo long, tbl string, tbl_ord int, col string, ordinal int, data_type string")
    indexes = spark.createDataFrame(
        [(7, "orders", "i", ["id"], False, False)], "repo long, tbl string, idx string, columns array<string>, is_partial boolean, is_expression boolean")
    warnings = spark.createDataFrame([], "repo long, object_name string, capability string")
    return stmts, (columns, indexes, warnings)


REPORT = {
    1: (2, None, ["orders", "customer", "orders", "customer"], ["o_total", "a", "id", "id"], [", customer", "LEFT JOIN customer c ON c.id = o.id"],
        ["WHERE o_total = '1'"], ["OPT-001", "OPT-003", "OPT-004"], False),
    2: (1, None, ["orders", "lines"], ["id", "o_total", "q", "id", "id"], [],
        ["WHERE o_total > (SELECT AVG(q) FROM lines WHERE lines.id = orders.id)"], ["OPT-002", "OPT-004"], False),
    3: (0, "parse_error", [], [], [], [], [], False),
    4: (2, None, ["orders", "orders"], ["x", "x"], [], ["", "", "WHERE x = 1", "WHERE x = 1"], [], False),
    None: (1, None, [], [], [], [], [], False),
}


@pytest.mark.parametrize("task_text", [1_000_000, 40])
def test_report_of_units_writes_no_tokens(spark, units, monkeypatch, task_text):
    monkeypatch.setattr(prims, "TASK_TEXT", task_text)
    stmts, catalogue = units
    monkeypatch.setattr(type(stmts), "checkpoint", lambda *_, **__: pytest.fail("tokens are written"))
    got = {r.unit_id: (r.statements, r.kind, r.tables, r.columns, r.joins, r.predicates, r.lint_rules, r.truncated)
           for r in reports.analyze_sql(stmts, *catalogue).collect()}
    assert got == REPORT
    found = lint.lint(stmts, *catalogue).select("unit_id", "rule_id").collect()
    assert {(r.unit_id, r.rule_id) for r in found} == {(u, rule) for u, r in REPORT.items() for rule in r[6]}


def test_statements_are_dealt_into_tasks_by_their_text(spark, units, monkeypatch):
    monkeypatch.setattr(prims, "TASK_TEXT", 10)
    dealt = lexing.dealt(units[0], facts.KEYS, by=["unit_id"], keep=("repo", "dialect"))
    size = sum(len(r.sql) for r in units[0].collect())
    assert dealt.rdd.getNumPartitions() == -(-size // 10)
    parts = dealt.select("unit_id", F.spark_partition_id().alias("at")).distinct().collect()
    assert len(parts) == len({r.unit_id for r in parts}) == 5
    # what a reader leaves out is left out above the exchange, which all readers share
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (
        dealt.filter("unit_id IS NOT NULL").select("problem"), facts.statement_tokens(dealt, compared=False), lint.opt_001(dealt))]
    assert len({plan.count("Exchange") for plan in plans}) == 1
    for plan in plans:
        assert "isnotnull(unit_id" not in plan[plan.index("Exchange hashpartitioning"):]


HOST = [
    ('query = f"SELECT * FROM users WHERE id = {user_id}"', True, False), ('msg = f"Hello {name}"', False, False),
    ('query = f"SELECT * FROM users"', False, False), ('query = "SELECT * FROM users WHERE id = 5"', False, False),
    ('query = "SELECT * FROM " + table_name', False, True), ('query = base + " WHERE id = 5"', False, True), ('msg = "Hello " + name', False, False),
]


def test_host_lines(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(HOST)], "i int, line string")
    got = df.orderBy("i").select(security.fstring_sql(F.col("line")), security.concat_sql(F.col("line"))).collect()
    assert [tuple(r) for r in got] == [(f, c) for _, f, c in HOST]


def test_execute_calls(spark):
    sources = ['cursor.execute(query)', 'cursor.execute("SELECT 1 WHERE id = ?", (user_id,))', 'q = 1\ncursor.execute(q)', "x = 1", 'c.execute("a" + b)']
    df = spark.createDataFrame([(str(i), s) for i, s in enumerate(sources)], "unit_id string, content string")
    assert {(r.unit_id, r.line_no, r.method) for r in security.dynamic_execute_calls(df).collect()} == {("0", 1, "execute"), ("2", 2, "execute"), ("4", 1, "execute")}
    assert {r.unit_id: r.safe for r in security.parameterized_files(df).collect()} == {"0": False, "1": True, "2": False, "3": False, "4": False}


def test_execute_calls_over_several_lines(spark):
    sources = ['cur.execute("""SELECT 1""")', 'cur.execute("""\nSELECT 1\n""", (x,))', "a = 1\ncur.execute(\n    'SELECT ' 'a\\'b',\n    (x,))",
               'a = 1\n\ncur.execute(\n  f"""SELECT {x}\n""")\ncur.executemany(\n  sql, rows)', "cur.execute('''a''' + b)"]
    df = spark.createDataFrame([(str(i), s) for i, s in enumerate(sources)], "unit_id string, content string")
    got = {(r.unit_id, r.line_no, r.method) for r in security.dynamic_execute_calls(df).collect()}
    assert got == {("3", 3, "execute"), ("3", 6, "executemany"), ("4", 1, "execute")}
    assert {r.unit_id: r.safe for r in security.parameterized_files(df).collect()} == {"0": True, "1": True, "2": True, "3": False, "4": False}


def test_dollar_quotes_and_nested_comments(spark):
    body = "CREATE FUNCTION f() RETURNS int AS $$ BEGIN DELETE FROM users; UPDATE t SET a = 1; END $$ LANGUAGE plpgsql"
    tagged = "SELECT $t$ it's; $$ -- here $t$, '$$;$$', a$b$c FROM x"
    nested = "SELECT 1 /* a /* b; */ c; */ + 2"
    parts = op.split_statements(statements(spark, [f"{body}; {tagged}; {nested}; SELECT $1"]).drop("stmt_idx")).orderBy("stmt_idx").collect()
    assert [r.sql for r in parts] == [body, tagged, nested, "SELECT $1"]
    got = [r[0] for r in statements(spark, [body, tagged, nested]).orderBy("unit_id").select(lexing.tokens(F.col("sql"))).collect()]
    assert "$$ BEGIN DELETE FROM users; UPDATE t SET a = 1; END $$" in got[0]
    assert got[1][:4] == ["SELECT", "$t$ it's; $$ -- here $t$", ",", "'$$;$$'"] and "a$b$c" in got[1] and got[2] == ["SELECT", "1", "+", "2"]
    units = statements(spark, [body], role="migration").withColumnRenamed("sql", "content").drop("stmt_idx").withColumn("unit_id", F.col("unit_id").cast("string"))
    assert not {"SEC-005", "SEC-006"} & {r.rule_id for r in security.findings(units).collect()}


def test_security_and_user_rule(spark):
    units = statements(spark, ["DROP TABLE users", "DELETE FROM users", "SELECT 1", "UPDATE t SET a = (SELECT 1 WHERE true)"], role="migration")
    units = units.withColumnRenamed("sql", "content").drop("stmt_idx").withColumn("unit_id", F.col("unit_id").cast("string"))
    rule = security.Rule("USR-1", "select", "low", "custom", "sql", ("migration",), False, "fact",
                         lambda u: u.filter(F.col("content").startswith("SELECT")).select("unit_id", F.lit(0).alias("stmt_idx"), F.lit(1).alias("line"), F.lit("m").alias("message")))
    got = {(r.unit_id, r.rule_id) for r in security.findings(units, (rule,)).collect()}
    assert got == {("0", "SEC-003"), ("0", "SEC-007"), ("1", "SEC-005"), ("2", "USR-1"), ("3", "SEC-006")}
    assert security.rule_coverage(units, (rule,)).count() == 10 * 4
