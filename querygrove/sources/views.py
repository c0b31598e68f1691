"""SQL artefacts derived from the driver's tables.

Each view is one SELECT over the base tables (or over another view), spelled
once and rendered for Spark and for the oracle engine. All templates are
ASCII and deterministic in the keys, so both engines see the same input.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from querygrove.prims import spread
from querygrove.sources.engines import ORACLE, SPARK

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

_Q = "chr(39)"
_NL = "chr(10)"
_BS = "chr(92)"


def _files(e) -> str:
    return f"""
    SELECT doc_id, dir, name,
           CASE WHEN dir = '.' THEN name ELSE dir || '/' || name END AS path,
           1700000000000000000 + doc_id * 1000000000 AS mtime_ns,
           content,
           {e.octets('content')} AS size
    FROM (
      SELECT doc_id,
        CASE CAST(floor(doc_id / 12) AS BIGINT) % 10
          WHEN 0 THEN '.' WHEN 1 THEN 'src/' || source WHEN 2 THEN 'node_modules/pkg/' || source
          WHEN 3 THEN 'app/dist' WHEN 4 THEN repeat('d/', 21) || 'e' WHEN 5 THEN 'db/migrations'
          WHEN 6 THEN 'docs/' || source WHEN 7 THEN '.querygrove/docs' WHEN 8 THEN 'lib/env'
          ELSE 'svc/' || lang END AS dir,
        CASE doc_id % 12
          WHEN 0 THEN lpad(CAST(doc_id % 1000 AS STRING), 3, '0') || '_init_' || CAST(doc_id AS STRING) || '.sql'
          WHEN 1 THEN 'V' || CAST(doc_id AS STRING) || '__add.sql'
          WHEN 2 THEN 'x' || CAST(doc_id AS STRING) || '.migration.sql'
          WHEN 3 THEN 'report_' || CAST(doc_id AS STRING) || '.sql'
          WHEN 4 THEN 'model_' || CAST(doc_id AS STRING) || '.py'
          WHEN 5 THEN 'svc_' || CAST(doc_id AS STRING) || '.ts'
          WHEN 6 THEN 'cfg_' || CAST(doc_id AS STRING) || '.toml'
          WHEN 7 THEN 'package_' || CAST(doc_id AS STRING) || '-lock.json'
          WHEN 8 THEN 'guide_' || CAST(doc_id AS STRING) || '.md'
          WHEN 9 THEN 'notes_' || CAST(doc_id AS STRING) || '.txt'
          WHEN 10 THEN 'blob_' || CAST(doc_id AS STRING) || '.bin'
          ELSE CASE WHEN doc_id % 36 = 11 THEN 'dist' ELSE 'x' || CAST(doc_id AS STRING) || '.env' END
        END AS name,
        CASE WHEN doc_id % 24 = 10 THEN chr(0) ELSE '' END || text ||
        CASE doc_id % 5 WHEN 1 THEN ' SELECT id FROM t' WHEN 2 THEN ' import sqlalchemy'
          WHEN 3 THEN ' please Join us' WHEN 4 THEN ' a selection was updated' ELSE '' END AS content
      FROM documents
    ) f"""


def _files_prev(e) -> str:
    return """
    SELECT CASE WHEN doc_id % 19 = 0 THEN path || '.old' ELSE path END AS path, mtime_ns,
           CASE WHEN doc_id % 13 = 0 THEN size + 1 ELSE size END AS size, doc_id
    FROM v_files WHERE doc_id % 17 <> 0"""


def _scripts(e) -> str:
    k = "CAST(o_orderkey AS STRING)"
    return f"""
    SELECT o_orderkey AS unit_id, o_custkey AS repo,
      CASE WHEN o_orderkey % 32 = 20 THEN 'mysql' ELSE 'postgres' END AS dialect,
      CASE o_orderkey % 8
        WHEN 0 THEN 'SELECT ' || {k} || ' AS a; SELECT ' || {_Q} || 'x;y' || {_Q} || ' AS b'
        WHEN 1 THEN '-- note; not a split' || {_NL} || 'SELECT * FROM orders WHERE o_orderkey = ' || {k} || ';'
                    || {_NL} || 'DELETE FROM lineitem WHERE l_orderkey = ' || {k} || ';'
        WHEN 2 THEN '/* a; b */ UPDATE orders SET o_totalprice = 1 WHERE o_orderkey = ' || {k} || ';;; SELECT 1'
        WHEN 3 THEN {e.bom()} || 'SELECT 1; SELECT FROM WHERE; SELECT ' || {k}
        WHEN 4 THEN CASE CAST(floor(o_orderkey / 8) AS BIGINT) % 4
          WHEN 0 THEN '   '
          WHEN 1 THEN 'SELECT E' || {_Q} || 'a' || {_BS} || {_Q} || ';b' || {_Q} || ' AS x; SELECT ' || {k} || ' WHERE name = e' || {_Q} || {_BS} || {_BS} || {_Q}
          WHEN 2 THEN 'SELECT ' || {_Q} || 'it' || {_BS} || {_Q} || 's; here' || {_Q} || ' AS b; SELECT "q' || {_BS} || '";r"; SELECT ' || {k}
          ELSE repeat('/* ', 10) || 'x; y' || repeat(' */', 10) || ' SELECT 1; /* a /* b; */ c; */ SELECT ' || {k} END
        WHEN 5 THEN 'SELECT "a;b" FROM t; DROP TABLE tmp_' || {k}
        WHEN 6 THEN 'SELECT (1 + ' || {k} || '; INSERT INTO t VALUES (1, 2); SELECT ' || {_Q} || 'open'
        ELSE 'CREATE TABLE t_' || {k} || ' (' || {_NL} || '  id INT,' || {_NL} || '  note TEXT' || {_NL} || ');'
             || {_NL} || 'CREATE INDEX i_' || {k} || ' ON t_' || {k} || ' (note);' || {_NL} || 'SELECT ' || {_Q} || 'it'
             || {_Q} || {_Q} || 's; ok' || {_Q} || ' FROM t_' || {k} || ';' || {_NL} || 'BOGUS words here;'
             || {_NL} || '-- end'
      END AS sql
    FROM orders"""


def _statements(e) -> str:
    k = "CAST(o_orderkey AS STRING)"
    rows = [
        f"'SELECT * FROM orders WHERE o_orderkey = ' || {k}",
        f"'SELECT c.* FROM customer c WHERE c.c_name = ' || {_Q} || 'n' || {k} || {_Q}",
        f"'SELECT o.o_orderkey, c.c_name FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_totalprice > ' || {k} || '.5'",
        "'SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT AVG(l_quantity) FROM lineitem WHERE lineitem.l_orderkey = orders.o_orderkey)'",
        f"'WITH recent AS (SELECT o_orderkey FROM orders WHERE o_custkey = ' || {k} || ') SELECT * FROM recent'",
        f"'WITH gone AS (DELETE FROM orders WHERE o_orderkey = ' || {k} || ' RETURNING o_orderkey) SELECT o_orderkey FROM gone'",
        "'SELECT o_orderkey FROM orders UNION SELECT l_orderkey FROM lineitem'",
        f"'SELECT o_orderkey FROM orders WHERE o_custkey = ' || {k} || ' FOR UPDATE'",
        f"'SELECT o_orderkey INTO tmp_' || {k} || ' FROM orders'",
        "'SELECT o_orderkey FROM orders WHERE o_custkey = $1'",
        "'DELETE FROM orders'",
        f"'DELETE FROM orders WHERE o_orderkey = ' || {k}",
        "'UPDATE orders SET o_totalprice = 0'",
        f"'UPDATE orders SET o_totalprice = ' || {k} || ' WHERE o_orderkey = ' || {k}",
        f"'DROP TABLE IF EXISTS tmp_' || {k}",
        "'ALTER TABLE orders DROP COLUMN o_comment, DROP COLUMN o_clerk'",
        "'TRUNCATE TABLE lineitem'",
        f"'EXECUTE plan_' || {k} || ' (1)'",
        "'EXPLAIN SELECT o_orderkey FROM orders'",
        f"'SELECT o_orderkey FROM orders WHERE o_orderkey = ' || {_Q} || {k} || {_Q} || ' AND o_orderstatus = ' || {_Q} || 'F' || {_Q}",
        "'SELECT c_custkey FROM customer WHERE c_active = 1 GROUP BY c_custkey HAVING COUNT(*) > 2'",
        "'SELECT x FROM missing_tbl WHERE x = 1'",
        "'SELECT o_missing, o.o_other FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey'",
        "'  '",
        f"'INSERT INTO orders (o_orderkey, o_custkey) VALUES (' || {k} || ', 1)'",
        f"'SELECT o_orderkey::text, ts FROM orders WHERE o_comment ILIKE ' || {_Q} || '%; drop table x%' || {_Q} || ' -- odd; comment'",
        "'SELECT TOP 10 [c_name] FROM customer'",
        "'SELECT * FROM (SELECT o_orderkey FROM orders) AS sub'",
        "'SELECT * FROM orders, customer'",
        "'SELECT FROM WHERE'",
        f"'DROP TABLE tmp_' || {k}",
        f"'SELECT DISTINCT *, 1 AS one FROM lineitem WHERE l_shipdate >= ' || {_Q} || '2020-01-01' || {_Q} || ' AND 5 < l_quantity'",
    ]
    cases = "\n".join(f"        WHEN {i} THEN {text}" for i, text in enumerate(rows))
    return f"""
    SELECT o_orderkey AS unit_id, CAST(0 AS INT) AS stmt_idx, o_custkey AS repo, 'sql' AS input_kind,
      CASE CAST(floor(o_orderkey / 128) AS BIGINT) % 3
        WHEN 0 THEN 'query' WHEN 1 THEN 'migration' ELSE 'script' END AS input_role,
      CASE CAST(floor(o_orderkey / 32) AS BIGINT) % 4
        WHEN 1 THEN 'mysql' WHEN 2 THEN 'unknown' ELSE 'postgres' END AS dialect,
      CASE o_orderkey % 32
{cases}
      END AS sql
    FROM orders"""


def _source(e) -> str:
    k = "CAST(p_partkey AS STRING)"
    return f"""
    SELECT 'src/f' || {k} || '.py' AS unit_id, p_partkey, p_partkey % 100 AS repo,
      'import sqlite3' || {_NL} ||
      CASE p_partkey % 8
        WHEN 0 THEN 'q = f"SELECT * FROM users WHERE id = {{uid}}"' || {_NL} || 'cur.execute(q)'
        WHEN 1 THEN 'q = "SELECT * FROM " + name' || {_NL} || 'cur.execute(q, (1,))'
        WHEN 2 THEN 'cur.execute("SELECT * FROM t WHERE id = ?", (' || {k} || ',))'
        WHEN 3 THEN 'msg = f"Hello {{name}}"' || {_NL} || 'x = "a" + b'
        WHEN 4 THEN 'q = base + " WHERE id = 5"' || {_NL} || 'cur.executemany(q)' || {_NL} || 'cur.execute("SELECT 1")'
        WHEN 5 THEN 'q = "SELECT * FROM users"' || {_NL} || 'conn.cursor().execute(build(1), args)'
        WHEN 6 THEN 'q = f"SELECT * FROM users"'
        ELSE CASE CAST(floor(p_partkey / 8) AS BIGINT) % 4
          WHEN 0 THEN '# nothing here'
          WHEN 1 THEN '# cur.execute(q)' || {_NL} || 's = "cur.execute(q)"'
          WHEN 2 THEN repeat('"', 3) || {_NL} || 'cur.execute(x)' || {_NL} || repeat('"', 3) || {_NL} || 'cur.execute(build(cur.fetch("a, b"), [1, 2]),' || {_NL} || '  timeout=3)'
          ELSE 'cur.execute(outer(cur.executemany(q), {{1: 2}}), 1)  # cur.execute(z)' || {_NL} || 'cur.execute(r"a" "b", x)' END
      END || {_NL} || 'done = True' AS content
    FROM part"""


def _units(e) -> str:
    return """
    SELECT CAST(unit_id AS STRING) AS unit_id, repo, input_kind, input_role, dialect, sql AS content
    FROM v_statements
    UNION ALL
    SELECT unit_id, repo, 'python_source' AS input_kind, 'script' AS input_role, 'postgres' AS dialect, content
    FROM v_source"""


_COLUMNS = (
    ("orders", 1, "o_orderkey", 1, "INTEGER"), ("orders", 1, "o_custkey", 2, "INT"),
    ("orders", 1, "o_orderstatus", 3, "CHAR(1)"), ("orders", 1, "o_totalprice", 4, "NUMERIC(12,2)"),
    ("orders", 1, "o_orderdate", 5, "DATE"), ("orders", 1, "o_comment", 6, "TEXT"),
    ("customer", 2, "c_custkey", 1, "BIGINT"), ("customer", 2, "c_name", 2, "VARCHAR(50)"),
    ("customer", 2, "c_active", 3, "BOOLEAN"),
    ("lineitem", 3, "l_orderkey", 1, "BIGINT"), ("lineitem", 3, "l_quantity", 2, "DOUBLE"),
    ("lineitem", 3, "l_shipdate", 3, "TIMESTAMP"), ("lineitem", 3, "o_totalprice", 4, "TEXT"),
    ("events", 4, "ts", 1, "TIMESTAMPTZ"), ("events", 4, "ref", 2, "UUID"),
)

_INDEXES = (
    ("orders", "idx_orders_key", "o_orderkey", 0, 0),
    ("orders", "idx_orders_cust", "o_custkey,o_orderdate", 0, 0),
    ("orders", "idx_orders_status", "o_orderstatus", 1, 0),
    ("customer", "idx_customer_name", "c_name", 0, 0),
    ("customer", "idx_customer_lower", "lower(c_active)", 0, 1),
)


def _values(rows: Iterable[tuple]) -> str:
    def one(v):
        return str(v) if isinstance(v, int) else "'" + v + "'"

    return ", ".join("(" + ", ".join(one(v) for v in row) + ")" for row in rows)


def _cat_columns(e) -> str:
    return f"""
    SELECT c.c_custkey AS repo, t.tbl, t.tbl_ord, t.col, t.ordinal, t.data_type
    FROM customer c, (VALUES {_values(_COLUMNS)}) AS t(tbl, tbl_ord, col, ordinal, data_type)"""


def _cat_indexes(e) -> str:
    return f"""
    SELECT c.c_custkey AS repo, t.tbl, t.idx, t.cols, t.p = 1 AS is_partial, t.x = 1 AS is_expression
    FROM customer c, (VALUES {_values(_INDEXES)}) AS t(tbl, idx, cols, p, x)
    WHERE NOT (c.c_custkey % 7 = 0 AND t.tbl = 'customer')"""


def _cat_warnings(e) -> str:
    return """
    SELECT c_custkey AS repo, 'customer' AS object_name, 'column_enumeration' AS capability
    FROM customer WHERE c_custkey % 5 = 0"""


def _migrations(e) -> str:
    s = "CAST(s_suppkey AS STRING)"
    body = f"""CASE n
          WHEN 1 THEN 'CREATE TABLE users (id SERIAL PRIMARY KEY, email VARCHAR(255) NOT NULL UNIQUE, age INT DEFAULT 18);' || {_NL}
               || 'CREATE TABLE orders (id INT, user_id INT REFERENCES users(id), amount NUMERIC(10,2) NOT NULL, PRIMARY KEY (id));' || {_NL}
               || 'CREATE UNIQUE INDEX idx_email ON users (email);'
          WHEN 2 THEN 'ALTER TABLE users ADD COLUMN city_' || {s} || ' TEXT;' || {_NL} || 'ALTER TABLE users DROP COLUMN age;' || {_NL}
               || 'CREATE TABLE items (id BIGINT, order_id INT, qty INT, CHECK (qty > 0), FOREIGN KEY (order_id) REFERENCES orders (id));' || {_NL}
               || 'CREATE INDEX idx_qty ON items (qty) WHERE qty > 1;' || {_NL} || 'ALTER TABLE nowhere ADD COLUMN x INT;'
          WHEN 3 THEN CASE WHEN s_suppkey % 3 = 0 THEN 'DROP TABLE orders;' || {_NL} || 'CREATE TYPE mood AS ENUM (' || {_Q} || 'a' || {_Q} || ');'
                    || ' ALTER TABLE users ADD COLUMN feel mood;'
               ELSE 'ALTER TABLE orders RENAME COLUMN amount TO total;' || {_NL} || 'DROP INDEX idx_qty;' || {_NL}
                    || 'CREATE INDEX idx_lower ON users (lower(email));' END
          ELSE CASE WHEN s_suppkey % 2 = 0 THEN 'CREATE TABLE users (uid BIGINT NOT NULL, nick TEXT);' || {_NL} || 'CREATE VIEW v AS SELECT 1;'
               ELSE 'ALTER TABLE items ADD COLUMN note VARCHAR(20);' || {_NL} || 'INSERT INTO users VALUES (1);' || {_NL}
                    || 'CREATE TRIGGER trg BEFORE INSERT ON users FOR EACH ROW EXECUTE PROCEDURE f();'
                    || CASE WHEN s_suppkey % 5 = 0 THEN ' ALTER TABLE items ADD CHECK (qty > (1;' ELSE '' END END
        END"""
    return f"""
    SELECT repo, root, name, root || '/' || name AS path, content, {e.octets('content')} AS size
    FROM (
      SELECT s_suppkey AS repo,
        CASE WHEN s_suppkey % 9 = 5 AND n > 2 THEN 'sql/migrations' WHEN s_suppkey % 2 = 0 THEN 'migrations'
             ELSE 'db/migrations' END AS root,
        CASE
          WHEN s_suppkey % 9 = 1 THEN 'V' || CAST(n * n * n AS STRING) || '__step.sql'
          WHEN s_suppkey % 9 = 2 THEN '2024010' || CAST(n AS STRING) || '_step.sql'
          WHEN s_suppkey % 9 = 3 AND n = 4 THEN 'V4__mixed.sql'
          WHEN s_suppkey % 9 = 4 AND n = 4 THEN '3_again.sql'
          WHEN s_suppkey % 9 = 6 THEN '202401010' || CAST(n AS STRING) || '_step.sql'
          WHEN s_suppkey % 9 = 7 AND n = 4 THEN 'readme.sql'
          WHEN s_suppkey % 9 = 8 THEN CASE WHEN n = 4 THEN '10' ELSE CAST(n AS STRING) END || '_step.sql'
          ELSE lpad(CAST(n AS STRING), 3, '0') || '_step.sql' END AS name,
        {body} AS content
      FROM supplier, (VALUES (1), (2), (3), (4)) AS f(n)
      WHERE s_suppkey % 31 <> 30
    ) m"""


def _repo_statements(e) -> str:
    return """
    SELECT s_suppkey * 4 + t AS unit_id, CAST(0 AS INT) AS stmt_idx, s_suppkey AS repo, 'query' AS input_role, 'postgres' AS dialect,
      CASE t WHEN 0 THEN 'SELECT * FROM users' WHEN 1 THEN 'SELECT * FROM items' WHEN 2 THEN 'SELECT id FROM items WHERE order_id = 5'
        ELSE 'SELECT id FROM users WHERE email = 7' END AS sql
    FROM supplier, (VALUES (0), (1), (2), (3)) AS g(t)"""


def _ddl_events(e) -> str:
    return """
    SELECT user_id % 20 AS repo, event_id AS seq, 't' || CAST(event_id % 5 AS STRING) AS tbl,
      CASE event_type WHEN 'signup' THEN 'create_table' WHEN 'view' THEN 'add_column' WHEN 'click' THEN CASE WHEN event_id % 4 = 0 THEN 'rename_column' ELSE 'add_column' END
        WHEN 'error' THEN 'drop_column' ELSE CASE WHEN event_id % 10 < 3 THEN 'drop_table' ELSE 'add_column' END END AS op,
      'c' || CAST(event_id % 7 AS STRING) AS col,
      CASE WHEN event_type = 'click' AND event_id % 4 = 0 THEN 'c' || CAST(event_id % 11 AS STRING) END AS new_col,
      CASE event_id % 4 WHEN 0 THEN 'INT' WHEN 1 THEN 'VARCHAR(20)' WHEN 2 THEN 'TIMESTAMPTZ' ELSE 'GEOMETRY' END AS data_type
    FROM events"""


def _schema_requests(e) -> str:
    return """
    SELECT user_id % 20 AS repo, CAST(floor(max(event_id) * v / 3) AS BIGINT) AS version
    FROM events, (VALUES (1), (2)) AS g(v) GROUP BY user_id % 20, v"""


def _plan_lines(e) -> str:
    return """
    SELECT l_orderkey AS query_id,
      row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS n,
      CASE l_linenumber % 5 WHEN 0 THEN 'Seq Scan' WHEN 1 THEN 'Hash Join' WHEN 2 THEN 'Index Scan'
        WHEN 3 THEN 'Nested Loop' ELSE 'Sort' END AS op,
      't' || CAST(l_suppkey % 10 AS STRING) AS relation,
      CAST(floor(l_extendedprice) AS BIGINT) AS cost, CAST(floor(l_quantity) AS BIGINT) AS n_rows,
      l_partkey AS lit
    FROM lineitem"""


def _plans(e) -> str:
    text = "CAST({} AS STRING)".format
    head = f"""'"Node Type": "' || op || '", "Total Cost": ' || {text('cost')} || '.25, "Plan Rows": ' || {text('n_rows')}
        || ', "Plan Width": ' || CASE WHEN n % 4 = 0 THEN '"wide"' ELSE '8' END
        || CASE WHEN op IN ('Seq Scan', 'Index Scan') THEN ', "Relation Name": "' || relation || '"' ELSE '' END
        || CASE WHEN op = 'Index Scan' THEN ', "Index Name": "i_' || relation || '", "Index Cond": "(id = ' || {text('lit')} || ')"' ELSE '' END
        || CASE WHEN op = 'Seq Scan' THEN ', "Filter": ["(a = ' || chr(39) || 'v' || {text('lit')} || chr(39) || ')", "(b > ' || {text('n_rows')} || '.5)"]' ELSE '' END
        || CASE WHEN op = 'Hash Join' THEN ', "Hash Cond": "(x.id = y.id)"' ELSE '' END"""

    def at(i: int) -> str:
        return f"max(CASE WHEN n = {i} THEN head END)"

    def node(i: int, kids: str) -> str:
        return f"CASE WHEN h{i} IS NULL THEN '' ELSE '{{' || h{i} || {kids} || '}}' END"

    def two(a: str, b: str) -> str:
        return (f"CASE WHEN {a} = '' THEN '' ELSE ', \"Plans\": [' || {a} || CASE WHEN {b} = '' THEN '' "
                f"ELSE ', ' || {b} END || ']' END")

    return f"""
    SELECT query_id,
      CASE WHEN query_id % 50 = 7 THEN 'not json' WHEN query_id % 50 = 8 THEN '[]' WHEN query_id % 50 = 9 THEN '[{{"Other": 1}}]'
        WHEN query_id % 50 = 10 THEN '[{{"Plan": "text"}}]'
        ELSE '[{{"Plan": ' || n1 || CASE WHEN query_id % 3 = 0 THEN ', "Planning Time": 0.5' ELSE '' END
             || ', "Settings": {{"work_mem": "' || CAST(query_id % 64 AS STRING) || 'MB", "jit": "off", "custom_guc": "leak"}}}}]'
      END AS plan_json
    FROM (
      SELECT query_id, {node(1, two('n2', 'n3'))} AS n1
      FROM (
        SELECT query_id, h1, {node(2, two('n4', 'n5'))} AS n2, {node(3, two('n6', 'n7'))} AS n3
        FROM (
          SELECT query_id, h1, h2, h3, {node(4, "''")} AS n4, {node(5, "''")} AS n5, {node(6, "''")} AS n6,
            {node(7, "CASE WHEN rest IS NULL THEN '' ELSE ', " + '"Plans": ' + "[' || rest || ']' END")} AS n7
          FROM (
            SELECT query_id, {at(1)} AS h1, {at(2)} AS h2, {at(3)} AS h3, {at(4)} AS h4, {at(5)} AS h5, {at(6)} AS h6, {at(7)} AS h7,
              {e.joined("CASE WHEN n > 7 THEN '{' || head || '}' END", 'n')} AS rest
            FROM (SELECT query_id, n, {head} AS head FROM v_plan_lines) heads
            GROUP BY query_id
          ) a
        ) b
      ) c
    ) d"""


def _plan_pairs(e) -> str:
    return """
    SELECT query_id,
      CASE WHEN query_id % 11 = 0 THEN NULL WHEN query_id % 11 = 1 THEN CAST(0 AS DOUBLE) ELSE CAST(max(cost) AS DOUBLE) END AS original_cost,
      CASE WHEN query_id % 13 = 0 THEN NULL ELSE CAST(min(cost) AS DOUBLE) END AS candidate_cost,
      CASE WHEN query_id % 7 = 0 THEN NULL ELSE max(n_rows) END AS original_rows,
      min(n_rows) AS candidate_rows, min(relation) AS relation
    FROM v_plan_lines GROUP BY query_id"""


def _candidates(e) -> str:
    return """
    SELECT query_id, n AS candidate_id,
      CASE WHEN lit % 5 = 0 THEN 'withheld' ELSE 'validated' END AS validation_status,
      CASE WHEN lit % 7 = 0 THEN 'withheld' ELSE 'passed' END AS security_status,
      CASE lit % 4 WHEN 0 THEN 'SELECT id FROM ' || relation || ' FOR UPDATE' WHEN 1 THEN 'DELETE FROM ' || relation
        ELSE 'SELECT id FROM ' || relation || ' WHERE id = ' || CAST(lit AS STRING) END AS sql,
      CASE WHEN lit % 3 = 0 THEN NULL ELSE CAST(cost AS DOUBLE) END AS candidate_cost,
      CASE WHEN lit % 3 = 0 THEN NULL ELSE n_rows END AS candidate_rows,
      CASE WHEN lit % 3 = 0 THEN 'statement timeout' END AS failure
    FROM v_plan_lines"""


def _errors(e) -> str:
    i = "CAST(event_id AS STRING)"
    texts = (
        "'ERROR: syntax error at or near \"FROM\"'", f"'ERROR: column \"c' || {i} || '\" does not exist'",
        f"'ERROR: relation \"t' || {i} || '\" does not exist'", "'ERROR: operator does not exist: text = integer'",
        "'ERROR: datatype mismatch'", "'ERROR: invalid input syntax for type integer: \"abc\"'",
        "'ERROR: duplicate key value violates unique constraint'", "'update or delete violates foreign key constraint'",
        "'ERROR: relation \"x\" already exists'", "'ERROR: permission denied for table users'", "'ERROR: deadlock detected'",
        "'ERROR: canceling statement due to statement timeout'", "'FATAL: too many connections'",
        "'ERROR: cannot drop table a because other objects depend on it'", "'ERROR: 42703'", "'could not connect to server: Connection refused'",
        "'connection timed out after 30s'", f"'something unrelated ' || {i}", "''",
        "repeat('long error ', 7000)", "'ERROR: 42P01 relation does not exist; connection refused'",
        f"'failed on id = ' || {i} || ' near ' || {_Q} || 'bob' || {_Q}",
    )
    cases = "\n".join(f"        WHEN {n} THEN {t}" for n, t in enumerate(texts))
    return f"""
    SELECT event_id, user_id, user_id % 100 AS repo, {e.epoch('ts')} AS at_s,
      CASE WHEN user_id % 3 = 0 THEN 'mysql' ELSE 'postgres' END AS dialect,
      CASE event_id % 22
{cases}
      END AS error_text,
      CASE event_id % 4 WHEN 0 THEN 'SELECT o_orderkey, o_gone FROM orders' WHEN 1 THEN 'SELECT a FROM lost_table'
        WHEN 2 THEN 'SELECT customer.c_name, lineitem.zzz FROM lineitem JOIN customer ON c_custkey = l_orderkey' END AS sql
    FROM events WHERE event_type = 'error'"""


def _docs(e) -> str:
    return f"""
    SELECT CASE doc_id % 4 WHEN 0 THEN 'docs/' WHEN 1 THEN '.querygrove/docs/' WHEN 2 THEN 'docs/sub/' ELSE 'other/' END
             || source || '/d' || CAST(doc_id AS STRING) || CASE WHEN doc_id % 9 = 8 THEN '.txt' ELSE '.md' END AS path,
      CASE WHEN doc_id % 3 = 0 THEN '---' || {_NL} || 'Keywords: "' || lang || ' the of"' || {_NL} || 'owner: team' || {_NL} || '---' || {_NL} ELSE '' END
      || CASE WHEN doc_id % 2 = 0 THEN 'Preamble for ' || lang || {_NL} ELSE '' END
      || '# ' || source || {_NL} || text || {_NL} || '## doc ' || CAST(doc_id AS STRING) || ' that' || {_NL} || 'See the index of ' || source || {_NL}
      || '#not a heading' AS content,
      n_chars
    FROM documents"""


def _queries(e) -> str:
    return """
    SELECT item_id AS query_id, CASE WHEN item_id % 4 = 0 THEN text || ' that that doc' ELSE text END AS query
    FROM benchmark"""


def _requirements(e) -> str:
    k = "CAST(p_partkey AS STRING)"
    word = e.capital("CASE WHEN position(' ' IN p_name) > 0 THEN substr(p_name, 1, position(' ' IN p_name) - 1) ELSE p_name END")
    return f"""
    SELECT p_partkey AS doc_id, p_partkey % 100 AS repo,
      CASE WHEN p_partkey % 7 = 6 THEN 'something vague about ' || p_name
        WHEN p_partkey % 7 = 5 THEN '  '
        WHEN p_partkey % 7 = 4 THEN 'We need a table called customer. A record named orders. The orders has amount and unitPrice, itemCount.'
        ELSE 'Keep a table called {{w}}Item' || {k} || '. Each {{w}}Item' || {k} || ' has name, email, createdTimestamp, unitPrice, id and account. Also an entity OrderLine. OrderLine with quantity and birthDate.'
      END AS requirements
    FROM part""".replace("{w}", "' || " + word + " || '")


def _results(e) -> str:
    return f"""
    SELECT 'k' || CAST(o_custkey AS STRING) AS key, o_orderkey AS write_id,
      CASE o_orderkey % 5 WHEN 0 THEN 'scan' WHEN 1 THEN 'analysis' WHEN 2 THEN 'security' WHEN 3 THEN 'explain' ELSE 'design' END AS domain,
      CASE WHEN o_orderkey % 17 = 0 THEN 'broken {{' WHEN o_orderkey % 17 = 1 THEN '{{"kind": "x"}}'
        ELSE '{{"kind": "ok", "rows": ' || CAST(o_orderkey % 100 AS STRING) || '}}' END AS value,
      CAST(floor(o_totalprice) AS BIGINT) AS size, {e.epoch('o_orderdate')} AS created,
      CASE WHEN o_orderkey % 3 = 0 THEN 3600 * 24 * 365 WHEN o_orderkey % 3 = 1 THEN 3600 * 24 * 3000 END AS ttl
    FROM orders"""


def _task_refs(e) -> str:
    return f"""
    SELECT 'task' || CAST(user_id AS STRING) AS task_id, event_id, 'k' || CAST(event_id % 40 AS STRING) AS cache_key,
      CASE event_type WHEN 'view' THEN 'context_map' WHEN 'click' THEN 'schema_model' WHEN 'error' THEN 'debug'
        WHEN 'signup' THEN 'design' ELSE 'analysis' END AS artifact_type,
      {e.epoch('ts')} AS at_s
    FROM events"""


def _tool_events(e) -> str:
    return f"""
    SELECT event_id, user_id, event_type AS name, 1 + event_id % 3 AS n, {e.epoch('ts')} AS at_s,
      '{{"token": "s' || CAST(event_id AS STRING) || '", "url": "http://h/' || CAST(user_id AS STRING)
        || '", "database_url_env": "DB_URL", "k": "' || CAST(event_id % 9 AS STRING) || '"}}' AS fields_json
    FROM events"""


def _documents(e) -> str:
    return f"""
    SELECT doc_id, '(note = ' || {_Q} || replace(text, {_Q}, ' ') || {_Q} || ' AND n = ' || CAST(n_chars AS STRING)
      || CASE WHEN doc_id % 6 = 0 THEN ' AND (broken' ELSE '' END || ' AND lang <> col_1 AND price >= 3.14)' AS expression, text
    FROM documents"""


VIEWS = {
    "v_files": (_files, ()), "v_files_prev": (_files_prev, ("v_files",)), "v_scripts": (_scripts, ()),
    "v_statements": (_statements, ()), "v_source": (_source, ()), "v_units": (_units, ("v_statements", "v_source")),
    "v_cat_columns": (_cat_columns, ()), "v_cat_indexes": (_cat_indexes, ()), "v_cat_warnings": (_cat_warnings, ()),
    "v_migrations": (_migrations, ()), "v_ddl_events": (_ddl_events, ()), "v_schema_requests": (_schema_requests, ()), "v_repo_statements": (_repo_statements, ()), "v_plan_lines": (_plan_lines, ()),
    "v_plans": (_plans, ("v_plan_lines",)), "v_plan_pairs": (_plan_pairs, ("v_plan_lines",)),
    "v_candidates": (_candidates, ("v_plan_lines",)), "v_errors": (_errors, ()), "v_docs": (_docs, ()),
    "v_queries": (_queries, ()), "v_requirements": (_requirements, ()), "v_results": (_results, ()),
    "v_task_refs": (_task_refs, ()), "v_tool_events": (_tool_events, ()), "v_documents": (_documents, ()),
}


#: Views whose short rows become texts that cost much to read: their base tables are dealt out first.
_DEALT = ("v_statements", "v_requirements", "v_errors")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Spark DataFrame of a derived view."""
    build, needs = VIEWS[name]
    text = build(SPARK)
    for need in needs:
        view(spark, sf_dir, need).createOrReplaceTempView(need)
    for base in TABLES:
        if re.search(rf"\b(FROM|JOIN)\s+{base}\b", text):
            rows = table(spark, sf_dir, base)
            (spread(rows) if name in _DEALT else rows).createOrReplaceTempView(base)
    return spark.sql(text)


def oracle(names: str, body: str) -> str:
    """Oracle SQL: the named views (space separated) as common tables, then ``body``.

    ``body`` may start with a comma and more common tables.
    """
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in VIEWS[name][1]:
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        add(name)
    parts = ", ".join(f"{name} AS ({VIEWS[name][0](ORACLE)})" for name in ordered)
    return f"WITH {parts} {body}" if parts else body
