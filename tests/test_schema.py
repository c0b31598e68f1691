from conftest import statements
from pyspark.sql import functions as F

from querygrove.operators import catalogue as ca
from querygrove.operators import lint as li
from querygrove.operators import rewrite as rw


def catalog(spark, columns, indexes=(), warnings=()):
    cols = spark.createDataFrame([(1, t, 1, c, n, ty) for n, (t, c, ty) in enumerate(columns)],
                                 "repo long, tbl string, tbl_ord int, col string, ordinal int, data_type string")
    idx = spark.createDataFrame([(1, *i) for i in indexes],
                                "repo long, tbl string, idx string, columns array<string>, is_partial boolean, is_expression boolean")
    warn = spark.createDataFrame([(1, *w) for w in warnings], "repo long, object_name string, capability string")
    return cols, idx, warn


USERS = [("users", "id", "INT"), ("users", "email", "VARCHAR(255)"), ("users", "age", "INT")]
EMAIL = [("users", "idx_email", ["email"], False, False)]


def rules(spark, texts, cat, dialect="postgres"):
    out = {}
    for r in li.lint(statements(spark, texts, dialect=dialect), *cat).collect():
        out.setdefault(r.unit_id, set()).add(r.rule_id)
    return [out.get(i, set()) for i in range(len(texts))]


def test_lint_cases(spark):
    cat = catalog(spark, USERS, EMAIL)
    got = rules(spark, [
        "SELECT * FROM users", "SELECT id, name FROM users", "SELECT u.* FROM users u",
        "SELECT * FROM t1 WHERE x > (SELECT AVG(y) FROM t2 WHERE t2.k = t1.k)", "SELECT * FROM t1 WHERE x > (SELECT AVG(y) FROM t2)",
        "SELECT id FROM users WHERE id = 'abc'", "SELECT id FROM users WHERE age = 30", "SELECT id FROM users WHERE email = 'x@y.com'",
        "SELECT id FROM users WHERE LOWER(email) = 'x'", "SELECT id FROM users WHERE 'a' = age",
    ], cat)
    assert got == [{"OPT-001"}, set(), {"OPT-001"}, {"OPT-001", "OPT-002"}, {"OPT-001"}, {"OPT-003", "OPT-004"}, {"OPT-004"}, set(), set(),
                   {"OPT-003", "OPT-004"}]


def test_lint_needs_dialect_and_indexes(spark):
    assert rules(spark, ["SELECT id FROM users WHERE age = 'a'"], catalog(spark, USERS, EMAIL), dialect="unknown") == [set()]
    age = ["SELECT age FROM users WHERE age = 30"]
    assert rules(spark, age, catalog(spark, USERS)) == [set()]
    assert rules(spark, age, catalog(spark, USERS, EMAIL, [("users", "column_enumeration")])) == [set()]
    assert rules(spark, age, catalog(spark, USERS, [("users", "i", ["email", "age"], False, False)])) == [{"OPT-004"}]
    assert rules(spark, age, catalog(spark, USERS, [("users", "i", ["age"], True, False)])) == [{"OPT-004"}]
    assert rules(spark, age, catalog(spark, USERS, [("users", "i", ["age"], False, True)])) == [{"OPT-004"}]


def test_star_expansion(spark):
    cols, _, warn = catalog(spark, USERS)
    texts = ["SELECT * FROM users", "SELECT u.* FROM users u", "SELECT * FROM users JOIN orders ON users.id = orders.user_id",
             "WITH cte AS (SELECT * FROM users) SELECT * FROM cte", "SELECT * FROM nonexistent_table", "SELECT * FROM (SELECT * FROM users) AS sub", "SELECT id FROM users"]
    got = {r.unit_id: r for r in rw.star_expansion(statements(spark, texts), cols, warn).collect()}
    assert got[0].rewritten_sql == "SELECT users.id, users.email, users.age FROM users"
    assert got[1].validation_status == "validated"
    assert [got[i].validation_status for i in (2, 3, 4, 5)] == ["withheld"] * 4 and 6 not in got
    warned = catalog(spark, USERS, warnings=[("users", "column_type")])
    assert rw.star_expansion(statements(spark, texts[:1]), warned[0], warned[2]).first().reason.startswith("schema model has a completeness")
    other = rw.star_expansion(statements(spark, texts[:1]), cols, warn, source="introspection").first()
    assert other.validation_status == "withheld"


def events(spark, files):
    rows = [(1, "migrations", n, f"migrations/{n}", c, len(c)) for n, c in files]
    df = spark.createDataFrame(rows, "repo long, root string, name string, path string, content string, size long")
    return df, ca.ddl_events(ca.ordered_migrations(df))


def columns_of(ev):
    return {(r.tbl, r.col): r.data_type for r in ca.schema_state(ev).collect()}


def test_replay(spark):
    _, ev = events(spark, [
        ("001_init.sql", "CREATE TABLE users (id INT PRIMARY KEY, email VARCHAR(255) NOT NULL, age INT);"
         "CREATE TABLE orders (id INT, user_id INT, CONSTRAINT fk FOREIGN KEY (user_id) REFERENCES users(id), CHECK ((id > 0) AND (id IN (1, 2))))"),
        ("002_more.sql", "ALTER TABLE users ADD COLUMN city TEXT, DROP COLUMN age; ALTER TABLE users RENAME COLUMN email TO mail; ALTER TABLE users RENAME COLUMN nope TO x"),
        ("010_ix.sql", "CREATE UNIQUE INDEX i1 ON users (mail); CREATE INDEX i2 ON users (city) WHERE city <> 'x'; CREATE INDEX i3 ON nowhere (a)"),
        ("009_drop.sql", "DROP TABLE IF EXISTS gone"),
    ])
    assert columns_of(ev) == {("users", "id"): "INT", ("users", "mail"): "VARCHAR(255)", ("users", "city"): "TEXT", ("orders", "id"): "INT", ("orders", "user_id"): "INT"}
    assert {(r.idx, tuple(r.cols), r.is_unique, r.is_partial) for r in ca.index_state(ev).collect()} == {("i1", ("mail",), True, False), ("i2", ("city",), False, True)}
    assert [(r.tbl, r.cols, r.ref_tbl) for r in ca.foreign_keys(ev).collect()] == [("orders", ["user_id"], "users")]
    assert [r.nullable for r in ev.filter("op = 'add_column' AND col = 'email'").collect()] == [False]


def test_drop_and_warnings(spark):
    _, ev = events(spark, [("001_a.sql", "CREATE TABLE a (id INT REFERENCES b(id)); CREATE TABLE b (id INT)"), ("002_b.sql", "DROP TABLE b"),
                           ("003_c.sql", "CREATE TRIGGER t BEFORE INSERT ON a FOR EACH ROW BEGIN END; CREATE TYPE m AS ENUM ('x')")])
    assert columns_of(ev) == {("a", "id"): "INT"}
    assert ca.foreign_keys(ev).count() == 0
    got = {r.op: r.compromised for r in ca.ddl_warnings(ev).collect()}
    assert got == {"unsupported_create": [], "unsupported_type": ["column_type"]}


def test_order_and_ambiguity(spark):
    df, _ = events(spark, [("10_c.sql", ""), ("2_b.sql", ""), ("001_a.sql", "")])
    assert [r.name for r in ca.migration_order(df).orderBy("file_ord").collect()] == ["001_a.sql", "2_b.sql", "10_c.sql"]
    assert [r.name for r in ca.migration_order(df, lexical=True).orderBy("file_ord").collect()] == ["001_a.sql", "10_c.sql", "2_b.sql"]
    for files, kind in (([("001_a.sql", ""), ("V1__b.sql", "")], "ambiguous_migration_conventions"), ([("001_a.sql", ""), ("1_b.sql", "")], "duplicate_migration_version")):
        assert [r.kind for r in ca.ambiguous_migrations(events(spark, files)[0]).collect()] == [kind]


def test_rename_chains_match_a_fold(spark):
    import random

    rnd = random.Random(3)
    rows, state, seq = [], {}, 0
    rows.append((1, 0, "t", "create_table", None, None, None))
    for seq in range(1, 200):
        op = rnd.choice(["add_column", "rename_column", "rename_column", "drop_column"])
        a, b, ty = f"c{rnd.randrange(6)}", f"c{rnd.randrange(6)}", f"T{seq}"
        rows.append((1, seq, "t", op, a, b if op == "rename_column" else None, ty))
        if op == "add_column":
            state[a] = ty
        elif op == "drop_column":
            state.pop(a, None)
        elif a in state and a != b:
            state[b] = state.pop(a)
    df = spark.createDataFrame(rows, "repo long, seq long, tbl string, op string, col string, new_col string, data_type string")
    assert {r.col: r.data_type for r in ca.schema_state(df).collect()} == state


def test_type_class(spark):
    df = spark.createDataFrame([("VARCHAR(50)",), (" Int ",), ("numeric(10, 2)",), ("uuid",)], "t string")
    assert [r[0] for r in df.select(li.type_class(F.col("t"))).collect()] == ["text", "integer", "numeric", None]


def test_deep_lists_and_long_files(spark):
    deep = "CREATE TABLE d (a INT CHECK (a > " + "(" * 12 + "1" + ")" * 12 + "), b TEXT DEFAULT 'x, (y', PRIMARY KEY (a))"
    many = "CREATE TABLE m (id INT);" + "SELECT 1;" * 100_000 + "ALTER TABLE m ADD COLUMN late INT"
    _, ev = events(spark, [("001_a.sql", deep), ("002_b.sql", many), ("003_c.sql", "ALTER TABLE m DROP COLUMN late")])
    assert columns_of(ev) == {("d", "a"): "INT", ("d", "b"): "TEXT", ("m", "id"): "INT"}
