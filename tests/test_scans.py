"""Scans along keys, selections by weight, replay of schema changes, retrieval, and readers of code, against plain versions."""

import ast
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from querygrove import prims, refdata
from querygrove.operators import catalogue, docs, errors, files, results, security, statements, tasks


@pytest.fixture(scope="module")
def uses(spark):
    """A key with half of all rows, others with few, and a null one."""
    rnd = random.Random(2)
    rows = [("hot" if i % 2 else rnd.choice(["a", "b", None, "z"]), rnd.randrange(10_000) * 1000 + i, rnd.randrange(-5, 9)) for i in range(900)]
    return rows, spark.createDataFrame(rows, "k string, at long, v int").repartition(5)


def test_scan_of_keys_that_cross_ranges(spark, uses):
    rows, df = uses
    kinds = {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "p": ("max_before", F.struct("at", "v")), "n": ("next", F.struct("at", "v")), "t": ("total", F.col("v"))}
    got = {(r.k, r.at): (r.s, r.m, r.p and tuple(r.p), r.n and tuple(r.n), r.t) for r in prims.segmented(df, ["k"], ["at"], kinds, partitions=7).collect()}
    for key in {k for k, _, _ in rows}:
        mine = sorted((at, v) for k, at, v in rows if k == key)
        for i, (at, _) in enumerate(mine):
            seen = [v for _, v in mine[:i + 1]]
            wanted = (sum(seen), max(seen), mine[i - 1] if i else None, mine[i + 1] if i + 1 < len(mine) else None, sum(v for _, v in mine))
            assert got[key, at] == wanted


def test_a_hot_key_spreads_over_ranges(spark, uses, monkeypatch):
    seen = []
    cut = prims.cut_lineage
    monkeypatch.setattr(prims, "cut_lineage", lambda df: seen.append(cut(df)) or seen[-1])
    prims.segmented(uses[1], ["k"], ["at"], {"s": ("sum", F.lit(1))}, partitions=8)
    parts = seen[0].filter("k = 'hot'").groupBy("_part").count().collect()
    assert len(parts) >= 4 and max(r["count"] for r in parts) < 300


def test_usage_windows_of_a_hot_user(spark):
    rnd = random.Random(7)
    rows = [(i, 1 if i % 3 else rnd.randrange(5), rnd.randrange(200_000)) for i in range(400)]
    got = {r.event_id: r for r in tasks.usage_by_user_window(spark.createDataFrame(rows, "event_id long, user_id long, at_s long")).collect()}
    for user in {u for _, u, _ in rows}:
        mine = sorted((at, e) for e, u, at in rows if u == user)
        for i, (at, e) in enumerate(mine):
            r, n = got[e], len(mine)
            sizes = [n // 4 + (q < n % 4) for q in range(4)]
            assert (r.running, r.prev_at, r.next_at) == (i + 1, mine[i - 1][0] if i else None, mine[i + 1][0] if i + 1 < n else None)
            assert r.quartile == next(q for q in range(1, 5) if i < sum(sizes[:q])) and r.session_start == (i == 0 or at - mine[i - 1][0] > 3600)


@pytest.mark.parametrize(("window", "borders"), [(100_000, 63), (12, 5), (0, 4)])
def test_selections_by_weight(spark, monkeypatch, window, borders):
    monkeypatch.setattr(prims, "WINDOW_ROWS", window)
    monkeypatch.setattr(results, "WINDOW_ROWS", window)
    monkeypatch.setattr(prims, "BORDERS", borders)
    rnd = random.Random(window + borders)
    rows = [(f"k{i}", i, rnd.randrange(40), rnd.randrange(30)) for i in range(150)]
    df = spark.createDataFrame(rows, "key string, write_id long, created long, size long")
    for limit in (0, 700, 10**9):
        wanted, used = {}, 0
        for key, _, _, size in sorted(rows, key=lambda r: (-r[2], -r[1])):
            used += size
            if used > limit:
                break
            wanted[key] = used
        assert {r.key: r.run for r in results.retain_by_size(df, limit, running="run").collect()} == wanted
        assert {r.key for r in results.retain_by_size(df, limit).collect()} == set(wanted)


@pytest.mark.parametrize(("window", "borders"), [(100_000, 63), (9, 4)])
def test_scan_budgets(spark, monkeypatch, window, borders):
    monkeypatch.setattr(prims, "WINDOW_ROWS", window)
    monkeypatch.setattr(prims, "BORDERS", borders)
    rnd = random.Random(window)
    rows = []
    for i in range(120):
        name = rnd.choice(["q.sql", "m.py", "x.txt"])
        rows.append((f"d{i:03d}/{name}", f"d{i:03d}", name, name.rpartition(".")[2], rnd.randrange(1, 50), None if name == "x.txt" else "query", None))
    df = spark.createDataFrame(rows, "path string, dir string, name string, ext string, size long, classification string, skip_reason string")
    for count, room in ((10**6, 10**6), (17, 10**6), (10**6, 400), (10**6, 40), (30, 300)):
        wanted, used, stopped = [], 0, False
        for path, _, name, _, size, label, _ in sorted(rows):
            if len(wanted) >= count or (not name.endswith(".sql") and used + size > room):
                stopped = True
                break
            if label:
                wanted.append(path)
                used += 0 if name.endswith(".sql") else size
        got = files.admit_within_budget(df, count, room).collect()
        assert sorted(r.path for r in got) == wanted and {r.truncated for r in got} <= {stopped}


CHANGES = "repo long, seq long, tbl string, op string, col string, new_col string, data_type string"


def folded(rows, repo, version):
    tables = {}
    for r, _, tbl, op, col, new, kind in sorted(row for row in rows if row[0] == repo and row[1] <= version):
        if op == "create_table":
            tables[tbl] = {}
        elif op == "drop_table":
            tables.pop(tbl, None)
        elif tbl in tables and op == "add_column":
            tables[tbl][col] = kind
        elif tbl in tables and op == "drop_column":
            tables[tbl].pop(col, None)
        elif tbl in tables and op == "rename_column" and col != new and col in tables[tbl]:
            tables[tbl][new] = tables[tbl].pop(col)
    return {(t, c, k) for t, cols in tables.items() for c, k in cols.items()}


def test_schema_at_any_version_matches_a_fold(spark):
    rnd = random.Random(9)
    ops = ["create_table", "drop_table"] + ["add_column"] * 6 + ["rename_column"] * 8 + ["drop_column"] * 2
    rows = []
    for seq in range(500):
        op = rnd.choice(ops)
        rows.append((rnd.randrange(2), seq, rnd.choice("tu"), op, f"c{rnd.randrange(5)}", f"c{rnd.randrange(5)}" if op == "rename_column" else None, f"T{seq}"))
    df = spark.createDataFrame(rows, CHANGES)
    asked = [(repo, version) for repo in (0, 1) for version in (0, 63, 64, 201, 350, 499, 10**6)]
    got = {a: set() for a in asked}
    for r in catalogue.schema_as_of(df, spark.createDataFrame(asked, "repo long, version long")).collect():
        got[r.repo, r.version].add((r.tbl, r.col, r.data_type))
    assert got == {a: folded(rows, *a) for a in asked}
    assert {(r.repo, r.tbl, r.col, r.data_type) for r in catalogue.schema_state(df).collect()} == {(repo, *c) for repo in (0, 1) for c in folded(rows, repo, 10**6)}


def test_a_chain_of_renames(spark):
    rows = [(1, 0, "t", "create_table", None, None, None), (1, 1, "t", "add_column", "c0", None, "INT")]
    rows += [(1, i + 2, "t", "rename_column", f"c{i}", f"c{i + 1}", None) for i in range(64)]
    df = spark.createDataFrame(rows, CHANGES)
    assert [tuple(r) for r in catalogue.schema_state(df).collect()] == [(1, "t", "c64", "INT")]
    asked = spark.createDataFrame([(1, 1), (1, 33)], "repo long, version long")
    assert sorted((r.version, r.col) for r in catalogue.schema_as_of(df, asked).collect()) == [(1, "c0"), (33, "c32")]


def test_required_literals_hold_for_every_pattern(spark):
    assert errors.required_literals(r"\b42703\b|column .* does not exist") == ("42703", " does not exist")
    assert errors.required_literals("a+b") is None
    texts = ["ERROR: COLUMN \"x\" Does Not Exist", "42P01", "x42P01", "timed out", "long error " * 7000, "cannot drop x because other objects depend on it", " \n", "Timeout Expired!"]
    df = spark.createDataFrame([(i, d, t) for i, t in enumerate(texts) for d in ("postgres", "mysql")], "event_id int, dialect string, error_text string")
    for r in errors.triage(df).collect():
        wanted = {e[0] for e in refdata.ERROR_CATALOG if e[2] in ("any", r.dialect) and re.search(e[1], r.error_text, re.I)}
        assert {m.catalog_id for m in r.matches} == wanted


def test_best_sections_inside_a_task(spark, monkeypatch):
    rnd = random.Random(1)
    word = lambda: rnd.choice(["join", "index", "lock", "vacuum", "plan", "of"])
    rows = [(f"s{i % 40}", i, " ".join(word() for _ in range(2)), word() if i % 3 else "", " ".join(word() for _ in range(rnd.randrange(6)))) for i in range(300)]
    sections = spark.createDataFrame(rows, "source string, sec_no int, title string, keywords string, text string").repartition(3)
    queries = spark.createDataFrame([(1, "join plan plan"), (2, "Vacuum"), (3, "nothing"), (4, "lock of index")], "query_id long, query string")
    every = docs.score_sections(docs.section_tokens(sections), queries)
    fields = ["query_id", "source", "sec_no", "title", "score"]
    assert sorted(map(tuple, docs.match_sections(sections, queries).select(*fields).collect())) == sorted(map(tuple, every.select(*fields).collect()))
    best = docs.top_sections(docs.match_sections(sections, queries, 7), 7).select("rank", *fields)
    assert sorted(map(tuple, best.collect())) == sorted(map(tuple, docs.top_sections(every, 7).select("rank", *fields).collect()))
    assert "Exchange" not in docs.match_sections(sections, queries, 7)._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    monkeypatch.setattr(docs, "MAX_QUERY_TOKENS", 2)
    assert sorted(map(tuple, docs.match_sections(sections, queries).select(*fields).collect())) == sorted(map(tuple, every.select(*fields).collect()))


def test_scores_of_long_sections_take_little_memory():
    texts = [f"{i} " + "plan of a lock " * 1300 for i in range(100)]
    sections = pa.RecordBatch.from_pydict({
        "source": [f"s{i}" for i in range(100)], "sec_no": pa.array(range(100), pa.int32()), "title": ["t"] * 100, "keywords": [""] * 100, "text": texts})
    queries = docs._Queries([{"query_id": q, "token": t, "times": 1} for q in range(300) for t in ("plan", "of", "lock")])
    schema = pa.schema([("query_id", pa.int64()), ("source", pa.string()), ("sec_no", pa.int32()), ("title", pa.string()), ("score", pa.float64())])
    pool = pa.proxy_memory_pool(pa.default_memory_pool())
    usual = pa.default_memory_pool()
    pa.set_memory_pool(pool)
    try:
        out = [(b.num_rows, set(b.column("score").to_pylist())) for b in docs._matched(queries, None, schema)(iter([sections]))]
    finally:
        pa.set_memory_pool(usual)
    assert sum(n for n, _ in out) == 30_000 and {s for _, found in out for s in found} == {3.0}
    assert pool.max_memory() < 20_000_000  # a text per score would be 600 MB


CALLS = [
    "# cur.execute(q)", 's = "cur.execute(q)"', 'x = """\ncur.execute(q)\n"""\ncur.execute(q)', 'cur.execute("a" "b", x)', 'cur.execute(f"a{b}", x)',
    "cur.execute(q, timeout=1)", "cur.execute(sql=q)", "cur.execute(*a)", 'cur.execute(("x"))', 'cur.execute(("x",), 1)', "cur.execute(\n  # note\n  q,\n  1)",
    "cur.execute(f(cur.executemany(g, 2)), 3)", "cur.execute(5)", "s = 'it\\'s cur.execute(q)'\ncur.execute(q)", "cur.execute(rf'{q}')", "cur.execute(-1)",
    "cur.execute()", "cur.execute(q,)", "print('''a''')\ncur.execute('a' + b, (1,))", "cur.execute(q, [1, {2: (3)}], 4)", "x = cur.execute", "",
]


def test_calls_agree_with_the_parser(spark):
    df = spark.createDataFrame(list(enumerate(CALLS)), "unit_id int, content string")
    found: dict[int, list] = {}
    for r in security.dynamic_execute_calls(df).collect():
        found.setdefault(r.unit_id, []).append((r.line_no, r.method))
    safe = {r.unit_id: r.safe for r in security.parameterized_files(df).collect()}
    for i, text in enumerate(CALLS):
        calls = [n for n in ast.walk(ast.parse(text)) if isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) and n.func.attr in ("execute", "executemany")]
        dynamic = sorted((n.lineno, n.func.attr) for n in calls if n.args and not isinstance(n.args[0], ast.Constant))
        fine = all(not n.args or len(n.args) > 1 or isinstance(n.args[0], ast.Constant) and isinstance(n.args[0].value, str) for n in calls)
        assert (sorted(found.get(i, [])), safe[i]) == (dynamic, bool(calls) and fine), text


@pytest.mark.parametrize(("dialect", "text", "wanted"), [
    ("postgres", r"SELECT E'a\';b' AS x; SELECT 2", [r"SELECT E'a\';b' AS x", "SELECT 2"]),
    ("postgres", r"SELECT 'a\'; SELECT 'b'", [r"SELECT 'a\'", "SELECT 'b'"]),
    ("postgres", r"SELECT nameE'x\'; SELECT 1", [r"SELECT nameE'x\'", "SELECT 1"]),
    ("mysql", r"""SELECT 'it\'s; x'; SELECT "q\";r"; SELECT 3""", [r"SELECT 'it\'s; x'", r'SELECT "q\";r"', "SELECT 3"]),
    ("mysql", r"SELECT 1 /* it's */; SELECT 'a\\'; SELECT 2", ["SELECT 1 /* it's */", r"SELECT 'a\\'", "SELECT 2"]),
    ("postgres", "/* " * 10 + "x; y" + " */" * 10 + " SELECT 1; SELECT 2", ["/* " * 10 + "x; y" + " */" * 10 + " SELECT 1", "SELECT 2"]),
])
def test_escapes_and_nested_comments(spark, dialect, text, wanted):
    scripts = spark.createDataFrame([(1, dialect, text)], "unit_id int, dialect string, sql string")
    found = statements.split_statements(scripts, ("dialect",))
    assert [r.sql for r in found.orderBy("stmt_idx").collect()] == wanted
    assert statements.malformed_statements(found).count() == 0
