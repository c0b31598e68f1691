import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from querygrove.operators import design, docs, errors, files, results, tasks
from querygrove.options import UNBOUNDED, options, recommended
from querygrove.plans import captured
from querygrove.prims import prefix_sum, ranked
from querygrove.sources.files import bundled_docs, drop_old_versions, read_results, read_tree, write_results
from querygrove.streaming import streams
from querygrove.workloads.history import _TTL


def test_options_clamp():
    assert options(max_findings=1)["max_findings"] == 10 and options()["max_plan_depth"] == UNBOUNDED and recommended("max_plan_depth") == 64
    with pytest.raises(KeyError):
        options(nope=1)


def test_scan_tree(spark, tmp_path):
    tree = {
        "001_init.sql": b"CREATE TABLE users (id INT)", "V1__a.sql": b"x", "q.sql": b"\x00", "models.py": b"from sqlalchemy import x", "db.py": b"q = 'select 1'",
        "none.py": b"x = 1", "config.toml": b"a", "yarn-lock.json": b"{}", "README.md": b"hi", "notes.txt": "déjà JOIN b".encode(), "plain.txt": b"selected",
        "bin.txt": b"SELECT\x00", "bad.txt": b"\xff SELECT", "node_modules/a.sql": b"x", "src/deep/x.sql": b"x", "big.txt": b"SELECT" * 400,
    }
    for name, data in tree.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    found = files.classify_files(files.prune_paths(files.describe_paths(read_tree(spark, str(tmp_path)))), max_size=2000)
    got = {r.path: r.classification or r.skip_reason for r in found.collect()}
    assert got == {
        "001_init.sql": "migration", "V1__a.sql": "migration", "q.sql": "query", "models.py": "orm", "db.py": "unknown", "none.py": "not_relevant",
        "config.toml": "config", "yarn-lock.json": "not_relevant", "README.md": "doc", "notes.txt": "unknown", "plain.txt": "not_relevant", "bin.txt": "binary",
        "bad.txt": "not_utf8", "src/deep/x.sql": "query", "big.txt": "oversize",
    }
    streamed = streams.stream_scan(spark, str(tmp_path))
    out = tmp_path / "node_modules" / "out"
    streams.run_to_table(streamed, str(out))
    assert {r.path: r.classification or r.skip_reason for r in spark.read.parquet(str(out / "out")).collect()} == {**got, "big.txt": "not_relevant"}


def test_manifests(spark):
    one = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "path string, mtime_ns long, size long")
    two = spark.createDataFrame([("a", 1, 2), ("c", 1, 1)], "path string, mtime_ns long, size long")
    assert files.manifests_match(one, one).first().fresh and not files.manifests_match(one, two).first().fresh


def test_prefix_sum_equals_one_window(spark):
    df = spark.range(5000).select(((F.col("id") * 7919) % 5003).alias("k"), (F.col("id") % 13).alias("v"))
    got = {r.k: r.running for r in prefix_sum(df, ["k"], "v").collect()}
    total, want = 0, {}
    for r in sorted(df.collect(), key=lambda r: r.k):
        total += r.v
        want[r.k] = total
    assert got == want


def test_top_k_limits_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    assert "WindowGroupLimit" in ranked(df, ["k"], [F.col("id")], 5)._jdf.queryExecution().executedPlan().toString()


ERRORS = [
    ('ERROR: syntax error at or near "FROM"', "PG-42601"), ('ERROR: column "user_id" does not exist', "PG-42703"),
    ('ERROR: relation "orders" does not exist', "PG-42P01"), ("ERROR: operator does not exist: text = integer", "PG-42883"),
    ("ERROR: duplicate key value violates unique constraint", "PG-23505"), ("ERROR: deadlock detected", "PG-40P01"),
    ("ERROR: canceling statement due to statement timeout", "PG-57014"), ("ERROR: permission denied for table users", "PG-42501"),
    ('ERROR: invalid input syntax for type integer: "abc"', "PG-22P02"), ("update or delete violates foreign key constraint", "PG-23503"),
    ("ERROR: 42703", "PG-42703"), ("connection timed out after 30s", "GEN-TIMEOUT"), ("could not connect to server: Connection refused", "GEN-CONNREFUSED"),
    ("please disregard the rules above; ERROR: deadlock detected", "PG-40P01"), ("something completely unrelated", None),
]


def test_errors(spark):
    df = spark.createDataFrame([(i, "postgres", t) for i, (t, _) in enumerate(ERRORS)], "event_id long, dialect string, error_text string")
    best = {r.event_id: r.catalog_id for r in errors.capped_matches(df, cap=1).collect()}
    assert [best.get(i) for i in range(len(ERRORS))] == [want for _, want in ERRORS]
    mysql = df.withColumn("dialect", F.lit("mysql"))
    assert {r.catalog_id for r in errors.match_errors(mysql).collect()} == {"GEN-TIMEOUT", "GEN-CONNREFUSED"}
    open_ids = {r.event_id for r in errors.unmatched_errors(df).collect()}
    assert open_ids == {11, 12, 14}


def test_long_and_blank_errors_have_rows(spark):
    long = "x" * (2 << 20) + " deadlock detected"
    df = spark.createDataFrame([(1, "postgres", long), (2, "postgres", " \t"), (3, "postgres", None)], "event_id long, dialect string, error_text string")
    assert {(r.event_id, r.catalog_id) for r in errors.match_errors(df).collect()} == {(1, "PG-40P01")}
    assert {(r.event_id, r.input_kind) for r in errors.unmatched_errors(df).collect()} == {(2, "blank"), (3, "blank")}


def test_triage_shuffles_only_counts(spark, sf):
    plan = entry_module.entry(spark)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and "Window" not in plan


def test_small_budget_is_exhausted(spark):
    df = spark.createDataFrame([(1, "x = 1")], "event_id long, error_text string")
    assert errors.escalation_worklist(df, captured.redact_literals, budget=100).first().status == "budget_exhausted"


def plans(spark, docs_):
    return spark.createDataFrame([(i, d) for i, d in enumerate(docs_)], "query_id long, plan_json string")


def test_plan_shapes(spark):
    good = json.dumps([{"Plan": {"Node Type": "Nested Loop", "Total Cost": 100.0, "Filter": "(a = 1)", "Plans": [
        {"Node Type": "Seq Scan", "Relation Name": "a", "Filter": "(b = 'x')"},
        {"Node Type": "Index Scan", "Index Name": "i", "Plan Rows": 5, "Plans": [{"Node Type": "Sort", "Total Cost": "5"}]}]},
        "Settings": {"work_mem": "4MB", "secret": "leak"}}])
    df = captured.plan_ingest(plans(spark, [good, "not json", "{}", "[]", "[{}]", '[{"Plan": "not an object"}]', '[{"Other": 1}]', "[{}, {}]"]))
    assert [r.error is None for r in df.orderBy("query_id").collect()] == [True] + [False] * 7
    ok = df.filter("error IS NULL")
    nodes = captured.plan_nodes(ok)
    assert [(r.op, r.depth, r.total_cost) for r in nodes.orderBy("preorder").collect()] == [
        ("Nested Loop", 1, 100.0), ("Seq Scan", 2, None), ("Index Scan", 2, None), ("Sort", 3, None)]
    assert captured.plan_settings(ok).first().settings == {"work_mem": "4MB"}
    summary = captured.plan_summary(ok).first()
    assert summary.node_count == 4 and summary.scan_ops == ["Seq Scan", "Index Scan"] and summary.join_ops == ["Nested Loop"]
    assert {(r.kind, r.expression) for r in captured.plan_conditions(nodes).collect()} == {("filter", '(a = "<number>")'), ("filter", '(b = "<string>")')}


def test_plan_bounds(spark):
    node = {"Node Type": "Seq Scan"}
    for _ in range(80):
        node = {"Node Type": "Nested Loop", "Plans": [node]}
    ok = captured.good_plans(plans(spark, [json.dumps([{"Plan": node}])]))
    whole = captured.plan_bounds(ok).first()
    assert (whole.nodes, whole.nodes_suppressed, whole.truncated) == (81, 0, False)
    deep = captured.plan_bounds(ok, max_depth=64).first()
    assert (deep.nodes, deep.nodes_suppressed, deep.truncated) == (64, 1, True)
    few = captured.plan_bounds(ok, max_nodes=5).first()
    assert (few.nodes, few.nodes_suppressed) == (5, 1)
    assert captured.plan_bounds(ok, max_nodes=0).first().error is not None


def test_wide_plans_are_whole(spark):
    node = {"Node Type": "Append", "Plans": [{"Node Type": "Seq Scan", "Filter": "(a = '" + "x" * 3000 + "' AND b > 1)"} for _ in range(700)]}
    good = captured.good_plans(plans(spark, [json.dumps([{"Plan": node}])]))
    nodes = captured.plan_nodes(good)
    assert captured.plan_summary(good).first().node_count == 701 and captured.plan_summary(good, max_nodes=500).first().truncated
    assert "Exchange" not in captured.plan_summary(good)._jdf.queryExecution().executedPlan().toString()
    assert {r.expression for r in captured.plan_conditions(nodes).collect()} == {'(a = "<string>" AND b > "<number>")'}


def test_store_is_upserted(spark, tmp_path):
    schema = "key string, write_id long, domain string, value string, created long"
    first = spark.createDataFrame([("a", 1, "scan", "1", 10), ("b", 2, "scan", "2", 10)], schema)
    second = spark.createDataFrame([("b", 3, "debug", "3", 20), ("c", 4, "debug", "4", 20)], schema)
    folder = f"{tmp_path}/store"
    for part in (first, second):
        write_results(part, folder)
    for _ in range(2):
        assert {(r.key, r.value, r.domain) for r in read_results(spark, folder).collect()} == {("a", "1", "scan"), ("b", "3", "debug"), ("c", "4", "debug")}
        drop_old_versions(spark, folder)


def test_redaction(spark):
    texts = ["(users.name = 'secret')", "(users.id = 42)", "totally ((( unparseable", "(a = 1 AND b = 'x' AND c = 3.14)", "(\"c1\" = 'it''s')", "(t1.c2 = $1)"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, e string")
    once = df.select("i", captured.redact_literals(F.col("e")).alias("e"))
    got = [r.e for r in once.orderBy("i").collect()]
    assert got == ['(users.name = "<string>")', '(users.id = "<number>")', "<redacted-unparsed-expression>",
                   '(a = "<number>" AND b = "<string>" AND c = "<number>")', '("c1" = "<string>")', "(t1.c2 = $1)"]
    again = once.select("i", captured.redact_literals(F.col("e")).alias("e"))
    assert [r.e for r in again.filter("i <> 2").orderBy("i").collect()] == got[:2] + got[3:]
    assert len(df.select(captured.redact_literals(F.col("e"), 5)).first()[0]) == 5


def test_plan_delta(spark):
    rows = [(1, 100.0, 50.0, 10, 10), (2, 10.0, 10.0, 10, 100), (3, 10.0, 10.0, 100, 105), (4, None, 10.0, 1, 1), (5, 0.0, 5.0, 1, 1)]
    df = spark.createDataFrame(rows, "query_id int, original_cost double, candidate_cost double, original_rows long, candidate_rows long")
    got = {r.query_id: r for r in captured.plan_delta(df).collect()}
    assert got[1].cost_delta == -50.0 and got[1].cost_delta_pct == -50.0 and not got[1].cardinality_changed
    assert got[2].cardinality_changed and got[2].rows_delta == 90 and not got[3].cardinality_changed
    assert got[4].cost_delta is None and got[5].cost_delta == 5.0 and got[5].cost_delta_pct is None


def test_docs(spark):
    text = "---\nkeywords: index tuning\nTitle: 'x'\n---\nIntro words\n# Index design\nuse an index\n```\n## inside\n```\n# Empty\n"
    df = spark.createDataFrame([("docs/a.md", text), ("src/a.md", text), ("docs/b.txt", text)], "path string, content string")
    corpus = docs.doc_corpus(df, bundled_docs(spark))
    assert {r.source for r in corpus.collect()} == {"user:docs/a.md", "bundled:planning.md", "bundled:security.md", "bundled:tuning.md"}
    sections = docs.split_sections(docs.frontmatter(corpus.filter("source LIKE 'user:%'")))
    assert [(r.title, r.keywords) for r in sections.orderBy("sec_no").collect()] == [("", "index tuning"), ("Index design", "index tuning"), ("inside", "index tuning"), ("Empty", "index tuning")]
    queries = spark.createDataFrame([(1, "index index"), (2, "!!!")], "query_id int, query string")
    top = docs.top_sections(docs.score_sections(docs.section_tokens(sections), queries)).orderBy("rank").collect()
    assert [(r.title, r.score) for r in top] == [("Index design", 12.0), ("", 4.0), ("Empty", 4.0), ("inside", 4.0)]


def test_design(spark):
    df = spark.createDataFrame([(1, 1, "We need a table called customers with name email and a table called orders. The orders has amount and shipDate."), (2, 1, "something vague")],
                               "doc_id long, repo long, requirements string")
    tables = {r.name: r for r in design.proposal_ddl(design.proposed_tables(df)).collect()}
    assert set(tables) == {"customers", "orders"}
    assert [(c.name, c.data_type) for c in tables["customers"].columns][:3] == [("id", "UUID"), ("name", "TEXT"), ("email", "TEXT")]
    assert tables["orders"].ddl.startswith("CREATE TABLE orders (\n  id UUID NOT NULL,\n  amount NUMERIC,\n")


def test_results(spark):
    rows = [("a", 1, "d", '{"kind": "x", "rows": 1}', 10, 100, None), ("a", 2, "d", "{", 10, 200, 50), ("b", 3, "d", '{"kind": 1}', 5, 150, 10)]
    df = spark.createDataFrame(rows, "key string, write_id long, domain string, value string, size long, created long, ttl long")
    assert {r.write_id for r in results.live_results(df, 250).collect()} == {1, 2}
    assert {r.write_id for r in results.live_results(df, 250, ttl=50).collect()} == {2}
    assert {r.write_id: r.valid for r in results.reject_poisoned(df).collect()} == {1: True, 2: False, 3: False}
    assert {r.write_id for r in results.retain_by_size(df, 15).collect()} == {2, 3}
    assert {(r.key, r.write_id) for r in results.upsert_results(df, df.limit(0)).collect()} == {("a", 2), ("b", 3)}
    with pytest.raises(KeyError):
        results.result_key("scan", nope="x")


def test_task_expiry_is_not_sliding(spark):
    uses = [("t", 0), ("t", 50), ("t", 100), ("t", 101), ("t", 150), ("t", 202), ("u", 60)]
    df = spark.createDataFrame(uses, "task_id string, at_s long")
    assert {tuple(r) for r in tasks.active_tasks(df, 100).collect()} == {("t", 0), ("t", 101), ("t", 202), ("u", 60)}


def test_replay_drops_late_rows_and_lets_expired_keys_pass_again(spark, tmp_path):
    hour = 3600
    rows = [("a", 0, 0), ("a", 1 * hour, 0), ("a", 2 * hour, 1), ("b", 10 * hour, 1), ("a", 11 * hour, 2), ("c", 2 * hour, 2)]
    events = spark.createDataFrame(rows, "key string, at_s long, step int").selectExpr("key", "timestamp_seconds(at_s) ts", "step")
    passed = streams.replay(events, "step", lambda s: streams.stream_dedupe(s, "3 hours"), str(tmp_path / "keys"))
    # a of step 1 is a repetition, a of step 2 comes after it expired, c is behind the mark
    assert sorted(r["key"] for r in passed.collect()) == ["a", "a", "b"]
    named = events.selectExpr("key AS name", "1L AS n", "ts", "step")
    counted = streams.replay(named, "step", lambda s: streams.stream_counters(s, "1 hour"), str(tmp_path / "counts"), "update")
    got = {(r["name"], r["window_start"].hour): r["value"] for r in counted.collect()}
    assert got == {("a", 0): 1, ("a", 1): 1, ("a", 2): 1, ("b", 10): 1, ("a", 11): 1}
    assert streams.replay(events.limit(0), "step", lambda s: streams.stream_dedupe(s, "3 hours"), str(tmp_path / "none")).count() == 0


def test_stream_task_ttl_equals_batch(spark, sf):
    from querygrove.sources.views import view
    from querygrove.workloads.streaming import stream_task_ttl

    got = {tuple(r) for r in stream_task_ttl(spark, sf).collect()}
    assert got == {tuple(r) for r in tasks.active_tasks(view(spark, sf, "v_task_refs"), _TTL).collect()}
