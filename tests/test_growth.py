"""What must not grow: how often a text is read, in how many tasks, and what a group holds."""

import json
import re

import pytest
from pyspark.sql import functions as F

from querygrove.operators import design, errors
from querygrove.plans import captured
from querygrove.sources.views import view
from querygrove.streaming import streams


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_worklist_redacts_each_text_once(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def redact(text):
        calls.add(1)
        return text.upper()

    df = spark.createDataFrame([(i, f"text {i}") for i in range(30)], "event_id long, error_text string")
    work = errors.escalation_worklist(df, redact, 4000, total_budget=20, max_chars=5).orderBy("event_id").collect()
    assert [(r.prompt, r.truncated, r.running_tokens, r.status) for r in work][9:11] == [
        ("TEXT ", True, 20, "pending"), ("TEXT ", True, 22, "budget_exhausted")]
    assert calls.value == 30


@pytest.mark.parametrize("name", ["v_statements", "v_requirements", "v_errors"])
def test_texts_of_small_files_are_read_by_many_tasks(spark, sf, name):
    df = view(spark, sf, name)
    assert df.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_ddl_is_judged_once(spark):
    rows = [(1, "a", "CREATE TABLE a (id int); DROP TABLE a;"), (1, "b", "CREATE TABLE b (id int)"), (None, "a", "CREATE TABLE a (id int)"), (1, "a", "CREATE TABLE a (id int)")]
    safe, withheld = design.withhold_unsafe_ddl(spark.createDataFrame(rows, "doc_id long, name string, ddl string"))
    assert sorted(((r.doc_id, r.name) for r in safe.collect()), key=str) == [(1, "b"), (None, "a")]
    assert [(r.doc_id, r.name, r.rule_ids) for r in withheld.collect()] == [(1, "a", ["SEC-003"])]
    assert "DROP TABLE" not in plan(withheld) and "DROP TABLE" not in plan(safe)


def test_users_of_a_group_share_one_sketch(spark):
    rows = [(i % 5 if i % 4 else None, "postgres", "deadlock detected", i * 50_000) for i in range(40)]
    profile = errors.error_profile(spark.createDataFrame(rows, "user_id long, dialect string, error_text string, at_s long"))
    total = profile.filter("gid = 7").collect()
    assert [(r.n, r.users, r.approx_users, r.severity) for r in total] == [(40, 5, 5, None)]
    physical = profile._jdf.queryExecution().executedPlan().toString()
    keys = [found for line in physical.splitlines() if "approx_count_distinct" in line for found in re.findall(r"keys=\[([^\]]*)\]", line)]
    assert keys and not any("user_id" in k for k in keys)


def test_plans_are_read_for_what_is_asked(spark):
    tree = {"Node Type": "Nested Loop", "Total Cost": 2, "Plans": [{"Node Type": "Seq Scan", "Relation Name": "r", "Plan Rows": 3.5}, None, 7, {"Plans": {}}]}
    df = spark.createDataFrame([(1, json.dumps([{"Plan": tree}])), (2, "[null]"), (3, "[]")], "query_id long, plan_json string")
    assert [r.error for r in captured.plan_ingest(df).orderBy("query_id").collect()] == [None, "missing_plan", "unexpected_structure"]
    good = captured.good_plans(df)
    nodes = captured.plan_nodes(good).orderBy("preorder").select("op", "relation", "n_rows", "total_cost").collect()
    assert list(map(tuple, nodes)) == [("Nested Loop", None, None, 2.0), ("Seq Scan", "r", 3, None), ("Unknown", None, None, None)]
    assert captured.plan_bounds(good, max_nodes=2).first().nodes_suppressed == 1
    assert "Total Cost" not in plan(captured.plan_bounds(good)) and "schema_of_variant" not in plan(good).lower().replace("schemaofvariant", "schema_of_variant")


def test_candidates_are_not_spelled_out_to_be_judged(spark):
    rows = [(1, i, "validated", "passed", sql) for i, sql in enumerate(["SELECT a FROM t", "DELETE FROM t", "SELECT 1; SELECT 2", "SELECT b FROM t"])]
    candidates = spark.createDataFrame(rows, "query_id long, candidate_id int, validation_status string, security_status string, sql string")
    kept = captured.eligible_candidates(candidates, 5)
    assert sorted((r.candidate_id, r.position) for r in kept.collect()) == [(0, 1), (3, 2)]
    assert kept.columns == [*candidates.columns, "position"] and "<>|<=|>=|!=" not in plan(kept).replace(r"([0-9]+\.[0-9]+|<>|<=|>=|!=", "")


def test_a_step_of_a_stream_lands_in_many_files(spark, tmp_path):
    rows = spark.range(100, numPartitions=1).select(F.col("id"), F.lit(0).alias("step"))
    out = streams.replay(rows, "step", lambda stream: stream, str(tmp_path / "replay"))
    assert out.count() == 100
    assert len(list((tmp_path / "replay/landing").rglob("part-*.parquet"))) >= int(spark.conf.get("spark.sql.shuffle.partitions"))
