"""Every module's cheaper queries against their oracle text, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from querygrove.sources.views import TABLES

CHECKED = (
    "scan_files", "admit_within_budget", "classify_files", "scan_summary", "manifest_diff", "match_errors", "capped_matches", "error_profile",
    "split_statements", "malformed_statements", "admit_read_only", "infer_dialect", "source_spans", "rule_coverage", "sec_008", "ranked_findings",
    "security_scan", "extract_columns", "lint", "star_expansion", "schema_impact", "plan_nodes", "plan_conditions", "attach_plan_evidence",
    "ddl_events", "schema_state", "ddl_warnings", "top_sections", "design_report", "retain_by_size", "resolve_refs", "usage_by_user_window",
    "proposed_changes", "debug_report", "stream_triage", "stream_counters", "stream_dedupe", "session_activity",
)


def _norm(value):
    return f"{value:.6f}" if isinstance(value, float) else str(value)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def test_every_oracle_belongs_to_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_entry(spark, sf):
    assert entry_module.entry(spark).count() > 0


@pytest.mark.parametrize("name", CHECKED)
def test_query(spark, duck, sf, name):
    df = entry_module.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(tuple(map(_norm, r)) for r in df.select(*columns).collect())
    rel = duck.execute(entry_module.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    order = [names.index(c) for c in columns]
    want = sorted(tuple(_norm(r[i]) for i in order) for r in rel.fetchall())
    assert sorted(names) == columns and got == want and want
