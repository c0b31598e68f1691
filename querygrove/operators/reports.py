"""Composite reports per unit: analysis, optimisation and refactoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querygrove.functions import lexing
from querygrove.operators import facts as fa
from querygrove.operators import lint as li
from querygrove.operators import rewrite as rw
from querygrove.operators import security as se
from querygrove.options import options
from querygrove.prims import accounted, ranked, suppressed

_STRINGS = "array<string>"


def _listed(kind: str) -> Column:
    """Values of one kind of fact in rank order; a list within its cap."""
    entries = F.array_sort(F.collect_list(F.when(F.col("fact_kind") == kind, F.struct("rank", "value"))))
    return F.transform(entries, lambda e: e["value"])


def _none(name: str) -> Column:
    return F.coalesce(name, F.array().cast(_STRINGS)).alias(name)


def analyze_sql(statements: DataFrame, columns: DataFrame, indexes: DataFrame, warnings: DataFrame) -> DataFrame:
    """Facts and lint rules per unit, bounded; units without one good statement carry an error.

    A unit is one input of bounded size. Its statements are dealt out together, so that
    all that is told of it but the schema rules is found where its texts lie; tokens are cut for each reader and not written.
    """
    statements = lexing.dealt(statements, fa.KEYS, by=["unit_id"], keep=("repo", "dialect"))
    rows = fa.statement_tokens(statements, keep=("dialect",), compared=False)
    bounded = fa.bounded_facts(fa.facts(statements, rows))
    per = bounded.groupBy("unit_id").agg(
        _listed("table").alias("tables"), _listed("column").alias("columns"), _listed("join").alias("joins"),
        _listed("predicate").alias("predicates"), F.bool_or("truncated").alias("truncated"))
    found = li.lint(statements, columns, indexes, warnings).groupBy("unit_id").agg(
        F.array_sort(F.collect_set("rule_id")).alias("lint_rules"))
    units = lexing.with_profile(statements).groupBy("unit_id").agg(
        F.count_if(F.col("problem").isNull()).alias("statements"),
        F.when(F.count_if(F.col("problem").isNull()) == 0, "parse_error").alias("kind"))
    return units.join(per, "unit_id", "left").join(found, "unit_id", "left").select(
        "unit_id", "statements", "kind", _none("tables"), _none("columns"), _none("joins"), _none("predicates"),
        _none("lint_rules"), F.coalesce("truncated", F.lit(False)).alias("truncated"))


def optimize_report(statements: DataFrame, columns: DataFrame, indexes: DataFrame, warnings: DataFrame,
                    max_findings: int | None = None, max_candidates: int | None = None) -> DataFrame:
    """Lint findings and rewrite candidates per unit, each within its cap (None: all), with how many were left out."""
    findings = li.lint(statements, columns, indexes, warnings).select(
        "unit_id", "stmt_idx", F.lit("finding").alias("entry"), "rule_id", F.col("message").alias("value"))
    candidates = rw.star_expansion(statements, columns, warnings).filter(F.col("validation_status") == "validated").select(
        "unit_id", "stmt_idx", F.lit("candidate").alias("entry"), F.lit("select_star_expansion").alias("rule_id"),
        F.col("rewritten_sql").alias("value"))
    order = [F.col("stmt_idx"), F.col("rule_id")]
    return accounted(findings, ["unit_id"], order, max_findings).unionByName(accounted(candidates, ["unit_id"], order, max_candidates))


def as_units(statements: DataFrame) -> DataFrame:
    return statements.select("unit_id", "repo", F.lit("sql").alias("input_kind"), "input_role", "dialect", F.col("sql").alias("content"))


def refactor_report(statements: DataFrame, columns: DataFrame, indexes: DataFrame, warnings: DataFrame) -> DataFrame:
    """One row per unit: violated rules, rewrites and what the schema lacks.

    Every list is bounded by the rules or by the text of its unit.
    """
    secure = se.findings(as_units(statements)).groupBy("unit_id").agg(F.array_sort(F.collect_set("rule_id")).alias("security_rules"))
    rows = li.all_tokens(statements)
    lint = li.lint(statements, columns, indexes, warnings, rows).groupBy("unit_id").agg(F.array_sort(F.collect_set("rule_id")).alias("lint_rules"))
    rewrites = rw.star_expansion(statements, columns, warnings).filter(F.col("validation_status") == "validated").groupBy("unit_id").agg(
        F.array_sort(F.collect_list(F.struct("stmt_idx", "rewritten_sql"))).alias("_r")).select(
        "unit_id", F.transform("_r", lambda r: r["rewritten_sql"]).alias("candidates"))
    impact = rw.schema_impact(statements, columns, rows).groupBy("unit_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("missing") == "table", F.col("name")))).alias("missing_tables"),
        F.array_sort(F.collect_set(F.when(F.col("missing") == "column", F.col("name")))).alias("missing_columns"))
    out = statements.select("unit_id").distinct()
    for part in (secure, lint, rewrites, impact):
        out = out.join(part, "unit_id", "left")
    return out.select("unit_id", *[_none(c) for c in (
        "security_rules", "lint_rules", "candidates", "missing_tables", "missing_columns")])


def proposed_changes(statements: DataFrame, columns: DataFrame, warnings: DataFrame, cap: int | None = None) -> DataFrame:
    """Fixes of security findings first, then rewrites; within a cap per unit."""
    cap = options()["max_findings"] if cap is None else cap
    fixes = se.findings(as_units(statements)).filter(F.col("fix_suggestion").isNotNull()).select(
        "unit_id", F.lit(1).alias("basis"), "stmt_idx", "rule_id",
        F.concat(F.lit("["), "rule_id", F.lit("] "), "fix_suggestion").alias("change"))
    rewrites = rw.star_expansion(statements, columns, warnings).filter(F.col("validation_status") == "validated").select(
        "unit_id", F.lit(2).alias("basis"), "stmt_idx", F.lit("").alias("rule_id"),
        F.concat(F.lit("Apply rewrite: "), "rewritten_sql").alias("change"))
    both = fixes.unionByName(rewrites)
    totals = suppressed(both, ["unit_id"], cap).select("unit_id", "suppressed_count", "truncated")
    kept = ranked(both, ["unit_id"], [F.col("basis"), F.col("stmt_idx"), F.col("rule_id")], cap)
    return kept.join(totals, "unit_id").select("unit_id", "rank", "change", "suppressed_count", "truncated")
