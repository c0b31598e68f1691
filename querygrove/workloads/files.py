"""Queries over file corpora (survey group A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from querygrove import refdata
from querygrove.operators import files as op
from querygrove.options import recommended
from querygrove.prims import joined
from querygrove.sources import files as src
from querygrove.sources.views import view
from querygrove.workloads.registry import query

_SKIP = ", ".join(f"'{d}'" for d in refdata.SKIP_DIRS)
_KW = "(^|[^A-Za-z0-9_])(" + "|".join(refdata.SCAN_KEYWORDS) + ")($|[^A-Za-z0-9_])"
_CONFIG = ", ".join(f"'{x}'" for x in refdata.CONFIG_EXTS)
_ORM_EXT = ", ".join(f"'{x}'" for x in refdata.ORM_EXTS)
_MARK = " OR ".join(f"contains(content, '{m}')" for m in refdata.ORM_MARKERS)

#: Oracle side: paths, then pruning, then class and skip reason.
_PATHS = """, p AS (
  SELECT *, CASE WHEN contains(name, '.') AND NOT starts_with(name, '.') THEN '.' || lower(split_part(name, '.', -1)) ELSE '' END AS ext,
    CAST(length(dir) - length(replace(dir, '/', '')) AS INT) AS depth FROM v_files)
"""
_PRUNED = _PATHS + f""", q AS (
  SELECT * FROM p WHERE len(list_filter(string_split(path, '/'), lambda x: x IN ({_SKIP}))) = 0 AND depth < 20)
"""
_CLASSED = _PRUNED + f""", r AS (
  SELECT *, ends_with(name, '.sql') AS is_sql, contains(content[1:1024], chr(0)) AS is_bin,
    regexp_matches(content, '{_KW}', 'i') AS kw, ({_MARK}) AS marker FROM q), s AS (
  SELECT *, CASE WHEN is_sql THEN NULL WHEN ext IN ({_CONFIG}, '.md', '.rst') THEN NULL
      WHEN is_bin THEN 'binary' END AS unread FROM r), c AS (
  SELECT *, CASE WHEN unread IS NOT NULL THEN NULL
      WHEN is_sql AND (regexp_matches(name, '^[0-9]+_') OR regexp_matches(name, '^V[0-9]+__', 'i') OR ends_with(name, '.migration.sql')) THEN 'migration'
      WHEN is_sql THEN 'query'
      WHEN ext IN ({_CONFIG}) THEN CASE WHEN contains(lower(name), 'lock') THEN NULL ELSE 'config' END
      WHEN ext IN ('.md', '.rst') THEN 'doc'
      WHEN ext IN ({_ORM_EXT}) AND marker THEN 'orm' WHEN kw THEN 'unknown' END AS classification FROM s), d AS (
  SELECT *, CASE WHEN unread IS NULL AND classification IS NULL THEN 'not_relevant' ELSE unread END AS skip_reason FROM c)
"""


def _described(spark, sf):
    return op.describe_paths(view(spark, sf, "v_files").drop("dir", "name"))


def _classified(spark, sf):
    return op.classify_files(op.prune_paths(_described(spark, sf)))


@query("scan_files", "v_files", _PATHS + "SELECT path, dir, name, ext, depth, size, mtime_ns, sha256(content) AS digest FROM p")
def scan_files(spark, sf):
    return _described(spark, sf).select("path", "dir", "name", "ext", "depth", "size", "mtime_ns",
                                        F.sha2("content", 256).alias("digest"))


@query("prune_paths", "v_files", _PRUNED + "SELECT path, depth FROM q")
def prune_paths(spark, sf):
    return op.prune_paths(_described(spark, sf)).select("path", "depth")


@query("skip_unreadable", "v_files", _CLASSED + "SELECT path, unread AS skip_reason FROM s")
def skip_unreadable(spark, sf):
    return op.skip_unreadable(op.prune_paths(_described(spark, sf))).select("path", "skip_reason")


# The oracle budget is an all-rows running total in path order.
@query("admit_within_budget", "v_files", _CLASSED + """, o AS (
  SELECT *, CASE WHEN classification IS NULL THEN 0 ELSE 1 END AS hit,
    CASE WHEN classification IS NULL OR is_sql THEN 0 ELSE size END AS used FROM d WHERE coalesce(skip_reason, '') <> 'oversize'), t AS (
  SELECT *, coalesce(sum(hit) OVER (ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen_before,
    coalesce(sum(used) OVER (ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used_before FROM o), z AS (
  SELECT min(path) AS stop FROM t WHERE seen_before >= 5000 OR (NOT is_sql AND used_before + size > 120000))
  SELECT path, size, classification, z.stop IS NOT NULL AS truncated FROM t, z WHERE hit = 1 AND (z.stop IS NULL OR path < z.stop)""")
def admit_within_budget(spark, sf):
    return op.admit_within_budget(_classified(spark, sf), max_files=5000, max_bytes=120_000).select(
        "path", "size", "classification", "truncated")


@query("classify_files", "v_files", _CLASSED + "SELECT path, classification, skip_reason FROM d")
def classify_files(spark, sf):
    return _classified(spark, sf).select("path", "classification", "skip_reason")


@query("sql_bearing_files", "v_files", _CLASSED + "SELECT path FROM r WHERE is_sql OR (NOT is_bin AND kw)")
def sql_bearing_files(spark, sf):
    return op.sql_bearing_files(op.prune_paths(_described(spark, sf))).select("path")


@query("context_map", "v_files", _CLASSED + "SELECT dir, name, classification FROM d WHERE classification IS NOT NULL")
def context_map(spark, sf):
    return op.context_map(_classified(spark, sf))


@query("scan_summary", "v_files", _CLASSED + """
  SELECT coalesce(outcome, 'all') AS outcome, coalesce(label, 'all') AS label, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes
  FROM (SELECT CASE WHEN classification IS NULL THEN 'skipped' ELSE 'seen' END AS outcome,
    coalesce(classification, skip_reason) AS label, size FROM d) x GROUP BY ROLLUP (outcome, label)""")
def scan_summary(spark, sf):
    return op.scan_summary(_classified(spark, sf))


@query("file_manifest", "v_files", _PATHS + f""", q AS (
  SELECT * FROM p WHERE len(list_filter(string_split(path, '/'), lambda x: x IN ({_SKIP}))) = 0)
  SELECT path, mtime_ns, size FROM q WHERE ends_with(name, '.sql') OR (NOT contains(content[1:1024], chr(0))
    AND (regexp_matches(content, '{_KW}', 'i') OR {_MARK}))""")
def file_manifest(spark, sf):
    return op.file_manifest(op.prune_paths(_described(spark, sf), max_depth=1_000_000))


@query("manifest_diff", "v_files v_files_prev", """
  SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed'
    WHEN o.size = n.size AND o.mtime_ns = n.mtime_ns THEN 'same' ELSE 'changed' END AS status
  FROM v_files_prev o FULL JOIN v_files n ON o.path = n.path""")
def manifest_diff(spark, sf):
    return op.manifest_diff(view(spark, sf, "v_files_prev"), view(spark, sf, "v_files"))


@query("migration_sources", "v_migrations", """
  SELECT repo, min(root) AS root, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes,
    CASE WHEN count(DISTINCT root) > 1 THEN 'ambiguous_migration_roots' END AS unavailable_reason
  FROM v_migrations WHERE root IN ('migrations', 'db/migrations', 'sql/migrations') GROUP BY repo""")
def migration_sources(spark, sf):
    return op.migration_sources(view(spark, sf, "v_migrations"))


@query("write_results", "v_results", """
  SELECT key, write_id, domain, value, size, created, ttl FROM (
    SELECT *, row_number() OVER (PARTITION BY key ORDER BY created DESC, write_id DESC) AS rn FROM v_results) x WHERE rn = 1""")
def write_results(spark, sf):
    """Three writes, with keys that come again and domains of their own: the store holds the latest of every key."""
    folder = src.shared_folder(spark, "results")
    rows = view(spark, sf, "v_results")
    for part in (F.col("domain") == "scan", F.col("write_id") % 2 == 0, (F.col("domain") != "scan") & (F.col("write_id") % 2 == 1)):
        src.write_results(rows.filter(part), folder)
    return src.read_results(spark, folder).select("key", "write_id", "domain", "value", "size", "created", "ttl")


@query("size_guard", "v_errors v_statements", """
  SELECT 'error' AS source, CAST(event_id AS BIGINT) AS id, CASE WHEN strlen(error_text) > 65536 THEN 'input_too_large'
    WHEN trim(error_text) = '' THEN 'no_input' END AS kind,
    CASE WHEN strlen(error_text) > 65536 THEN 'Reduce the input size.' WHEN trim(error_text) = '' THEN 'Provide the input text.' END AS next_steps FROM v_errors
  UNION ALL
  SELECT 'statement', unit_id, CASE WHEN trim(sql) = '' THEN 'no_input' END, CASE WHEN trim(sql) = '' THEN 'Provide the input text.' END FROM v_statements""")
def size_guard(spark, sf):
    errors = op.size_guard(view(spark, sf, "v_errors"), "error_text", recommended("max_error_input_bytes"))
    statements = op.size_guard(view(spark, sf, "v_statements"), "sql", recommended("max_sql_input_bytes"))
    return errors.select(F.lit("error").alias("source"), F.col("event_id").alias("id"), "kind", joined("next_steps").alias("next_steps")).unionByName(
        statements.select(F.lit("statement").alias("source"), F.col("unit_id").alias("id"), "kind", joined("next_steps").alias("next_steps")))
