"""History of results: keys, reuse, expiry, retention and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querygrove.options import options
from querygrove.prims import WINDOW_ROWS, first_over, key_literal, prefix_sum, stretch_over

#: Parts of a key per domain besides the domain itself. Fixed values.
KEY_PARTS = {
    "scan": ("root", "ruleset_version"),
    "analysis": ("sql_hash", "dialect", "schema_hash", "lint_ruleset_version", "schema_model_version"),
    "security": ("input_mode", "sql_hash", "files", "resolved_role", "dialect", "security_ruleset_version"),
    "optimize": ("sql_hash", "dialect", "schema_hash", "optimization_ruleset_version", "lint_ruleset_version",
                 "rewrite_ruleset_version", "schema_model_version"),
    "schema": ("manifest", "schema_model_version"),
    "explain": ("sql_hash", "dialect", "db_identity", "repo_ddl", "explain_options", "plan_model_version", "server_major"),
    "runtime_evidence": ("static_key", "db_identity", "repo_ddl", "candidates", "limits", "explain_options",
                         "server_major", "runtime_evidence_version"),
    "design": ("requirements_hash", "dialect", "schema_fingerprint", "design_ruleset_version", "schema_model_version"),
    "refactor": ("target_hash", "dialect", "schema_fingerprint", "security_ruleset_version",
                 "optimization_ruleset_version", "lint_ruleset_version", "rewrite_ruleset_version",
                 "schema_model_version", "refactor_composition_version"),
    "debug": ("error_hash", "sql_hash", "dialect", "debug_catalog_version", "schema_model_version"),
}


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def result_key(domain: str, **parts: Column | str) -> Column:
    """Content key: hash over the sorted ``name=value`` parts of a domain.

    Versions that are not given are "1"; other parts that are not given are empty.
    """
    unknown = set(parts) - set(KEY_PARTS[domain])
    if unknown:
        raise KeyError(f"{domain} keys have no parts {sorted(unknown)}")
    values: dict[str, Column] = {"domain": F.lit(domain)}
    for name in KEY_PARTS[domain]:
        value = parts.get(name, "1" if name.endswith("_version") else "")
        values[name] = F.coalesce(value, F.lit("")) if isinstance(value, Column) else F.lit(value)
    return F.sha2(F.concat_ws("|", *[F.concat(F.lit(f"{name}="), values[name]) for name in sorted(values)]), 256)


def live_results(results: DataFrame, now: int, ttl: int | None = None) -> DataFrame:
    """Results within their time to live; the caller's value overrides the stored one."""
    bound = F.col("ttl") if ttl is None else F.lit(ttl)
    return results.filter(bound.isNull() | (F.lit(now) - F.col("created") <= bound))


def pending_work(inputs: DataFrame, results: DataFrame, key: str = "key") -> DataFrame:
    """Inputs without a stored result."""
    return inputs.join(results.select(key), key, "left_anti")


def retain_by_count(results: DataFrame, n: int | None = None) -> DataFrame:
    """Newest ``n`` results; a top-n, each task keeps at most ``n``."""
    n = options()["cache_max_entries"] if n is None else n
    return results.orderBy(F.desc("created"), F.desc("write_id")).limit(n)


def retain_by_size(results: DataFrame, max_bytes: int, access: str = "created", running: str | None = None) -> DataFrame:
    """Newest results whose sizes add up to at most ``max_bytes``.

    The place of the cut is found from sums per stretch of the order, and one
    filter keeps what lies before it: stored values are neither sorted nor
    shuffled. ``running`` names a column for the running total, which is added
    over the kept results, whose size is bounded.
    """
    order = ["_age", "_tie"]
    newest = results.withColumn("_age", -F.col(access)).withColumn("_tie", -F.col("write_id"))
    keys, passes = newest.select(*order, "size"), lambda before, bucket: (before["used"] + bucket["used"] > max_bytes,) * 2
    part = stretch_over(keys, order, {"used": "size"}, passes)
    if part is not None and part.ahead + part.rows <= WINDOW_ROWS:  # few are kept: one window over them and the stretch of the cut
        total = running or "_running"
        near = newest.filter(part.reached(newest, order)).withColumn(total, F.sum("size").over(Window.orderBy(*order)))
        kept = near.filter(F.col(total) <= max_bytes)
        return kept.drop(*order) if running else kept.drop(*order, total)
    if part is not None:
        stop = first_over(keys, order, {"used": "size"}, lambda before: before["used"] + F.col("size") > max_bytes, passes)
        newest = newest.filter(F.struct(*order) < key_literal(newest, order, stop))
    return (prefix_sum(newest, order, "size", running) if running else newest).drop(*order)


def reject_poisoned(results: DataFrame, schema: str = "kind string, rows bigint") -> DataFrame:
    """Adds ``valid``: the stored value parses and has every field of its record."""
    record = F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    names = [part.split()[0] for part in schema.split(",")]
    valid = F.col("_r._bad").isNull()
    for name in names:
        valid = valid & F.col(f"_r.{name}").isNotNull()
    return results.withColumn("_r", record).withColumn("valid", F.coalesce(valid, F.lit(False))).drop("_r")


def upsert_results(stored: DataFrame, written: DataFrame, key: str = "key") -> DataFrame:
    """Latest write per key; combined map-side, so a hot key is no hot task."""
    both = stored.unionByName(written)
    fields = [c for c in both.columns if c != key]
    latest = both.groupBy(key).agg(F.max_by(F.struct(*fields), F.struct("created", "write_id")).alias("_v"))
    return latest.select(key, "_v.*")


def last_access(results: DataFrame, accesses: DataFrame, key: str = "key") -> DataFrame:
    """Latest write or read per stored key."""
    reads = accesses.groupBy(key).agg(F.max("at_s").alias("_read"))
    return results.join(reads, key, "left").withColumn(
        "last_access", F.greatest(F.col("created"), F.coalesce("_read", F.col("created")))).drop("_read")


def hit_rate(results: DataFrame, now: int) -> DataFrame:
    """Usable, expired and poisoned results per domain."""
    fresh = F.col("ttl").isNull() | (F.lit(now) - F.col("created") <= F.col("ttl"))
    return reject_poisoned(results).groupBy("domain").agg(
        F.count_if(fresh & F.col("valid")).alias("hits"), F.count_if(~fresh).alias("stale"),
        F.count_if(fresh & ~F.col("valid")).alias("misses"), F.count(F.lit(1)).alias("lookups"))
