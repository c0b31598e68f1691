"""Schema proposals mined from requirement texts. All steps work inside the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querygrove import refdata
from querygrove.operators.files import size_guard
from querygrove.operators.security import findings
from querygrove.options import options
from querygrove.prims import once, written

_ENTITY = r"""(?iU)\b(?:table|entity|model|store|record)\s+(?:called\s+|named\s+)?["'`]?([A-Za-z][A-Za-z0-9_]*)["'`]?"""
_NAME = r"^[a-z_][a-z0-9_]*$"


def snake_case(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(name, r"(.)([A-Z][a-z]+)", "$1_$2"), r"([a-z0-9])([A-Z])", "$1_$2"))


def guarded(requirements: DataFrame) -> DataFrame:
    return size_guard(requirements, "requirements", options()["max_requirements_bytes"])


def extract_entities(requirements: DataFrame) -> DataFrame:
    """Entities named in each text, first mention of a name only."""
    raw = F.regexp_extract_all("requirements", F.lit(_ENTITY), F.lit(1))
    df = once(requirements, _raw=raw)
    df = once(df, _found=F.filter(
        F.transform("_raw", lambda r: F.struct(r.alias("raw_name"), snake_case(r).alias("name"))),
        lambda e: e["name"].rlike(_NAME)))
    names = F.transform("_found", lambda e: e["name"])
    first = F.filter(F.col("_found"), lambda e, i: F.array_position(names, e["name"]) == i + 1)
    keep = requirements.columns
    return df.select(*keep, F.posexplode(first).alias("ordinal", "e")).select(*keep, "ordinal", "e.*")


def type_hint(name: Column) -> Column:
    """Type of a proposed column: first hint contained in its name."""
    hint = None
    for part, sql_type in refdata.TYPE_HINTS:
        test = F.contains(name, F.lit(part))
        hint = F.when(test, sql_type) if hint is None else hint.when(test, sql_type)
    return hint.otherwise("TEXT")


def proposed_tables(requirements: DataFrame) -> DataFrame:
    """One row per entity with its columns as an array of (name, data_type, nullable)."""
    entities = extract_entities(requirements)
    pattern = F.concat(F.lit(r"(?iU)\b"), "raw_name", F.lit(r"\s+(?:has|with|contains)\s+([^.]+)"))
    fragments = F.regexp_extract_all(F.col("requirements"), pattern, F.lit(1))
    tokens = F.flatten(F.transform(fragments, lambda f: F.regexp_extract_all(f, F.lit("[A-Za-z][A-Za-z0-9_]*"), F.lit(0))))
    df = once(entities, _names=F.array_distinct(F.filter(
        F.transform(tokens, snake_case), lambda n: n.rlike(_NAME) & (n != "id"))))

    def column(name: Column, sql_type: Column, nullable: bool) -> Column:
        return F.struct(name.alias("name"), sql_type.alias("data_type"), F.lit(nullable).alias("nullable"))

    columns = F.concat(
        F.array(column(F.lit("id"), F.lit("UUID"), False)),
        F.transform("_names", lambda n: column(n, type_hint(n), True)),
    )
    rationale = F.concat(F.lit("Extracted from requirements mention of '"), "raw_name", F.lit("'."))
    return df.withColumn("columns", columns).withColumn("rationale", rationale).drop("_names", "requirements")


def proposed_columns(tables: DataFrame) -> DataFrame:
    return tables.select("doc_id", F.col("name").alias("tbl"), F.posexplode("columns").alias("pos", "c")).select(
        "doc_id", "tbl", "pos", "c.*")


def proposal_ddl(tables: DataFrame) -> DataFrame:
    """CREATE TABLE text of every proposed table."""
    lines = F.transform("columns", lambda c: F.concat(
        F.lit("  "), c["name"], F.lit(" "), c["data_type"], F.when(c["nullable"], "").otherwise(" NOT NULL")))
    body = F.array_join(F.array_append(lines, F.lit("  PRIMARY KEY (id)")), ",\n")
    return tables.withColumn("ddl", F.concat(F.lit("CREATE TABLE "), "name", F.lit(" (\n"), body, F.lit("\n);")))


def withhold_unsafe_ddl(ddl: DataFrame, dialect: str = "postgres") -> tuple[DataFrame, DataFrame]:
    """DDL that passes the security rules, and the rules violated by the rest."""
    keyed = ddl.withColumn("unit_id", F.concat_ws(":", "doc_id", "name"))
    units = keyed.select(
        "doc_id", "name", "unit_id", F.lit("sql").alias("input_kind"), F.lit("query").alias("input_role"), F.lit(dialect).alias("dialect"),
        F.col("ddl").alias("content"))
    # the texts are read once: a unit is one doc_id and name, which its findings keep, and what is withheld is written for both results
    bad = findings(units).filter(F.col("severity").isin("critical", "high")).groupBy("unit_id").agg(
        F.first("doc_id").alias("doc_id"), F.first("name").alias("name"), F.array_sort(F.collect_set("rule_id")).alias("rule_ids"))
    bad = written(bad, "withheld")
    return keyed.join(bad.select("unit_id"), "unit_id", "left_anti").drop("unit_id"), bad.drop("unit_id")


def proposal_conflicts(tables: DataFrame, catalog: DataFrame) -> DataFrame:
    """Proposed tables the repository already has."""
    known = catalog.select("repo", F.col("tbl").alias("name")).distinct()
    return tables.join(known, ["repo", "name"]).select(
        "doc_id", "repo", "name",
        F.concat(F.lit("Proposed table '"), "name", F.lit("' already exists in the repo schema (source: repo-ddl).")).alias("risk"))


def design_report(requirements: DataFrame, catalog: DataFrame, cap: int | None = None) -> DataFrame:
    """One row per text: status, tables within the cap with their DDL, risks and strategy, or why it was refused.

    ``withheld`` lists tables whose DDL breaks a rule, with the rules; their DDL is left out.
    """
    cap = options()["max_design_tables"] if cap is None else cap
    checked = guarded(requirements)
    tables = proposed_tables(checked.filter(F.col("kind").isNull()).select("doc_id", "repo", "requirements"))
    found = tables.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_tables"),
        F.array_sort(F.collect_list(F.struct("ordinal", "name"))).alias("_t"))  # bounded by the text's size
    safe, unsafe = withhold_unsafe_ddl(proposal_ddl(tables.filter(F.col("ordinal") < cap)))
    # the lists are bounded by the cap or by the size of the text
    ddl = safe.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "name", "ddl"))).alias("_ddl"))
    withheld = unsafe.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("name", "rule_ids"))).alias("withheld"))
    risks = proposal_conflicts(tables, catalog).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("conflicts"), F.array_sort(F.collect_list("risk")).alias("risks"))
    total = F.coalesce("n_tables", F.lit(0).cast("long"))
    status = F.when(F.col("kind").isNotNull(), F.lit(None).cast("string")).when(total > 0, "derived").otherwise("inconclusive")
    strategy = F.when(total > 0, F.array(*[F.lit(s) for s in refdata.MIGRATION_STRATEGY])).otherwise(F.array().cast("array<string>"))
    no_text = F.array().cast("array<string>")
    return checked.join(found, "doc_id", "left").join(risks, "doc_id", "left").join(ddl, "doc_id", "left").join(withheld, "doc_id", "left").select(
        F.coalesce(F.transform("_ddl", lambda d: d["ddl"]), no_text).alias("ddl"), F.coalesce("risks", no_text).alias("risks"),
        F.coalesce("withheld", F.array().cast("array<struct<name:string,rule_ids:array<string>>>")).alias("withheld"),
        "doc_id", "kind", status.alias("derivation_status"),
        F.transform(F.slice(F.coalesce("_t", F.array().cast("array<struct<ordinal:int,name:string>>")), 1, cap), lambda t: t["name"]).alias("tables"),
        strategy.alias("migration_strategy"), F.coalesce("conflicts", F.lit(0).cast("long")).alias("conflicts"),
        (total > cap).alias("tables_truncated"), F.greatest(total - cap, F.lit(0).cast("long")).alias("tables_suppressed"))
