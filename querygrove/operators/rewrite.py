"""Star expansion and checks of statements against a schema catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querygrove.functions import lexing
from querygrove.operators import facts
from querygrove.prims import cut_lineage, written

KEYS = list(facts.KEYS)


def _table_columns(columns: DataFrame) -> DataFrame:
    """One row per table with its columns in declaration order (a table is a bounded list)."""
    return columns.groupBy("repo", "tbl").agg(
        F.array_sort(F.collect_list(F.struct("ordinal", "col"))).alias("_c")
    ).select("repo", "tbl", F.transform("_c", lambda c: c["col"]).alias("cols"))


def star_expansion(statements: DataFrame, columns: DataFrame, warnings: DataFrame,
                   source: str = "repo-ddl") -> DataFrame:
    """``*`` and ``t.*`` spelled out for SELECTs over exactly one known table.

    Every SELECT with a star yields a row: a validated candidate or the reason
    it is withheld, the first of the listed tests that fails.
    """
    ready = lexing.with_profile(statements).filter(
        F.col("problem").isNull() & (F.col("kind") == "select") & ~F.col("prof.parenthesised") & (F.col("prof.star") > 0))
    # profiled once: tokens are cut from these texts, and their rewrites too
    ready = written(ready.select(*KEYS, "sql", "repo", "dialect", F.col("kind").alias("stmt_kind"), F.col("prof.lead").alias("lead")), "stars")
    rows = facts.classified(lexing.token_rows(
        ready, KEYS, keep=("stmt_kind", "repo", "dialect", "lead")))
    p1, n1 = F.upper("p1"), F.upper("n1")
    top = F.col("depth") == 0
    block = (F.col("tok") == "(") & top & n1.isin("SELECT", "WITH", "(", "VALUES")
    star = top & (F.col("tok") == "*") & (F.col("clause") == "SELECT") & p1.isin("SELECT", ",", "DISTINCT", "ALL", ".")
    per = rows.groupBy(*KEYS, "repo", "dialect", "lead").agg(
        F.count_if(F.col("is_table") & top & (F.col("clause") == "FROM")).alias("n_tables"),
        F.min_by(facts.bare(F.col("tok")), F.when(F.col("is_table") & top & (F.col("clause") == "FROM"), F.col("pos"))).alias("tbl"),
        F.count_if(top & (F.col("word") == "FROM")).alias("n_from"),
        F.count_if(block & (p1 == "FROM")).alias("from_block"),
        F.count_if(block & p1.isin("JOIN", ",", "LATERAL") & (F.col("clause") == "FROM")).alias("join_block"),
        F.collect_list(F.when(star, F.struct("pos", (p1 == ".").alias("qualified")))).alias("stars"),
    )
    known = _table_columns(columns)
    warned = warnings.select("repo", F.col("object_name").alias("tbl")).distinct().withColumn("_warned", F.lit(True))
    schemas = columns.select("repo").distinct().withColumn("_schema", F.lit(True))
    judged = per.join(known, ["repo", "tbl"], "left").join(warned, ["repo", "tbl"], "left").join(schemas, "repo", "left")
    reason = (
        F.when(F.col("_schema").isNull(), "schema unavailable")
        .when(F.lit(source != "repo-ddl"), "schema source not authoritative")
        .when(F.col("lead") == "WITH", "CTE obscures column set")
        .when(F.col("n_from") == 0, "no FROM clause")
        .when(F.col("from_block") > 0, "subquery in FROM not supported")
        .when(F.col("join_block") > 0, "subquery in JOIN not supported")
        .when(F.col("n_tables") != 1, "multi-table expansion not supported")
        .when(F.col("_warned"), "schema model has a completeness warning for this table")
        .when(F.col("cols").isNull(), F.concat(F.lit("table '"), "tbl", F.lit("' not found in schema model")))
    )
    judged = judged.withColumn("reason", reason).select(
        *KEYS, "repo", "dialect", F.when(F.col("reason").isNull(), F.col("tbl")).alias("schema_dependency"), "reason", "cols", "stars")
    texts = ready.select(*KEYS, "sql", lexing.tokens(lexing.clean(F.col("sql"))).alias("_toks"))
    return judged.join(texts, KEYS).withColumn("rewritten_sql", F.when(F.col("reason").isNull(), _spelled_out())).select(
        *KEYS, "repo", "dialect", F.sha2("sql", 256).alias("original_hash"), "schema_dependency", "rewritten_sql",
        F.when(F.col("reason").isNull(), "validated").otherwise("withheld").alias("validation_status"), "reason")


def _spelled_out() -> Column:
    """The statement with its stars replaced by the columns of its table."""
    names = F.array_join(F.transform("cols", lambda c: F.concat(F.col("schema_dependency"), F.lit("."), c)), ", ")
    plain = F.transform(F.filter("stars", lambda s: ~s["qualified"]), lambda s: s["pos"])
    qualified = F.transform(F.filter("stars", lambda s: s["qualified"]), lambda s: s["pos"])
    replaced = F.filter(
        F.transform(
            "_toks",
            lambda t, i: F.when(F.array_contains(plain, i) | F.array_contains(qualified, i), names)
            .when(F.array_contains(qualified, i + 1) | F.array_contains(qualified, i + 2), "")
            .otherwise(t),
        ),
        lambda t: t != "",
    )
    return lexing.canonical(replaced)


def _with_schema(df: DataFrame, columns: DataFrame) -> DataFrame:
    """Rows of repositories that have a catalogue at all."""
    return df.join(columns.select("repo").distinct(), "repo", "left_semi")


def _references(statements: DataFrame, rows: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    if rows is None:
        rows = facts.statement_tokens(statements, keep=("repo",)).filter(F.col("is_table") | F.col("is_column"))
        rows = cut_lineage(rows.select(*KEYS, "repo", "pos", "tok", "is_table", "is_column", "qualifier"))
    tables = rows.filter("is_table").select(*KEYS, "repo", "pos", facts.bare(F.col("tok")).alias("tbl"))
    cols = rows.filter("is_column").select(*KEYS, "repo", "pos", facts.bare(F.col("tok")).alias("col"), "qualifier")
    return tables, cols


def schema_impact(statements: DataFrame, columns: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Tables a statement uses that the schema lacks, and columns its known tables lack.

    For every known table each column that is unqualified or qualified by that
    table's name is tested, so joins over-report. One row per missing name.
    """
    if rows is None:
        tables, cols = _references(_with_schema(statements, columns))
    else:
        tables, cols = _references(statements, _with_schema(rows, columns))
    known = columns.select("repo", "tbl").distinct()
    missing_tables = tables.join(known, ["repo", "tbl"], "left_anti").select(
        *KEYS, F.lit("table").alias("missing"), F.col("tbl").alias("name")).distinct()
    present = tables.join(known, ["repo", "tbl"], "left_semi").select(*KEYS, "repo", "tbl").distinct()
    tested = cols.select(*KEYS, "qualifier", "col").distinct().join(present, KEYS).filter(
        F.col("qualifier").isNull() | (F.col("qualifier") == F.col("tbl")))
    missing_columns = tested.join(columns.select("repo", "tbl", "col"), ["repo", "tbl", "col"], "left_anti").select(
        *KEYS, F.lit("column").alias("missing"), F.concat_ws(".", "tbl", "col").alias("name")).distinct()
    return missing_tables.unionByName(missing_columns)


def schema_cross_check(statements: DataFrame, columns: DataFrame) -> DataFrame:
    """The stricter check of failing statements.

    An unqualified column belongs to the first known table of its statement; a
    qualifier that is no known table (an alias) is skipped.
    """
    tables, cols = _references(_with_schema(statements, columns))
    known = columns.select("repo", "tbl").distinct()
    missing_tables = tables.join(known, ["repo", "tbl"], "left_anti").select(
        *KEYS, F.lit("table").alias("missing"), F.col("tbl").alias("name")).distinct()
    first = tables.join(known, ["repo", "tbl"], "left_semi").groupBy(*KEYS).agg(F.min_by("tbl", "pos").alias("first"))
    owned = cols.join(first, KEYS, "left").select(*KEYS, "repo", F.coalesce("qualifier", "first").alias("tbl"), "col").filter(
        F.col("tbl").isNotNull()).join(known, ["repo", "tbl"], "left_semi")
    missing_columns = owned.join(columns.select("repo", "tbl", "col"), ["repo", "tbl", "col"], "left_anti").select(
        *KEYS, F.lit("column").alias("missing"), F.concat_ws(".", "tbl", "col").alias("name")).distinct()
    return missing_tables.unionByName(missing_columns)
