"""Statement corpora: tokens, splitting, guards, kinds, dialects, fingerprints and spans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querygrove import refdata
from querygrove.functions import lexing
from querygrove.options import options
from querygrove.prims import once, spread_by

KEYS = ("unit_id", "stmt_idx")


def tokenize(scripts: DataFrame) -> DataFrame:
    """Token rows of every script; comments and literals are single tokens."""
    return scripts.select(
        "unit_id", F.posexplode(lexing.all_tokens(lexing.clean(F.col("sql")), lexing.dialect_of(scripts))).alias("pos", "text")
    ).withColumn("kind", lexing.token_kind(F.col("text")))


def clean_scripts(scripts: DataFrame) -> DataFrame:
    """Scripts without a byte order mark; those with nothing left are dropped."""
    return scripts.withColumn("sql", lexing.clean(F.col("sql"))).filter(F.col("sql").rlike(r"\S"))


def split_statements(scripts: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per statement, with a dense index from 0 inside its script.

    The split is one regex over the script's text, so it needs no shuffle.
    """
    return scripts.select(
        "unit_id", *keep, F.posexplode(lexing.statement_texts(F.col("sql"), lexing.dialect_of(scripts))).alias("stmt_idx", "sql")
    )


def statement_budget(scripts: DataFrame, cap: int | None = None) -> DataFrame:
    """First ``cap`` statements of each script, and an error row where there were more."""
    cap = options()["max_statements"] if cap is None else cap
    texts = lexing.statement_texts(F.col("sql"), lexing.dialect_of(scripts))
    kept = F.transform(
        F.slice(texts, 1, cap),
        lambda text, i: F.struct(i.alias("stmt_idx"), text.alias("sql"), F.lit(None).cast("string").alias("error"),
                                 F.lit(0).alias("suppressed")),
    )
    over = F.array(F.struct(
        F.lit(cap).alias("stmt_idx"), F.lit(None).cast("string").alias("sql"),
        F.lit("statement_budget_exceeded").alias("error"), (F.size(texts) - cap).alias("suppressed"),
    ))
    rows = F.when(F.size(texts) > cap, F.concat(kept, over)).otherwise(kept)
    return scripts.select("unit_id", F.explode(rows).alias("r")).select("unit_id", "r.*")


def single_statement_only(scripts: DataFrame) -> DataFrame:
    """The statement of one-statement scripts; the others are rejected, never cut."""
    texts = lexing.statement_texts(F.col("sql"), lexing.dialect_of(scripts))
    n = F.size(texts)
    return scripts.select(
        "unit_id", n.alias("statements"), F.when(n == 1, F.get(texts, F.lit(0))).alias("sql"),
        F.when(n > 1, "expected_one_statement").alias("error"),
    )


def profiled(statements: DataFrame) -> DataFrame:
    return lexing.with_profile(statements)


def malformed_statements(statements: DataFrame) -> DataFrame:
    """Statements that cannot be parsed, with the reason. The others go on."""
    return profiled(statements).filter(F.col("problem").isNotNull()).select(
        *KEYS, F.col("problem").alias("error"), "sql"
    )


def statement_kinds(statements: DataFrame) -> DataFrame:
    return profiled(statements).select(*KEYS, "kind", F.col("prof.lead").alias("lead"))


_LOCK = r" FOR (UPDATE|SHARE|NO KEY UPDATE|KEY SHARE) "
_WRITABLE_CTE = r" AS (NOT MATERIALIZED |MATERIALIZED )?\( (INSERT|UPDATE|DELETE) "
_NESTED_WRITE = (
    r" \( (INSERT|UPDATE|DELETE|MERGE|CREATE|DROP|ALTER|TRUNCATE|COPY|GRANT|REVOKE|CALL|ANALYZE|VACUUM|REFRESH|LOAD|SET) "
)


def admission(max_bytes: int | None = None) -> Column:
    """Why ``sql`` may not be explained; null when it is one read-only query.

    Expects the columns of ``with_profile`` for the text as a whole, and
    ``n_statements``. The order of the tests is the order of the reasons.
    """
    limit = options()["max_explain_sql_bytes"] if max_bytes is None else max_bytes
    kind, mask = F.col("kind"), F.col("mask")
    return (
        F.when(~F.col("sql").rlike(r"\S"), "empty")
        .when(F.octet_length("sql") > limit, "too_large")
        .when(F.col("n_statements") != 1, "not_one_statement")
        .when(F.col("problem").isNotNull(), "parse_error")
        .when(kind == "explain", "explain_prefix")
        .when(kind == "command", "command")
        .when(~kind.isin("select", "set_op"), "not_a_query")
        .when(mask.rlike(_LOCK), "locking_clause")
        .when(mask.rlike(_WRITABLE_CTE), "writable_cte")
        .when(mask.rlike(_NESTED_WRITE), "forbidden_statement")
        .when(mask.rlike(r" INTO "), "select_into")
    )


def with_rejection(statements: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Adds ``rejection`` (null when admitted) and what it was judged by: the text ``_one`` and its profile."""
    texts = F.filter(lexing.statement_texts(F.col("sql")), lambda t: lexing.without_comments(t).rlike(r"\S"))
    one = statements.withColumn("_texts", texts).select(
        "*", F.size("_texts").alias("n_statements"), F.coalesce(F.get("_texts", F.lit(0)), F.lit("")).alias("_one"))
    return lexing.with_profile(one, "_one").withColumn("rejection", admission(max_bytes))


def with_admission(statements: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Adds ``rejection`` (null when admitted), ``has_placeholders`` and ``canonical_sql``."""
    ready = with_rejection(statements, max_bytes)
    toks = F.when(F.col("rejection").isNull(), lexing.tokens(F.col("_one")))
    return once(ready, _toks=toks).select(
        *statements.columns, "rejection", has_placeholders(F.col("mask")).alias("has_placeholders"),
        F.when(F.col("rejection").isNull(), lexing.canonical(F.col("_toks"))).alias("canonical_sql"),
    )


def admit_read_only(statements: DataFrame, max_bytes: int | None = None) -> DataFrame:
    kind = F.when(F.col("rejection") == "too_large", "input_too_large").when(
        F.col("rejection").isNotNull(), "statement_blocked")
    return with_admission(statements, max_bytes).select(
        *KEYS, F.col("rejection").isNull().alias("admitted"), kind.alias("reason"), F.col("rejection").alias("detail"),
        "has_placeholders", "canonical_sql",
    )


def has_placeholders(mask: Column) -> Column:
    """Whether a masked text has a ``$n`` parameter."""
    return mask.rlike(r" \$[0-9]+ ")


def infer_dialect(statements: DataFrame) -> DataFrame:
    """Advisory dialect ranking by distinct markers; no join, the markers are constants."""
    scored = []
    for dialect, ordinal in dict((m[0], m[1]) for m in refdata.DIALECT_MARKERS).items():
        found = F.array_compact(F.array(*[
            F.when(F.col("sql").rlike(f"(?iU){pattern}"), F.lit(text))
            for name, _, pattern, text in refdata.DIALECT_MARKERS if name == dialect
        ]))
        scored.append(F.struct((-F.size(found)).alias("rank"), F.lit(ordinal).alias("ordinal"),
                               F.lit(dialect).alias("dialect"), found.alias("evidence")))
    return (
        statements.select(*KEYS, F.array_sort(F.filter(F.array(*scored), lambda s: s["rank"] < 0)).alias("_s"))
        .select(
            *KEYS, F.transform("_s", lambda s: s["dialect"]).alias("candidates"),
            F.least(F.coalesce(-F.get("_s", F.lit(0))["rank"], F.lit(0)) / 10.0, F.lit(1.0)).alias("rank_score"),
            F.transform("_s", lambda s: F.concat(s["dialect"], F.lit(": "), F.array_join(s["evidence"], ", "))).alias("evidence"),
        )
    )


def resolve_dialect(explicit: Column, configured: Column) -> Column:
    """explicit, else configured, else unknown. A wrong explicit name does not fall through."""
    named = F.coalesce(F.nullif(F.trim(explicit), F.lit("")), F.nullif(F.trim(configured), F.lit("")))
    name = F.lower(named)
    return F.when(name.isin(*refdata.KNOWN_DIALECTS), name).otherwise("unknown")


def statement_fingerprint(statements: DataFrame) -> DataFrame:
    """Distinct texts by content hash with their multiplicity; counted map-side first."""
    return statements.groupBy(F.sha2("sql", 256).alias("fp")).agg(
        F.count(F.lit(1)).alias("n"), F.min("unit_id").alias("first_unit")
    )


def source_spans(scripts: DataFrame) -> DataFrame:
    """Statement index, line and column (from 1) of every token of a script.

    The text is cut into tokens and blanks that together give it back, so that
    offsets are running sums of lengths. One script is one key.
    """
    pieces = lexing.all_pieces(lexing.clean(F.col("sql")), lexing.dialect_of(scripts))
    rows = spread_by(scripts, "unit_id").select("unit_id", F.posexplode(pieces).alias("i", "text"))
    before = Window.partitionBy("unit_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("text")
    newlines = size - F.length(F.replace("text", F.lit("\n")))
    # offset of the last line break of a piece, counted from the start of the script
    rows = rows.withColumn("start", F.coalesce(F.sum(size).over(before), F.lit(0)))
    tail = F.length(F.regexp_extract("text", r"\n([^\n]*)\z", 1))
    rows = rows.withColumn("_break", F.when(newlines > 0, F.col("start") + size - tail))
    rows = (
        rows.withColumn("line", 1 + F.coalesce(F.sum(newlines).over(before), F.lit(0)))
        .withColumn("col", 1 + F.col("start") - F.coalesce(F.max("_break").over(before), F.lit(0)))
        .withColumn("_seq", F.coalesce(F.sum(F.when(F.col("text") == ";", 1).otherwise(0)).over(before), F.lit(0)))
    )
    return rows.filter(F.col("text").rlike(r"\S") & (F.col("text") != ";")).select(
        "unit_id",
        (F.dense_rank().over(Window.partitionBy("unit_id").orderBy("_seq")) - 1).alias("stmt_idx"),
        "start", "text", "line", "col",
    )
