"""Lint heuristics over statements, with and without a schema catalogue.

Catalogue frames: ``columns(repo, tbl, tbl_ord, col, ordinal, data_type)``,
``indexes(repo, tbl, idx, columns ARRAY, is_partial, is_expression)``,
``warnings(repo, object_name, capability)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querygrove import refdata
from querygrove.functions import lexing
from querygrove.operators import facts
from querygrove.prims import cut_lineage, shared

KEYS = list(facts.KEYS)
FIELDS = (*KEYS, "repo", "rule_id", "title", "severity", "evidence", "kind", "subject", "message")


def all_tokens(statements: DataFrame) -> DataFrame:
    """Token rows of all statements, written once for every reader of a report."""
    rows = facts.statement_tokens(statements, keep=("repo", "dialect"))
    return cut_lineage(rows.drop("head", "head2", "is_name"))


def rule_tokens(statements: DataFrame) -> DataFrame:
    """The same for the rules alone: of SELECT statements with a WHERE or a subquery, which are picked before they are cut into tokens."""
    able = (F.col("kind") == "select") & ~F.col("prof.parenthesised") & (lexing.has_where(statements) | lexing.has_subquery(statements))
    return _rule_rows(facts.statement_tokens(statements, keep=("repo", "dialect"), only=able))


def subquery_tokens(statements: DataFrame) -> DataFrame:
    """``rule_tokens`` of the statements that may have a correlated subquery."""
    able = (F.col("kind") == "select") & ~F.col("prof.parenthesised") & lexing.has_subquery(statements)
    return _rule_rows(facts.statement_tokens(statements, keep=("repo", "dialect"), only=able, compared=False))


def _rule_rows(rows: DataFrame) -> DataFrame:
    used = F.col("is_table") | F.col("is_column") | F.col("tok").isin("(", ")", "*") | F.col("word").isin(*refdata.CLAUSE_WORDS)
    return rows.filter(used).drop("owner", "clause", "head", "head2", "is_name")


def compared_tokens(statements: DataFrame) -> DataFrame:
    """``rule_tokens`` of the statements whose comparisons can be judged: with a WHERE, in a known dialect."""
    able = (F.col("kind") == "select") & ~F.col("prof.parenthesised") & lexing.has_where(statements) & (F.col("dialect") != "unknown")
    rows = facts.statement_tokens(statements, keep=("repo", "dialect"), only=able)
    return rows.filter(F.col("is_column") | F.col("word").isin(*refdata.CLAUSE_WORDS)).select(
        *KEYS, "repo", "dialect", "stmt_kind", "paren_root", "pos", "tok", "word", "p1", "depth", "is_column", "side", "literal")


def _finding(df: DataFrame, rule_id: str, subject: Column, message: Column, title: Column | None = None) -> DataFrame:
    rule = next(r for r in refdata.LINT_RULES if r[0] == rule_id)
    return df.select(
        *KEYS, "repo", F.lit(rule_id).alias("rule_id"), (F.lit(rule[1]) if title is None else title).alias("title"),
        F.lit(rule[2]).alias("severity"), F.lit(rule[3]).alias("evidence"), F.lit(rule[4]).alias("kind"),
        subject.alias("subject"), message.alias("message"),
    )


def opt_001(statements: DataFrame) -> DataFrame:
    """Star in the top projection of a SELECT; at most one per statement. No shuffle."""
    ready = lexing.with_profile(statements)
    star = F.col("prof.star")
    hits = ready.filter(
        F.col("problem").isNull() & (F.col("kind") == "select") & ~F.col("prof.parenthesised") & (star > 0))
    return _finding(
        hits, "OPT-001", F.when(star == 2, "qualified").otherwise("plain"),
        F.when(star == 2, "Projection includes all columns of a table (SELECT t.*). This may increase I/O and may prevent "
               "covering-index usage.").otherwise(
            "Projection includes all columns (SELECT *). This may increase I/O and may prevent covering-index usage "
            "when the index does not contain all projected columns."),
        F.when(star == 2, "SELECT t.* present").otherwise("SELECT * present"),
    )


def opt_002(rows: DataFrame) -> DataFrame:
    """Correlated subquery: a column in it is qualified by a name only declared outside.

    It is enough to look at the innermost subquery around a qualified column:
    names that it declares are also declared by the subqueries around it.
    EXISTS/ANY/ALL bodies and common tables do not count as subqueries.
    """
    selects = rows.filter(F.col("nested") & (F.col("stmt_kind") == "select") & ~F.col("paren_root"))
    p1, n1 = F.upper("p1"), F.upper("n1")
    opens = (F.col("tok") == "(") & n1.isin("SELECT", "WITH") & ~p1.isin("EXISTS", "ANY", "ALL", "SOME", "AS")
    level = Window.partitionBy(*KEYS, "inner").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    order = Window.partitionBy(*KEYS).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    star = (F.col("tok") == "*") & (F.col("p1") == ".")
    used = F.col("tok").isin("(", ")") | F.col("qualifier").isNotNull() | star
    marked = selects.filter(used).withColumn("_open", opens).withColumn(
        "_close", (F.col("tok") == ")") & (F.max(F.when(opens, F.col("pos"))).over(level) == F.col("block"))
    ).withColumn(
        "_nest", F.sum(F.when(F.col("_open"), 1).when(F.col("_close"), -1).otherwise(0)).over(order)
        + F.when(F.col("_close"), 1).otherwise(0))
    nested = Window.partitionBy(*KEYS, "_nest").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = marked.withColumn("sub", F.max(F.when(F.col("_open"), F.col("pos"))).over(nested)).filter("_nest > 0")
    closes = marked.filter("_close").select(*KEYS, F.col("block").alias("sub"), F.col("pos").alias("end"))
    uses = marked.filter(F.col("qualifier").isNotNull() | star).select(
        *KEYS, "repo", "sub", F.coalesce("qualifier", facts.bare(F.col("p2"))).alias("name"))
    declared = facts.table_aliases(selects).groupBy(*KEYS, "name").agg(F.collect_list("pos").alias("at"))
    inside = F.exists("at", lambda p: (p > F.col("sub")) & (p < F.col("end")))
    hits = uses.join(closes, [*KEYS, "sub"]).join(declared, [*KEYS, "name"]).filter(~inside)
    first = hits.groupBy(*KEYS, "repo").agg(F.min_by("name", F.struct("sub", "name")).alias("name"))
    return _finding(
        first, "OPT-002", F.col("name"),
        F.lit("Correlated subquery references outer relation. The eventual execution strategy is unknown without "
              "EXPLAIN; modern optimizers may decorrelate this."))


def comparisons(rows: DataFrame) -> DataFrame:
    """Comparisons in the WHERE clause of SELECT statements whose dialect is known."""
    clause = F.col("word").isin(*refdata.CLAUSE_WORDS) & (F.col("p1") != ".") & (F.col("depth") == 0)
    operand = F.col("is_column") & F.col("side").isNotNull()
    order = Window.partitionBy(*KEYS).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marks = rows.filter(
        (F.col("stmt_kind") == "select") & ~F.col("paren_root") & (F.col("dialect") != "unknown") & (clause | operand)
    ).withColumn("_clause", F.max(F.when(clause, F.struct("pos", "word"))).over(order)["word"])
    return marks.filter(operand & (F.col("_clause") == "WHERE")).select(*KEYS, "repo", "pos", facts.bare(F.col("tok")).alias("col"), "literal")


def _asked(rows: DataFrame) -> DataFrame:
    """Comparisons that a catalogue can tell something of, by the column names it is asked for; the schema rules share them."""
    found = comparisons(rows).filter(F.col("repo").isNotNull() & F.col("col").isNotNull())
    return shared(found.select(*KEYS, "repo", "pos", "col", F.when(F.col("literal").isNotNull(), literal_class(F.col("literal"))).alias("asked_class")), ["repo", "col"])


def _answering(columns: DataFrame, asked: DataFrame) -> DataFrame:
    """The catalogue's columns of the names asked for: what rules go on with is as large as the questions, not as the catalogue."""
    told = columns.select("repo", "tbl", "tbl_ord", "col", "data_type")
    return shared(told, ["repo", "col"]).join(asked, ["repo", "col"], "left_semi")


def type_class(data_type: Column) -> Column:
    """Class of an SQL type name; null when it is not known."""
    pairs = F.create_map(*[F.lit(x) for pair in refdata.TYPE_CLASSES for x in pair])
    return F.try_element_at(pairs, F.trim(F.split(F.lower(F.trim(data_type)), r"\(")[0]))


#: What ``literal_class`` tells apart.
LITERAL_CLASSES = ("text", "numeric", "integer")


def literal_class(literal: Column) -> Column:
    return (
        F.when(literal.startswith("'"), "text").when(F.contains(literal, F.lit(".")), "numeric").otherwise("integer")
    )


def mismatches(columns: DataFrame) -> DataFrame:
    """Per column name and class of a literal, the first table whose column of that name is of another class."""
    typed = columns.withColumn("col_class", type_class(F.col("data_type"))).filter(F.col("col_class").isNotNull())
    pairs = typed.withColumn("lit_class", F.explode(F.array(*[F.lit(c) for c in LITERAL_CLASSES]))).filter("col_class <> lit_class")
    return pairs.groupBy("repo", "col", "lit_class").agg(F.min_by(F.struct("data_type", "col_class"), "tbl_ord").alias("_first")).select(
        "repo", "col", "lit_class", "_first.*")


def opt_003(rows: DataFrame, columns: DataFrame) -> DataFrame:
    """A column compared with a literal of another type class; first per statement.

    The catalogue is first reduced to one row per question, so that a
    comparison meets one row however many tables have a column of that name.
    """
    asked = _asked(rows)
    answers = mismatches(_answering(columns, asked)).groupBy("repo", "col").agg(
        F.collect_list(F.struct("lit_class", "data_type", "col_class")).alias("_answers"))  # one per class of a literal
    found = asked.filter(F.col("asked_class").isNotNull()).join(answers, ["repo", "col"]).select(
        *KEYS, "repo", "pos", "col", F.inline(F.filter("_answers", lambda a: a["lit_class"] == F.col("asked_class"))))
    first = found.groupBy(*KEYS, "repo").agg(
        F.min_by(F.struct("col", "data_type", "col_class", "lit_class"), "pos").alias("f")
    ).select(*KEYS, "repo", "f.*")
    message = F.concat(
        F.lit("Schema model indicates column "), "col", F.lit(" is "), "data_type", F.lit(" (class "), "col_class",
        F.lit("); predicate compares to "), "lit_class",
        F.lit(" literal. Implicit conversion behavior depends on the database."))
    return _finding(first, "OPT-003", F.col("col"), message)


def index_support(columns: DataFrame, indexes: DataFrame, warnings: DataFrame) -> DataFrame:
    """Per column what the catalogue says about an index for it.

    withheld: the table has a completeness warning or no index at all; usable:
    some index starts with the column, whole and plain; unusable: none does.
    """
    leading = indexes.withColumn("_lead", F.lower(F.get("columns", F.lit(0)))).withColumn(
        "_plain", ~F.col("is_partial") & ~F.col("is_expression"))
    usable = leading.filter("_plain").select("repo", "tbl", F.col("_lead").alias("_col")).distinct().withColumn(
        "_usable", F.lit(True))
    indexed = indexes.select("repo", "tbl").distinct().withColumn("_indexed", F.lit(True))
    warned = warnings.select("repo", F.col("object_name").alias("tbl")).distinct().withColumn("_warned", F.lit(True))
    return (
        columns.withColumn("_col", F.lower("col"))
        .join(indexed, ["repo", "tbl"], "left").join(warned, ["repo", "tbl"], "left")
        .join(usable, ["repo", "tbl", "_col"], "left")
        .select("repo", "tbl", "tbl_ord", "col",
                F.when(F.col("_warned") | F.col("_indexed").isNull(), "withheld").when(F.col("_usable"), "usable")
                .otherwise("unusable").alias("support"))
    )


def unsupported_columns(columns: DataFrame, indexes: DataFrame, warnings: DataFrame) -> DataFrame:
    """Column names per repository of which the first table without a usable index (in catalogue order) surely has none."""
    support = index_support(columns, indexes, warnings).filter(F.col("support") != "usable")
    return support.groupBy("repo", "col").agg(F.min_by("support", "tbl_ord").alias("support")).filter(F.col("support") == "unusable").select("repo", "col")


def opt_004(rows: DataFrame, columns: DataFrame, indexes: DataFrame, warnings: DataFrame) -> DataFrame:
    """A predicate column without an obviously usable index; first per statement.

    The first table (in catalogue order) that has the column and no usable
    index for it decides; when it is withheld, the comparison says nothing.
    That is decided per column name before the comparisons are looked at.
    """
    asked = _asked(rows)
    hits = asked.join(unsupported_columns(_answering(columns, asked), indexes, warnings), ["repo", "col"], "left_semi")
    first = hits.groupBy(*KEYS, "repo").agg(F.min_by("col", "pos").alias("col"))
    message = F.concat(
        F.lit("No obviously usable index found in schema model for predicate on "), "col",
        F.lit(". This is a static inference; the optimizer may use a different plan."))
    return _finding(first, "OPT-004", F.col("col"), message)


def lint(statements: DataFrame, columns: DataFrame, indexes: DataFrame, warnings: DataFrame,
         rows: DataFrame | None = None) -> DataFrame:
    """All lint findings; the schema rules only speak where a dialect and a schema are known.

    Without ``rows`` each rule cuts the tokens of the statements it can judge, and none are written.
    """
    nested = compared = rows
    if rows is None:
        statements = lexing.dealt(statements, KEYS, by=KEYS, keep=("repo", "dialect"))
        nested, compared = subquery_tokens(statements), compared_tokens(statements)
    return (
        opt_001(statements).unionByName(opt_002(nested)).unionByName(opt_003(compared, columns))
        .unionByName(opt_004(compared, columns, indexes, warnings))
    )


def withhold_on_warnings(claims: DataFrame, warnings: DataFrame, capability: str | None = None) -> DataFrame:
    """Claims about an object whose catalogue entry is incomplete are left out."""
    hit = warnings if capability is None else warnings.filter(F.col("capability") == capability)
    return claims.join(hit.select("repo", F.col("object_name").alias("tbl")).distinct(), ["repo", "tbl"], "left_anti")
