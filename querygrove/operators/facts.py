"""Facts of statements: tables, columns, joins and predicates.

All of them read the token rows of one statement; see ``lexing.token_rows``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querygrove import refdata
from querygrove.functions import lexing
from querygrove.options import options
from querygrove.prims import let, once, spread_by

KEYS = ("unit_id", "stmt_idx")

FACT_CAPS = {
    "table": "max_analysis_tables", "column": "max_analysis_columns", "join": "max_analysis_joins",
    "predicate": "max_analysis_predicates",
}

_STOPS = tuple(w for w in refdata.CLAUSE_WORDS if w != "FOR")


def bare(token: Column) -> Column:
    """Identifier without its quotes."""
    return F.regexp_replace(token, '^["`]|["`]$', "")


def statement_tokens(statements: DataFrame, keep: Sequence[str] = (), only: Column | None = None, compared: bool = True) -> DataFrame:
    """Classified token rows of well-formed statements; with ``only``, of those whose profile passes that test.

    Not ``compared``: without what ``token_rows`` tells of comparisons.

    Adds ``stmt_kind``, ``paren_root``, ``nested`` (has a subquery) and the
    flags of ``classified``. ``lexing.dealt`` statements are read where they lie.
    """
    opaque = ("explain", "command", "txn", "grant", "copy", "execute")
    ready = lexing.with_profile(statements)
    nested = lexing.has_subquery(ready)
    ready = ready.filter(F.col("problem").isNull() & ~F.col("kind").isin(*opaque))
    ready = ready if only is None else ready.filter(only)
    rows = lexing.token_rows(
        ready.select(
            *KEYS, "sql", *keep, F.col("kind").alias("stmt_kind"), F.col("prof.parenthesised").alias("paren_root"),
            nested.alias("nested"),
        ),
        KEYS, keep=("stmt_kind", "paren_root", "nested", *keep), spread=not lexing.is_dealt(statements), compared=compared,
    )
    return classified(rows)


def classified(rows: DataFrame) -> DataFrame:
    """Adds ``is_name`` (a name and no keyword), ``is_table``, ``is_column`` and a column's ``qualifier``."""
    reserved = lexing.sql_list(refdata.RESERVED_WORDS)
    word, before = lexing.sql_is_word("tok"), lexing.sql_is_word("p1")
    in_function = f"owner IN ({lexing.sql_list(refdata.FROM_FUNCTIONS)})"
    introduced = f"""(
        (head IN ('FROM', 'JOIN', 'INTO', 'TABLE', 'TRUNCATE', 'REFERENCES') AND NOT (head = 'FROM' AND ({in_function} OR head2 = 'DISTINCT')))
        OR (head = 'UPDATE' AND head2 NOT IN ('FOR', 'KEY', 'ON', 'DO')) OR (head = 'USING' AND stmt_kind IN ('delete', 'merge'))
        OR (head = 'EXISTS' AND head2 = 'IF') OR head = 'ONLY' OR (head = 'ON' AND stmt_kind = 'create')
        OR (head = ',' AND coalesce(clause, '') = 'FROM' AND NOT {in_function}))"""
    routine = "(n1 = '(' AND head IN ('FROM', 'JOIN', ',', 'USING'))"
    # an operand right before a name makes the name an alias
    ended = f"""(p1 <> '' AND (upper(p1) IN (')', 'END') OR p1 RLIKE '^[0-9\\']' OR ({before} AND upper(p1) NOT IN ({reserved}))))"""
    skip = f"""(({introduced} AND NOT {routine}) OR upper(p1) = 'AS' OR {ended} OR n1 IN ('(', '.') OR p1 = '::'
        OR (startswith(n1, '\\'') AND p1 <> '.') OR upper(p1) IN ('WITH', 'RECURSIVE', 'COLUMN', 'INDEX', 'SAVEPOINT')
        OR (p1 = ',' AND upper(n1) = 'AS' AND depth = 0 AND clause IS NULL))"""
    column_list = "(stmt_kind = 'insert' AND depth = 1 AND clause IS NULL)"
    plain = "stmt_kind IN ('select', 'set_op', 'update', 'delete', 'merge', 'insert')"
    named = rows.withColumn("is_name", F.expr(f"{word} AND (tok RLIKE '^[\"`]' OR word NOT IN ({reserved}))"))
    flags = once(
        named, is_table=F.expr(f"is_name AND {introduced} AND NOT {routine} AND n1 <> '.'"),
        is_column=F.expr(f"is_name AND {plain} AND NOT {skip} AND NOT {column_list}"),
    )
    return flags.withColumn("qualifier", F.when(F.col("is_column") & (F.col("p1") == "."), bare(F.col("p2"))))


def table_facts(rows: DataFrame) -> DataFrame:
    return rows.filter("is_table").select(*KEYS, F.lit("table").alias("fact_kind"), "pos", bare(F.col("tok")).alias("value"))


def column_facts(rows: DataFrame) -> DataFrame:
    return rows.filter("is_column").select(*KEYS, F.lit("column").alias("fact_kind"), "pos", bare(F.col("tok")).alias("value"))


def table_aliases(rows: DataFrame) -> DataFrame:
    """Declared names of a statement: tables and their aliases, with their position."""
    n1, n2 = F.col("n1"), F.col("n2")

    def free(c: Column) -> Column:
        return lexing.is_word(c) & ~F.upper(c).isin(*refdata.RESERVED_WORDS)

    alias = F.when(F.upper(n1) == "AS", bare(n2)).when(free(n1), bare(n1))
    tables = rows.filter("is_table")
    names = F.array_append(F.array_compact(F.array(alias)), bare(F.col("tok")))
    return tables.select(*KEYS, "pos", F.explode(names).alias("name"))


def _clause_starts(rows: DataFrame) -> DataFrame:
    """Adds ``join_detail`` to the tokens that begin a join, ``predicate_detail`` to WHERE/HAVING of the statement itself, and ``stop`` to both.

    A clause ends before the next boundary of the same depth or at the end of
    its block; no ``stop``: at the end of the statement.
    """
    p1 = F.upper("p1")
    word = F.col("word")
    join_start = word.isin(*refdata.JOIN_WORDS) & ~p1.isin(*refdata.JOIN_WORDS) & ~(
        word.isin("LEFT", "RIGHT") & (F.col("n1") == "("))  # the string functions
    comma = (F.col("tok") == ",") & (F.col("clause") == "FROM")
    stop = word.isin(*_STOPS) & (p1 != ".")
    lock = (word == "FOR") & F.upper("n1").isin("UPDATE", "SHARE", "NO", "KEY")
    mark = join_start | comma | stop | lock | (F.col("tok") == ")") | (F.col("tok") == ";")
    join = F.when(F.col("tok") == ",", "comma").when(word == "JOIN", "inner").otherwise(F.lower(word))
    top = (
        word.isin("WHERE", "HAVING") & (F.col("depth") == 0) & F.col("stmt_kind").isin("select", "update", "delete")
        & ~F.col("paren_root")
    )
    marks = rows.withColumn("_mark", F.when(mark, F.col("pos"))).withColumn("join_detail", F.when(join_start | comma, join)).withColumn(
        "predicate_detail", F.when(top & mark, F.lower("word")))
    # over all tokens, in the order they lie in: marks alone would have to be sorted again
    following = F.expr(f"lead(_mark) IGNORE NULLS OVER (PARTITION BY {', '.join(KEYS)}, inner ORDER BY pos)")
    return marks.withColumn("stop", following).drop("_mark")


def _found(statements: DataFrame, rows: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Facts of the given kinds, from one pass over the tokens.

    The facts of a statement, a list bounded by its text, meet the text that
    clauses are cut from; both are partitioned by the statement key, and no token is written.
    """
    def entry(when: Column, kind: str, detail: Column, stop: Column, value: Column) -> Column:
        return F.when(when, F.struct(
            F.lit(kind).alias("fact_kind"), F.col("pos").alias("pos"), detail.alias("detail"), stop.alias("stop"), value.alias("value")))

    none, name = F.lit(None).cast("string"), bare(F.col("tok"))
    entries = {
        "table": entry(F.col("is_table"), "table", none, F.lit(None).cast("int"), name),
        "column": entry(F.col("is_column"), "column", none, F.lit(None).cast("int"), name),
        "join": entry(F.col("join_detail").isNotNull(), "join", F.col("join_detail"), F.col("stop"), none),
        "predicate": entry(F.col("predicate_detail").isNotNull(), "predicate", F.col("predicate_detail"), F.col("stop"), none),
    }
    known = F.col(KEYS[0]).isNotNull() & F.col(KEYS[1]).isNotNull()
    listed = F.array_compact(F.array(*[entries[kind] for kind in kinds]))
    # tokens without a key are no one statement: their facts are not listed together, and no text is theirs
    entered = _clause_starts(rows).select(
        *KEYS, F.when(~known, F.monotonically_increasing_id()).alias("_alone"), F.explode(listed).alias("_entry"))
    texts = statements.select(*KEYS, F.struct("sql").alias("_text")).filter(known)
    texts = texts if lexing.is_dealt(statements) else spread_by(lexing.fixed(texts), *KEYS)
    per = entered.unionByName(texts, allowMissingColumns=True).groupBy(*KEYS, "_alone").agg(
        F.collect_list("_entry").alias("_entries"), F.collect_list("_text").alias("_texts"))

    def is_clause(e: Column) -> Column:
        return e["fact_kind"].isin("join", "predicate")

    def fact(e: Column, value: Column) -> Column:
        return F.struct(e["fact_kind"].alias("fact_kind"), e["pos"].alias("pos"), value.alias("value"), e["detail"].alias("detail"))

    def cut(e: Column) -> Column:
        """The range of tokens of a clause as text, in every text that the key comes with."""
        def value(toks: Column) -> Column:
            length = F.coalesce(e["stop"], F.size(toks)) - e["pos"]
            return let(F.slice(toks, e["pos"] + 1, length), lexing.canonical)

        return F.transform("_toks", lambda toks: fact(e, value(toks)))

    toks = F.when(F.exists("_entries", is_clause), F.transform("_texts", lambda t: lexing.tokens(lexing.clean(t["sql"]))))
    names = F.transform(F.filter("_entries", lambda e: ~is_clause(e)), lambda e: fact(e, e["value"]))
    clauses = F.flatten(F.transform(F.filter("_entries", is_clause), cut))
    return once(per, _toks=toks).select(*KEYS, F.explode(F.concat(names, clauses)).alias("_fact")).select(*KEYS, "_fact.*")


def clause_facts(rows: DataFrame, statements: DataFrame) -> DataFrame:
    """Joins (anywhere) and WHERE/HAVING of the statement itself, as text."""
    return _found(statements, rows, ("join", "predicate")).select(*KEYS, "fact_kind", "pos", "detail", "value")


def facts(statements: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Long table of facts: one row per table, column, join or predicate."""
    rows = statement_tokens(statements, compared=False) if rows is None else rows
    return _found(statements, rows, ("table", "column", "join", "predicate"))


def bounded_facts(found: DataFrame, caps: dict[str, int] | None = None) -> DataFrame:
    """Facts within their cap per unit and kind, with what was cut.

    A unit is one input of bounded size, so its facts are one small window.
    """
    bounds = options()
    caps = {kind: bounds[name] for kind, name in FACT_CAPS.items()} if caps is None else caps
    unit = Window.partitionBy("unit_id", "fact_kind")
    cap = F.create_map(*[x for kind, n in caps.items() for x in (F.lit(kind), F.lit(n))])
    limit = F.try_element_at(cap, F.col("fact_kind"))
    return (
        found.withColumn("total", F.count(F.lit(1)).over(unit))
        .withColumn("rank", F.row_number().over(unit.orderBy("stmt_idx", "pos")))
        .filter(F.col("rank") <= limit)
        .withColumn("truncated", F.col("total") > limit)
        .withColumn("suppressed_count", F.greatest(F.col("total") - limit, F.lit(0)).cast("long"))
        .drop("total")
    )
