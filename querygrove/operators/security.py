"""Security rules over units of SQL or Python source.

A rule is a row of ``refdata.SECURITY_RULES`` plus a predicate: a function of
the unit's statements or lines. Users add rules with ``Rule``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querygrove import refdata
from querygrove.functions import lexing
from querygrove.operators.files import MIGRATION_NAME
from querygrove.options import UNBOUNDED
from querygrove.prims import accounted, once, ranked

_HOST = r"(?iU)\b(?:" + "|".join(refdata.HOST_KEYWORDS) + r")\b"


@dataclass(frozen=True)
class Rule:
    """A rule added by a user: who it applies to and which units violate it.

    ``predicate`` maps the applicable units to finding rows with the columns
    ``unit_id, stmt_idx, line, message``; it may use ``mapInPandas`` inside.
    """

    rule_id: str
    title: str
    severity: str
    category: str
    input_kind: str
    roles: tuple[str, ...]
    needs_dialect: bool
    kind: str
    predicate: Callable[[DataFrame], DataFrame]
    fix: str | None = None
    dialect_scope: tuple[str, ...] | None = None


def resolve_units(files: DataFrame) -> DataFrame:
    """Input kind and role of files by their name."""
    name = F.regexp_extract("path", "([^/]*)$", 1)
    return files.select(
        F.col("path").alias("unit_id"),
        F.when(F.col("path").endswith(".py"), "python_source").otherwise("sql").alias("input_kind"),
        F.when(name.endswith(".sql") & name.rlike(f"(?i){MIGRATION_NAME}"), "migration").otherwise("script").alias("input_role"),
        "content",
    )


def _rules(extra: tuple[Rule, ...] = ()) -> list[Column]:
    rows = [(r[0], r[2], r[4], r[5], r[6], None) for r in refdata.SECURITY_RULES]
    rows += [(r.rule_id, r.severity, r.input_kind, ",".join(r.roles), r.needs_dialect,
              ",".join(r.dialect_scope) if r.dialect_scope else None) for r in extra]
    return [
        F.struct(F.lit(a).alias("rule_id"), F.lit(b).alias("severity"), F.lit(c).alias("rule_kind"),
                 F.split(F.lit(d), ",").alias("roles"), F.lit(e).alias("needs_dialect"),
                 F.split(F.lit(f).cast("string"), ",").alias("scope"))
        for a, b, c, d, e, f in rows
    ]


def _covered(units: DataFrame, extra: tuple[Rule, ...] = ()) -> DataFrame:
    """Rows of ``units`` without their content, once per rule with its status; the rules are a constant array, so no join."""
    known = F.col("dialect") != "unknown"
    reason = (
        F.when(F.col("input_kind") != F.col("rule_kind"), "input_kind_mismatch")
        .when(~F.array_contains("roles", F.col("input_role")), "input_role_mismatch")
        .when(F.col("needs_dialect") & ~known, "dialect_mismatch")
        .when(F.col("scope").isNotNull() & known & ~F.array_contains("scope", F.col("dialect")), "dialect_mismatch")
    )
    status = (
        F.when(F.col("reason").isNull(), "evaluated").when(F.col("reason") == "dialect_mismatch", "skipped")
        .otherwise("not_applicable")
    )
    others = [c for c in units.columns if c != "content"]
    return (
        units.select(*others, F.explode(F.array(*_rules(extra))).alias("rule")).select(*others, "rule.*")
        .withColumn("reason", reason).withColumn("status", status)
    )


def rule_coverage(units: DataFrame, extra: tuple[Rule, ...] = ()) -> DataFrame:
    """Dense matrix of rules and units."""
    return _covered(units, extra).select(
        "unit_id", *[c for c in ("repo",) if c in units.columns], "rule_id", "status", "reason")


def lines(units: DataFrame) -> DataFrame:
    """Source lines numbered from 1."""
    keep = [c for c in units.columns if c != "content"]
    return units.select(*keep, F.posexplode(F.split("content", "\r\n|\n|\r")).alias("i", "line")).withColumn(
        "line_no", F.col("i") + 1).drop("i")


def fstring_sql(line: Column) -> Column:
    return line.rlike(_HOST) & line.rlike(r"""(?U)\bf['"]""") & F.contains(line, F.lit("{"))


def concat_sql(line: Column) -> Column:
    return line.rlike(_HOST) & line.rlike(r"""['"][^'"]*['"]\s*\+|\+\s*['"][^'"]*['"]""")


def source_findings(units: DataFrame) -> DataFrame:
    """SEC-001 and SEC-002 on the lines of Python units."""
    hits = F.array_compact(F.array(
        F.when(fstring_sql(F.col("line")), F.struct(
            F.lit("SEC-001").alias("rule_id"),
            F.lit("Detected potentially unsafe dynamic SQL construction (f-string interpolation with SQL keywords).").alias("message"))),
        F.when(concat_sql(F.col("line")), F.struct(
            F.lit("SEC-002").alias("rule_id"),
            F.lit("Detected potentially unsafe dynamic SQL construction (string concatenation with SQL keywords).").alias("message"))),
    ))
    return (
        once(lines(units.filter(F.col("input_kind") == "python_source")), _hits=hits)
        .withColumn("_hit", F.explode("_hits"))
        .select(*[c for c in units.columns if c != "content"], F.lit(0).alias("stmt_idx"), F.col("line_no").alias("line"),
                "_hit.*")
    )


_DROP_TABLE = r"^ DROP (TEMPORARY |TEMP )?TABLE "
_DROP_COLUMN = r"(?<= )DROP COLUMN (?:IF EXISTS )?(\S+)"


def dropped_columns(prof: Column, sql: Column) -> Column:
    """Names of the columns an ALTER TABLE drops, in order."""
    text = F.concat(F.lit(" "), F.array_join(lexing.tokens(lexing.clean(sql)), " "), F.lit(" "))
    names = F.regexp_extract_all(text, F.lit(f"(?i){_DROP_COLUMN}"), F.lit(1))
    return F.when(prof["main"] == "ALTER", F.transform(names, lambda n: F.regexp_replace(n, '^["`]|["`]$', "")))


def statement_rules(role: Column, dialect: Column) -> Column:
    """Array of (rule_id, message) for one profiled statement."""
    kind, mask, prof = F.col("kind"), F.col("mask"), F.col("prof")
    drop_table = (kind == "drop") & mask.rlike(_DROP_TABLE)

    def hit(condition: Column, rule_id: str, message: Column | str) -> Column:
        text = F.lit(message) if isinstance(message, str) else message
        return F.when(condition, F.struct(F.lit(rule_id).alias("rule_id"), text.alias("message")))

    note = F.when(
        mask.rlike(r" TABLE IF EXISTS "),
        F.lit("DROP TABLE (destructive schema operation) — IF EXISTS present (suppresses error, does not prevent destruction)"),
    ).otherwise("DROP TABLE (destructive schema operation)")
    fixed = F.array_compact(F.array(
        hit(drop_table, "SEC-003", note),
        hit(kind == "truncate", "SEC-004", "TRUNCATE TABLE (destructive data operation — removes all rows)."),
        hit((kind == "delete") & ~prof["where0"], "SEC-005", "DELETE without WHERE clause (unbounded deletion)."),
        hit((kind == "update") & ~prof["where0"], "SEC-006", "UPDATE without WHERE clause (unbounded update)."),
        hit(drop_table & (role == "migration"), "SEC-007",
            "DROP TABLE in migration context (irreversible — data loss cannot be rolled back after migration applies)."),
        hit((kind == "execute") & (dialect != "unknown"), "SEC-009",
            "EXECUTE statement detected. Verify the SQL is not dynamically constructed from untrusted input."),
    ))
    columns = F.when(role == "migration", F.transform(
        dropped_columns(prof, F.col("sql")),
        lambda n: F.struct(F.lit("SEC-008").alias("rule_id"),
                           F.concat(F.lit("ALTER TABLE DROP COLUMN "), n, F.lit(" (data loss — column data is destroyed).")).alias("message")),
    ))
    return F.concat(fixed, F.coalesce(columns, F.array().cast("array<struct<rule_id:string,message:string>>")))


def statement_findings(units: DataFrame) -> DataFrame:
    """SEC-003 to SEC-009 on the statements of SQL units. No shuffle."""
    keep = [c for c in units.columns if c != "content"]
    statements = units.filter(F.col("input_kind") == "sql").select(
        *keep, F.posexplode(lexing.statement_texts(F.col("content"), lexing.dialect_of(units))).alias("stmt_idx", "sql"))
    good = lexing.with_profile(statements).filter(F.col("problem").isNull())
    hits = once(good, _hits=statement_rules(F.col("input_role"), F.col("dialect")))
    return hits.withColumn("_hit", F.explode("_hits")).select(
        *keep, "stmt_idx", F.lit(1).alias("line"), "_hit.*")


def findings(units: DataFrame, extra: tuple[Rule, ...] = ()) -> DataFrame:
    """All findings of all rules with the attributes of their rule."""
    found = statement_findings(units).unionByName(source_findings(units))
    for rule in extra:
        fits = (F.col("input_kind") == rule.input_kind) & F.col("input_role").isin(*rule.roles)
        if rule.needs_dialect:
            fits = fits & (F.col("dialect") != "unknown")
        if rule.dialect_scope:
            fits = fits & F.col("dialect").isin("unknown", *rule.dialect_scope)
        hits = rule.predicate(units.filter(fits)).select("unit_id", "stmt_idx", "line", "message")
        keep = units.select(*[c for c in units.columns if c != "content"])
        found = found.unionByName(keep.join(hits, "unit_id").withColumn("rule_id", F.lit(rule.rule_id)))
    rows = [(r[0], r[1], r[2], r[7], r[8]) for r in refdata.SECURITY_RULES]
    rows += [(r.rule_id, r.title, r.severity, r.kind, r.fix) for r in extra]
    attributes = F.create_map(*[
        x for a, b, c, d, e in rows
        for x in (F.lit(a), F.struct(F.lit(b).alias("title"), F.lit(c).alias("severity"), F.lit(d).alias("kind"),
                                     F.lit(e).cast("string").alias("fix_suggestion")))
    ])
    return found.withColumn("_rule", F.try_element_at(attributes, F.col("rule_id"))).select(
        *found.columns, "_rule.*", F.lit(1).alias("col"), F.lit("static").alias("evidence"))


def ranked_findings(found: DataFrame, request: str = "repo", cap: int | None = None) -> DataFrame:
    """Findings of each request in source order; the first ``cap`` (None: all), with how many were left out."""
    order = [F.col(c) for c in ("stmt_idx", "line", "col", "rule_id", "unit_id", "message")]
    return accounted(found, [request], order, cap)


def security_scan(units: DataFrame, request: str = "repo", cap: int | None = None) -> DataFrame:
    """One row per request: counts, which combine map-side, and coverage.

    With ``cap`` also ``findings``, the first ``cap`` in the order of
    ``ranked_findings``; what exceeds it counts as suppressed. Without one, take
    the findings as rows from ``ranked_findings``.
    """
    found_rows = findings(units)
    first = None if cap is None else ranked(
        found_rows, [request], [F.col(c) for c in ("stmt_idx", "line", "col", "rule_id", "unit_id", "message")], cap
    ).groupBy(request).agg(F.array_sort(F.collect_list(F.struct(
        "rank", "unit_id", "stmt_idx", "line", "rule_id", "severity", "message"))).alias("findings"))  # at most cap entries
    cap = UNBOUNDED if cap is None else cap
    found = found_rows.groupBy(request).agg(
        F.count(F.lit(1)).alias("found"), F.count_if(F.col("severity") == "high").alias("high"),
        F.array_sort(F.collect_set("rule_id")).alias("rules"),  # at most one entry per rule
    )
    # rules are judged once per kind of unit, not per unit
    alike = units.groupBy(request, "input_kind", "input_role", "dialect").agg(F.count(F.lit(1)).alias("_n"))
    covered = _covered(alike).groupBy(request).agg(*[
        F.sum(F.when(F.col("status") == status, F.col("_n")).otherwise(0)).alias(status)
        for status in ("evaluated", "skipped", "not_applicable")])
    roles = alike.groupBy(request).agg(
        F.sum("_n").alias("units"), F.min("input_role").alias("_low"), F.max("input_role").alias("_high"))
    rows = roles.join(covered, request).join(found, request, "left")
    if first is not None:
        rows = rows.join(first, request, "left").withColumn("findings", F.coalesce(
            "findings", F.array().cast(first.schema["findings"].dataType)))
    return (
        rows.withColumn("input_role_resolved", F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise("mixed"))
        .withColumn("found", F.coalesce("found", F.lit(0).cast("long")))
        .withColumn("high", F.coalesce("high", F.lit(0).cast("long")))
        .withColumn("rules", F.coalesce("rules", F.array().cast("array<string>")))
        .withColumn("truncated", F.col("found") > cap)
        .withColumn("suppressed_count", F.greatest(F.col("found") - cap, F.lit(0).cast("long")))
        .withColumn("ruleset_version", F.lit(refdata.SECURITY_RULESET_VERSION))
        .drop("_low", "_high")
    )


def severity_rollup(found: DataFrame) -> DataFrame:
    by_severity = found.rollup("severity", "rule_id").agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id().cast("long").alias("gid"))
    by_role = found.cube("rule_id", "input_role").agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id().cast("long").alias("gid"))
    return by_severity.select(F.lit("severity").alias("report"), F.col("severity").alias("a"), F.col("rule_id").alias("b"), "n", "gid").unionByName(
        by_role.select(F.lit("role").alias("report"), F.col("rule_id").alias("a"), F.col("input_role").alias("b"), "n", "gid"))


# --- calls in host code -------------------------------------------------------------------

_TRIPLE = r'"""(?s:[^"\\]++|\\.|"(?!""))*+"""' + r"|'''(?s:[^'\\]++|\\.|'(?!''))*+'''"
_LINE_TEXT = r'"(?:[^"\\\n]|\\(?s:.))*+"' + r"|'(?:[^'\\\n]|\\(?s:.))*+'"
#: Comments, literals with their prefix, and what lies between: together they give the text back.
_HOST_PIECE = (
    rf"#[^\n]*+|(?:(?<![A-Za-z0-9_])[rRbBuUfF]{{1,2}})?(?:{_TRIPLE}|{_LINE_TEXT})"
    + r"""|(?:(?![rRbBuUfF]{0,2}['"])[^#'"])++|(?s:.)""")
#: Signs around the number of a line, see ``host_code``.
_MARK, _END = "\u0002", "\u0003"


def host_code(source: Column) -> Column:
    """Source text without comments, every literal as ``"S"`` or, where it interpolates, ``"F"``, and every line ended by its number.

    Line breaks stay, those inside of literals too, so that lines keep their numbers.
    """
    def plain(piece: Column) -> Column:
        literal = piece.rlike(r"""(?s)^[rRbBuUfF]{0,2}['"].""")
        breaks = F.regexp_replace(piece, r"[^\n]+", "")
        mark = F.when(piece.rlike("^[rRbBuU]?[fF]"), '"F"').otherwise('"S"')
        return F.when(piece.startswith("#"), F.lit("")).when(literal, F.concat(mark, breaks)).otherwise(piece)

    code = F.array_join(F.transform(F.regexp_extract_all(source, F.lit(_HOST_PIECE), F.lit(0)), plain), "")
    numbered = F.transform(F.split(code, "\n"), lambda line, i: F.concat(line, F.lit(_MARK), (i + 1).cast("string"), F.lit(_END)))
    return F.array_join(numbered, "\n")


def _bracketed(levels: int = 12) -> str:
    """A pair of brackets with what it holds, pairs nested to ``levels``."""
    inner = r"[^()\[\]{}]"
    pattern = rf"[(\[{{]{inner}*+[)\]}}]"
    for _ in range(levels - 1):
        pattern = rf"[(\[{{](?:{inner}|{pattern})*+[)\]}}]"
    return pattern


_BLANK = rf"(?:\s|{_MARK}[0-9]++{_END})*+"
_LITERALS = rf'"S"(?:{_BLANK}"S")*+'
_CONSTANT = rf"(?:{_LITERALS}|[0-9][0-9A-Za-z_.]*+|None\b|True\b|False\b|\.\.\.)"
_KEYWORD = rf"(?:\*\*|[A-Za-z_]\w*+{_BLANK}=(?!=))"
#: No positional argument, or a constant one: alone or in brackets.
_FIRST = rf"\)|{_KEYWORD}|(?:{_CONSTANT}|\({_BLANK}{_CONSTANT}{_BLANK}\)){_BLANK}[,)]"
#: A positional argument with another one behind it.
_MORE = rf"(?:[^,()\[\]{{}}]|{_bracketed()})++,{_BLANK}(?!\)|{_KEYWORD})"
#: A call: line, method, its first argument where that is simple, and its first two where there are two.
_CALL = rf"(?=[^{_MARK}]*+{_MARK}([0-9]++))\.{_BLANK}(executemany|execute){_BLANK}\({_BLANK}(?=({_FIRST}|))(?=({_MORE}|))"


def host_calls(sources: DataFrame) -> DataFrame:
    """unit_id and ``calls``: line, method and facts of every call of an execute method in the code, calls inside of arguments included."""
    code = once(sources.select("unit_id", "content"), _code=host_code(F.col("content"))).drop("content")
    found = once(code, **{f"_g{i}": F.regexp_extract_all("_code", F.lit(_CALL), F.lit(i)) for i in range(1, 5)})

    def facts(c: Column) -> Column:
        first, none = c["_g3"], c["_g3"].rlike(rf"^(?:\)|{_KEYWORD})")
        return F.struct(
            c["_g1"].cast("int").alias("line_no"), c["_g2"].alias("method"), none.alias("no_args"), ((first != "") & ~none).alias("constant"),
            first.rlike(rf'^\(?{_BLANK}"S"').alias("text"), (c["_g4"] != "").alias("more_args"))

    return found.select("unit_id", F.transform(F.arrays_zip("_g1", "_g2", "_g3", "_g4"), facts).alias("calls"))


def dynamic_execute_calls(sources: DataFrame) -> DataFrame:
    """One row per call whose first argument is not a constant, with the line the call begins in; comments and literals hold no calls."""
    dynamic = F.filter("calls", lambda c: ~c["no_args"] & ~c["constant"])
    return host_calls(sources).select("unit_id", F.inline(F.transform(dynamic, lambda c: F.struct(c["line_no"].alias("line_no"), c["method"].alias("method")))))


def parameterized_files(sources: DataFrame) -> DataFrame:
    """A file is safe when it has calls and each has a constant text or more arguments."""
    fine = F.forall("calls", lambda c: c["no_args"] | c["text"] | c["more_args"])
    return host_calls(sources).select("unit_id", ((F.size("calls") > 0) & fine).alias("safe"))
