"""Error triage: catalogue matching, ranking, hypotheses and the escalation worklist.

The catalogue is a constant, so all matching happens inside the row of an
error: an array of the entries that match, best first. Ranks, caps and counts
are read from that array; only counts over many errors shuffle. Texts of any
length are matched whole; a blank one has no match and ``input_kind`` "blank".
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querygrove import refdata
from querygrove.prims import once, prefix_sum, written

CONCLUSIVE = 2
MIN_CALL_TOKENS = 256

FIELDS = ("ordinal", "catalog_id", "severity", "specificity", "diagnosis", "fix_guidance")
_STRINGS = "array<string>"


def best_first() -> list[tuple[int, tuple]]:
    """The catalogue with its ordinals: the most specific entries first, in catalogue order among equals."""
    return sorted(enumerate(refdata.ERROR_CATALOG, 1), key=lambda entry: (-entry[1][6], entry[0]))


def required_literals(pattern: str) -> tuple[str, ...] | None:
    """Lower-cased texts of which a match of ``pattern`` holds at least one: the longest of each alternative.

    None where the pattern has more than word borders and gaps, so that nothing is known to be required.
    """
    found = []
    for alternative in pattern.split("|"):
        longest = max(re.split(r"\\b|\.\*", alternative), key=len).lower()
        if not longest or re.search(r"[\\.^$*+?{}\[\]()]", longest):
            return None
        found.append(longest)
    return tuple(dict.fromkeys(found))


def _coded(literal: str) -> bool:
    """An error code: it has a digit, and most texts have none."""
    return any(c.isdigit() for c in literal)


def literal_index(catalog: Sequence[tuple]) -> dict[str, int]:
    """Every literal that some pattern requires, with its place in the array of ``literals_found``."""
    every = [literal for entry in catalog for literal in required_literals(entry[1]) or ()]
    return {literal: place for place, literal in enumerate(dict.fromkeys(every))}


_INDEX = literal_index(refdata.ERROR_CATALOG)


def _text(value: str) -> str:
    """A text as an SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literals_found(low: str = "_low", digit: str = "_digit") -> Column:
    """Which literals of the index a lowered text holds: one plain search per literal, whatever the number of patterns that share it."""
    held = [f"{digit} AND contains({low}, {_text(t)})" if _coded(t) else f"contains({low}, {_text(t)})" for t in _INDEX]
    return F.expr(f"array({', '.join(held)})")


def hits(entry: tuple, text: str = "error_text", dialect: str = "dialect", found: str = "_found") -> str:
    """SQL: does a catalogue entry match the text in its dialect? Its pattern runs where a literal it requires was found."""
    tests = [] if entry[2] == "any" else [f"{dialect} = {_text(entry[2])}"]
    required = required_literals(entry[1])
    if required is not None:
        tests.append("(" + " OR ".join(f"{found}[{_INDEX[t]}]" for t in required) + ")")
    return " AND ".join([*tests, f"{text} RLIKE {_text('(?i)' + entry[1])}"])


def matches_of(text: str = "error_text", dialect: str = "dialect") -> Column:
    """Array of the matching entries, best first. One SQL text: spelled call by call it takes seconds to build."""
    found = []
    for ordinal, entry in best_first():
        catalog_id, _, _, diagnosis, fix, severity, specificity = entry
        values = (ordinal, _text(catalog_id), _text(severity), specificity, _text(diagnosis), _text(fix))
        fields = ", ".join(f"'{n}', {v}" for n, v in zip(FIELDS, values, strict=True))
        found.append(f"CASE WHEN {hits(entry, text, dialect)} THEN named_struct({fields}) END")
    return F.expr(f"array_compact(array({', '.join(found)}))")


def triage(errors: DataFrame) -> DataFrame:
    """``errors`` with ``input_kind`` (text or blank) and ``matches``, evaluated once per row.

    Lowered text, literals found, matches: each is one step inside the row, and only
    the few patterns whose literal occurs run over a long text.
    """
    kind = F.when(F.coalesce(F.col("error_text").rlike(r"\S"), F.lit(False)), "text").otherwise("blank")
    lowered = once(errors, input_kind=kind, _low=F.lower("error_text"), _digit=F.col("error_text").rlike("[0-9]"))
    indexed = once(lowered, _found=literals_found()).drop("_low", "_digit")
    return once(indexed, matches=matches_of()).drop("_found")


def ranked_matches(errors: DataFrame) -> DataFrame:
    """One row per error and matching entry, with its rank, tie ranks and the number of matches."""
    ranked = triage(errors).select("*", F.posexplode("matches").alias("_place", "_match"))
    better = F.filter("matches", lambda m: m["specificity"] > F.col("_match")["specificity"])
    return ranked.select(
        *errors.columns, "input_kind", *[F.col("_match")[f].alias(f) for f in FIELDS],
        (F.col("_place") + 1).alias("rank"), (F.size(better) + 1).alias("tie_rank"),
        (F.size(F.array_distinct(F.transform(better, lambda m: m["specificity"]))) + 1).alias("tie_dense_rank"),
        F.size("matches").cast("long").alias("n_matches"))


def match_errors(errors: DataFrame) -> DataFrame:
    """Every catalogue entry that matches an error text in its dialect."""
    return ranked_matches(errors).drop("rank", "tie_rank", "tie_dense_rank", "n_matches")


def capped_matches(errors: DataFrame, cap: int | None = None) -> DataFrame:
    """The best ``cap`` matches per error (None: all), and how many were left out."""
    over = F.lit(0).cast("long") if cap is None else F.greatest(F.col("n_matches") - cap, F.lit(0).cast("long"))
    ranked = ranked_matches(errors).withColumn("suppressed_count", over).withColumn("truncated", over > 0)
    return ranked if cap is None else ranked.filter(F.col("rank") <= cap)


def best_match(errors: DataFrame) -> DataFrame:
    """The best entry of every error that has one."""
    best = triage(errors).withColumn("_best", F.get("matches", F.lit(0))).filter("_best is not null")
    return best.select(*errors.columns, "_best.catalog_id", "_best.severity", "_best.specificity")


def _with_impact(errors: DataFrame, impact: DataFrame, key: str) -> DataFrame:
    """Errors with their matches and missing names: one join, on a side with a row per error."""
    missing = impact.select(key, "missing_tables", "missing_columns")
    joined = triage(errors).join(missing, key, "left")
    none = F.array().cast(_STRINGS)
    for name in ("missing_tables", "missing_columns"):
        joined = joined.withColumn(name, F.coalesce(name, none))
    return joined


def _hypotheses() -> Column:
    """Catalogue diagnoses first, then missing tables, then missing columns."""
    def entry(statement: Column, basis: str, step: Column) -> Column:
        return F.struct(statement.alias("statement"), F.lit(basis).alias("basis"), step.alias("next_diagnostic"))

    tables = entry(
        F.concat(F.lit(refdata.MISSING_TABLES[0]), F.array_join("missing_tables", ", "), F.lit(refdata.MISSING_TABLES[1])), "schema",
        F.lit(refdata.MISSING_TABLES[2]))
    columns = entry(
        F.concat(F.lit(refdata.MISSING_COLUMNS[0]), F.array_join("missing_columns", ", "), F.lit(refdata.MISSING_COLUMNS[1])), "schema",
        F.lit(refdata.MISSING_COLUMNS[2]))
    from_catalog = F.transform("matches", lambda m: entry(m["diagnosis"], "catalog", m["fix_guidance"]))
    schema = F.array_compact(F.array(F.when(F.size("missing_tables") > 0, tables), F.when(F.size("missing_columns") > 0, columns)))
    return F.concat(from_catalog, schema)


def hypotheses(errors: DataFrame, impact: DataFrame, cap: int | None = None, key: str = "event_id") -> DataFrame:
    """Ranked hypotheses of each error; at most ``cap`` (None: all), with the number left out.

    ``impact`` has one row per error with ``missing_tables`` and ``missing_columns`` arrays.
    """
    rows = once(_with_impact(errors, impact, key), _all=_hypotheses())
    kept = F.col("_all") if cap is None else F.slice("_all", 1, cap)
    over = F.size("_all") - F.size(kept)
    rows = rows.select(key, over.cast("long").alias("suppressed_count"), F.posexplode(kept).alias("_place", "_h"))
    return rows.select(key, (F.col("_place") + 1).alias("rank"), "_h.*", "suppressed_count", (F.col("suppressed_count") > 0).alias("truncated"))


def _steps() -> Column:
    """Guidance of the matches in order, then where to look for tables."""
    guidance = F.transform("matches", lambda m: m["fix_guidance"])
    return F.when(F.size("missing_tables") > 0, F.array_append(guidance, F.lit(refdata.LOCATE_TABLES))).otherwise(guidance)


def next_diagnostics(errors: DataFrame, impact: DataFrame, key: str = "event_id") -> DataFrame:
    """Ordered guidance per error that has any."""
    return _with_impact(errors, impact, key).select(key, _steps().alias("next_diagnostics")).filter(F.size("next_diagnostics") > 0)


def unmatched_errors(errors: DataFrame) -> DataFrame:
    """Errors without a conclusive match, blank ones included."""
    conclusive = F.exists("matches", lambda m: m["specificity"] >= CONCLUSIVE)
    return triage(errors).filter(~conclusive).drop("matches")


def estimated_tokens(text: Column) -> Column:
    return F.ceil(F.octet_length(text) / 4).cast("long")


def escalation_worklist(open_errors: DataFrame, redact, budget: int, total_budget: int | None = None,
                        max_chars: int | None = None, key: str = "event_id") -> DataFrame:
    """Inconclusive errors, redacted, with a status.

    ``budget`` is the budget of one call. With ``total_budget`` the batch is
    also bounded as a whole, in key order, by a two-pass running total. With
    ``max_chars`` prompts are cut and marked as truncated.
    """
    prompt = F.col("_prompt")
    cut = prompt if max_chars is None else F.substring(prompt, 1, max_chars)
    work = once(open_errors.select(key, "error_text"), _prompt=redact(F.col("error_text")))
    work = work.select(key, cut.alias("prompt"), (F.lit(False) if max_chars is None else F.length(prompt) > max_chars).alias("truncated"))
    work = work.withColumn("tokens", estimated_tokens(F.col("prompt")))
    exhausted = F.lit(budget < MIN_CALL_TOKENS)
    if total_budget is not None:
        work = written(work, "worklist")  # ranges are sampled before they are built: texts are redacted once
        work = prefix_sum(work, [key], "tokens", "running_tokens")
        exhausted = exhausted | (F.col("running_tokens") > total_budget)
    return work.withColumn("status", F.when(exhausted, "budget_exhausted").otherwise("pending"))


def debug_report(errors: DataFrame, impact: DataFrame, key: str = "event_id") -> DataFrame:
    """One row per error: matches, hypotheses, cross-check and diagnostics."""
    rows = once(_with_impact(errors, impact, key), _all=_hypotheses(), _next=_steps())
    return rows.select(
        key, "dialect", "input_kind", F.transform("matches", lambda m: m["catalog_id"]).alias("catalog_matches"),
        F.size("_all").cast("long").alias("n_hypotheses"), F.get("_all", F.lit(0))["statement"].alias("top_hypothesis"),
        "missing_tables", "missing_columns", F.col("_next").alias("next_diagnostics"),
        F.exists("matches", lambda m: m["specificity"] >= CONCLUSIVE).alias("conclusive"))


def error_profile(errors: DataFrame) -> DataFrame:
    """Counts per catalogue id, severity and day, with distinct users (exact and approximate): the total, per severity, per severity and id, and per all three."""
    day = F.floor(F.col("at_s") / 86_400).cast("long")
    found = match_errors(errors).select("severity", "catalog_id", day.alias("day"), "user_id")
    s, c, d, u = F.col("severity"), F.col("catalog_id"), F.col("day"), F.col("user_id")
    # a row per user first: next to a distinct count, every user of a group would have a sketch of its own
    users = found.groupingSets([[u], [s, u], [s, c, u], [s, c, d, u]], s, c, d, u).agg(
        F.count(F.lit(1)).alias("_n"), F.grouping_id().alias("_gid"))
    return users.groupBy("severity", "catalog_id", "day", F.shiftright("_gid", 1).alias("gid")).agg(
        F.sum("_n").alias("n"), F.count("user_id").alias("users"), F.approx_count_distinct("user_id", 0.01).alias("approx_users")).select(
        "severity", "catalog_id", "day", "n", "users", "approx_users", "gid")
