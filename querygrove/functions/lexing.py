"""Lexical columns over SQL text, built from Spark's regex and array functions.

A statement is looked at as an array of tokens inside its row, or, where the
nesting depth of every token matters, as one row per token (`token_rows`).

Backslashes escape in literals that begin with E, and in all of them where a
``dialect`` column names a dialect that reads them so. Block comments nest up to
12 levels.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querygrove import refdata
from querygrove.prims import let, once, shared, spread_by, text_partitions

# Possessive quantifiers keep the matcher linear and free of deep recursion on
# long literals, comments and scripts.
_BACKSLASHED = r"'(?:[^'\\]++|\\(?s:.)|'')*+'"
_PREFIX = r"(?<![\p{L}\p{N}_$])[eE]"
#: An E before the quote belongs to the literal.
_STRING = rf"(?<={_PREFIX}){_BACKSLASHED}|'(?:[^']++|'')*+'"
_QUOTED = r'"[^"]*+"|`[^`]*+`'
_QUOTED_BACKSLASHED = r'"(?:[^"\\]++|\\(?s:.)|"")*+"|`[^`]*+`'
_LINE_COMMENT = r"--[^\n]*+"
#: A body between equal dollar tags; a dollar inside a name begins none.
_DOLLAR = r"(?<![\p{L}\p{N}_$])\$(?<tag>(?:[\p{L}_][\p{L}\p{N}_]*+)?)\$(?s:.*?)\$\k<tag>\$"


def _nested_comment(levels: int = 12) -> str:
    plain = r"[^*/]++|\*(?!/)|/(?!\*)"
    pattern = rf"/\*(?:{plain})*+\*/"
    for _ in range(levels - 1):
        pattern = rf"/\*(?:{plain}|{pattern})*+\*/"
    return pattern


#: Balanced, or else up to the first end, or to the end of the text.
_BLOCK_COMMENT = _nested_comment() + r"|/\*(?s:.*?)(?:\*/|\z)"

def _token(string: str, quoted: str) -> str:
    """One alternative per token class; whatever is left over is a one-character token."""
    return "|".join((
        _LINE_COMMENT, _BLOCK_COMMENT, f"[eE]{_BACKSLASHED}", string, quoted, _DOLLAR, r"\$[0-9]+", r"[\p{L}_][\p{L}\p{N}_$]*+",
        r"[0-9]++(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?", r"<>|<=|>=|!=|\|\||::|->>|->", r"[^\s]",
    ))


def _statement(string: str, quoted: str) -> str:
    """A statement: everything up to a semicolon outside quotes and comments."""
    return f"(?:{string}|{quoted}|{_DOLLAR}|{_LINE_COMMENT}|{_BLOCK_COMMENT}|" + r"[^;'\"`/$-]++|['\"`/$-])++"


def _kept(string: str, quoted: str) -> str:
    """Literals and quoted names, kept, or a comment."""
    return rf"({string}|{quoted}|{_DOLLAR})|{_LINE_COMMENT}|{_BLOCK_COMMENT}"


#: How literals and quoted names read: usually, and where all backslashes escape.
_USUAL, _ESCAPING = (_STRING, _QUOTED), (_BACKSLASHED, _QUOTED_BACKSLASHED)


def dialect_of(df: DataFrame) -> Column | None:
    return F.col("dialect") if "dialect" in df.columns else None


def _escaping(sql: Column, dialect: Column | None) -> Column | None:
    """Do backslashes escape in this text? None: the dialect is not known."""
    return None if dialect is None else dialect.isin(*refdata.BACKSLASH_DIALECTS) & F.contains(sql, F.lit("\\"))


def _read(sql: Column, dialect: Column | None, apply: Callable[[str, str], Column]) -> Column:
    """``apply`` with the literals of the text's dialect."""
    escaping = _escaping(sql, dialect)
    return apply(*_USUAL) if escaping is None else F.when(escaping, apply(*_ESCAPING)).otherwise(apply(*_USUAL))


def clean(sql: Column) -> Column:
    """Text without a byte order mark at its start."""
    return F.regexp_replace(sql, "^﻿", "")


def strip(sql: Column) -> Column:
    return F.btrim(sql, F.lit(" \t\r\n\f"))


def statement_texts(sql: Column, dialect: Column | None = None) -> Column:
    """Non-empty statement texts of a script, in order."""
    text = clean(sql)
    parts = _read(text, dialect, lambda *literals: F.regexp_extract_all(text, F.lit(_statement(*literals)), F.lit(0)))
    return F.filter(F.transform(parts, strip), lambda part: part != "")


def all_pieces(sql: Column, dialect: Column | None = None) -> Column:
    """Tokens and blanks, which together give the text back."""
    return _read(sql, dialect, lambda *literals: F.regexp_extract_all(sql, F.lit(_token(*literals).replace(r"[^\s]", r"\s+|[^\s]")), F.lit(0)))


def all_tokens(sql: Column, dialect: Column | None = None) -> Column:
    return _read(sql, dialect, lambda *literals: F.regexp_extract_all(sql, F.lit(_token(*literals)), F.lit(0)))


def is_comment(token: Column) -> Column:
    return token.startswith("--") | token.startswith("/*")


def tokens(sql: Column, dialect: Column | None = None) -> Column:
    """Tokens of a statement without its comments; literals without their prefix."""
    found = F.filter(all_tokens(sql, dialect), lambda token: ~is_comment(token))
    return F.when(sql.rlike("[eE]'"), F.transform(found, lambda token: F.regexp_replace(token, "^[eE](?=')", ""))).otherwise(found)


def _is_text(token: Column) -> Column:
    return (token.startswith("'") & (F.length(token) > 1)) | token.rlike(r"^\$[^0-9]|^[eE]'")


def _is_quoted(token: Column) -> Column:
    return (token.startswith('"') | token.startswith("`")) & (F.length(token) > 1)


def token_kind(token: Column) -> Column:
    first = F.substring(token, 1, 1)
    return (
        F.when(is_comment(token), "comment")
        .when(_is_text(token), "string")
        .when(_is_quoted(token), "identifier")
        .when(first.between("0", "9"), "number")
        .when((first == "$") & (F.length(token) > 1), "parameter")
        .when(first.rlike(r"[\p{L}_]"), "identifier")
        .otherwise("operator")
    )


KEPT = _kept(*_USUAL)
_LITERAL = rf"{_PREFIX}('){_BACKSLASHED[1:]}" + r"""|(')(?:[^']++|'')*+'|(["`])[^"`]*+["`]"""
_SIGN = r"""([0-9]+\.[0-9]+|<>|<=|>=|!=|\|\||::|->>|->|['"`](?!\?)|[-(),;.\[\]{}+*/%=<>~@#&^|!:?](?<!['"`]\?))"""


def without_comments(sql: Column, dialect: Column | None = None) -> Column:
    """Every comment as a blank."""
    return _read(sql, dialect, lambda *literals: F.regexp_replace(sql, _kept(*literals), "$1 "))


def plain_escapes(sql: Column, dialect: Column | None) -> Column:
    """Literals with backslashes as empty ones, where the dialect reads them so; a text without comments is expected."""
    escaping = _escaping(sql, dialect)
    if escaping is None:
        return sql
    text = F.regexp_replace(sql, rf"(`[^`]*+`)|(['\"])(?:(?<=')(?:[^'\\]++|\\(?s:.)|'')*+'|(?<=\")(?:[^\"\\]++|\\(?s:.)|\"\")*+\")", "$1$2$2")
    return F.when(escaping, text).otherwise(sql)


def plain_bodies(sql: Column) -> Column:
    """Dollar-quoted bodies replaced by a plain literal. Other literals are matched first, so that dollars inside of them stay."""
    text = F.regexp_replace(sql, rf"({_STRING}|{_QUOTED})|{_DOLLAR}", "$1\u0001")
    for quote in ("'", '"', "`"):
        text = F.replace(text, F.lit(f"{quote}\u0001"), F.lit(quote))
    return F.when(F.contains(sql, F.lit("$")), F.replace(text, F.lit("\u0001"), F.lit("'body'"))).otherwise(sql)


def spaced(plain: Column) -> Column:
    text = F.regexp_replace(plain, _LITERAL, " $1$2$3? ")
    text = F.regexp_replace(text, _SIGN, " $1 ")
    return F.upper(F.concat(F.lit(" "), F.regexp_replace(text, r"^\s+|\s+(?=\s)|\s+$", ""), F.lit(" ")))


def masked(sql: Column) -> Column:
    """Upper-cased words and signs between single blanks, literals and quoted names masked.

    Four replacements over the text. Patterns over the result cannot be misled
    by the content of literals; a quote without a partner stays a sign.
    """
    return let(let(without_comments(sql), plain_bodies), spaced)


def with_mask(df: DataFrame, sql: str = "sql") -> DataFrame:
    """Adds ``mask``: ``masked`` of a text without byte order mark, read by its dialect.

    Each step is a column, which later steps may use several times; a text
    without the signs of a comment, an escape or a dollar quote is not searched for them.
    """
    dialect, text = dialect_of(df), F.col("_text")
    comment = F.contains(text, F.lit("--")) | F.contains(text, F.lit("/*"))
    steps = (
        df.withColumn("_text", clean(F.col(sql)))
        .withColumn("_text", F.when(comment, without_comments(text, dialect)).otherwise(text))
        .withColumn("_text", plain_escapes(text, dialect)).withColumn("_text", plain_bodies(text))
    )
    # A barrier: filters on what follows would else be pushed below it and repeat every step.
    return once(steps, mask=spaced(text)).drop("_text")


def canonical(toks: Column) -> Column:
    """One-line text of a statement: comments gone, blanks normalised."""
    def set_apart(token: Column, i: Column) -> Column:
        before = F.get(toks, i - 1)
        glued = (
            (i == 0) | token.isin(",", ")", ".", ";", "]", "::") | before.isin("(", ".", "[", "::")
            | ((token == "(") & before.rlike(r"^[\p{L}_]") & ~F.upper(before).isin(*refdata.RESERVED_WORDS))
        )
        return F.when(glued, token).otherwise(F.concat(F.lit(" "), token))

    return F.array_join(F.transform(toks, set_apart), "")


_INNERMOST = r"\( [^()]*+\) "
_COLLAPSE_PASSES = 6
_QUERY_WORDS = r" (SELECT|INSERT|UPDATE|DELETE|MERGE|VALUES) "
_CLAUSE_END = "|".join(w for w in refdata.CLAUSE_WORDS if w != "SELECT")


def outline(mask: Column) -> Column:
    """Masked text with parenthesised blocks replaced by ``#``, six levels deep."""
    for _ in range(_COLLAPSE_PASSES):
        mask = F.regexp_replace(mask, _INNERMOST, "# ")
    return mask


def full_outline(partial: Column) -> Column:
    """Goes on collapsing texts that nest deeper, until nothing changes.

    What is left then are parentheses without a partner.
    """
    def again(acc: Column, _: Column) -> Column:
        text = F.regexp_replace(acc["text"], _INNERMOST, "# ")
        return F.when(acc["done"], acc).otherwise(F.struct(text.alias("text"), (text == acc["text"]).alias("done")))

    passes = F.sequence(F.lit(1), F.greatest(F.size(F.split(partial, r"\(")), F.lit(1)))
    deep = F.aggregate(passes, F.struct(partial.alias("text"), F.lit(False).alias("done")), again)["text"]
    return F.when(partial.rlike(r"[()]"), deep).otherwise(partial)


def profile(mask: Column, top: Column) -> Column:
    """What a statement's masked text and its outline tell, as a struct.

    ``lead`` is the first word, ``main`` the word that decides the kind of the
    statement (after a list of common tables, the first query word outside
    parentheses). ``where0`` and ``setop0`` are about depth 0 only. ``star`` is
    the first star of the top projection: 1 plain, 2 qualified, 0 none.
    """
    lead = F.regexp_extract(mask, r"^[ (]*+([^ (]+)", 1)
    projection = F.regexp_extract(top, rf" SELECT (.*?)(?:(?: (?:{_CLAUSE_END}))? $| (?:{_CLAUSE_END}) )", 1)
    star = F.regexp_extract(projection, r"(?:^|, |DISTINCT |ALL |\. )\*", 0)
    return F.struct(
        lead.alias("lead"),
        F.when(lead == "WITH", F.regexp_extract(top, _QUERY_WORDS, 1)).otherwise(lead).alias("main"),
        F.contains(top, F.lit(" WHERE ")).alias("where0"),
        top.rlike(r" (UNION|INTERSECT|EXCEPT) ").alias("setop0"),
        F.when(star == "", 0).when(star.startswith("."), 2).otherwise(1).alias("star"),
        mask.rlike(r" ['\"`] ").alias("open_quote"),
        mask.startswith(" ( ").alias("parenthesised"),
        (~top.rlike(r"[()]")).alias("balanced"),
    )


def kind_of(prof: Column) -> Column:
    """Kind of a statement from its profile; ``unknown`` when the lead word opens none."""
    pairs = F.expr(f"map({sql_list([x for pair in refdata.STATEMENT_KINDS for x in pair])})")
    kind = F.coalesce(F.try_element_at(pairs, prof["main"]), F.lit("unknown"))
    return F.when((kind == "select") & prof["setop0"], "set_op").otherwise(kind)


_DANGLING = (
    r" (FROM|WHERE|HAVING|JOIN|ON|SET|INTO|BY|AND|OR)"
    r"( $| (FROM|WHERE|GROUP|HAVING|ORDER|LIMIT|UNION|INTERSECT|EXCEPT|JOIN|\)) )"
)


def problem(prof: Column, mask: Column) -> Column:
    """Why a statement cannot be well-formed SQL; null when nothing speaks against it."""
    return (
        F.when(prof["lead"] == "", "no_statement")
        .when(prof["open_quote"], "unclosed_quote")
        .when(~prof["balanced"], "unbalanced_parentheses")
        .when(kind_of(prof) == "unknown", "unknown_statement")
        .when(mask.rlike(_DANGLING), "dangling_clause")
    )


def with_profile(df: DataFrame, sql: str = "sql") -> DataFrame:
    """Adds ``mask``, ``prof``, ``kind`` and ``problem``; regexes only, no shuffle.

    The steps are columns of their own, so that none is repeated; the last one
    is a barrier that keeps later filters from repeating all of them. ``dealt``
    statements have their profile already.
    """
    if is_dealt(df):
        return df
    df = (
        with_mask(df, sql)
        .withColumn("_outline", F.when(F.contains("mask", F.lit("(")), outline(F.col("mask"))).otherwise(F.col("mask")))
        .withColumn("_top", full_outline(F.col("_outline")))
        .withColumn("prof", profile(F.col("mask"), F.col("_top")))
        .drop("_outline", "_top")
    )
    return once(df, kind=kind_of(F.col("prof")), problem=problem(F.col("prof"), F.col("mask")))


def has_subquery(df: DataFrame) -> Column:
    """Of profiled statements: is there a query in parentheses?"""
    return F.col("_nested") if is_dealt(df) else F.col("mask").rlike(r" \( (SELECT|WITH) ")


def has_where(df: DataFrame) -> Column:
    """Of profiled statements: is there a WHERE, at whatever depth?"""
    return F.col("_where") if is_dealt(df) else F.contains("mask", F.lit(" WHERE "))


def is_dealt(df: DataFrame) -> bool:
    return {"_nested", "_where"} <= set(df.columns)


def dealt(df: DataFrame, keys: Sequence[str], by: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Statements profiled once and hash partitioned by ``by`` (some of ``keys``), for reports with several readers.

    Readers cut their tokens from the partitions as they lie and write none;
    windows, aggregations and joins along the keys need no further shuffle.
    There are so many partitions that the tokens of each are sorted in memory.
    """
    if is_dealt(df):
        return df
    n = text_partitions(df, "sql")
    ready = with_profile(df)
    ready = ready.select(
        *keys, *keep, "sql", "kind", "problem", F.struct("prof.star", "prof.parenthesised").alias("prof"),
        has_subquery(ready).alias("_nested"), has_where(ready).alias("_where"))
    return shared(fixed(ready), by, n)


def fixed(df: DataFrame) -> DataFrame:
    """Behind a barrier: a key that is one constant would drop out of windows, whose rows then no longer lie where they should."""
    return df.select(F.explode(F.array(F.struct(*[c for c in df.columns]))).alias("_row")).select("_row.*")


def sql_list(words: Sequence[str]) -> str:
    """Words as the inside of an SQL IN list."""
    return ", ".join("'" + w.replace("'", "\\'") + "'" for w in words)


def _at(k: int) -> str:
    """Name of the column with the token ``k`` places on."""
    return "tok" if k == 0 else f"p{-k}" if k < 0 else f"n{k}"


def sql_is_word(x: str) -> str:
    return "substring(" + x + r", 1, 1) RLIKE '[\\p{L}_\"`]'"


def _near(compared: bool) -> dict[str, str]:
    """What is told of a token from its neighbours, as SQL text; ``compared``: with ``side`` and ``literal``."""
    def starts(x: str) -> str:
        return f"upper({x}) IN ({sql_list(refdata.OPERAND_STARTS)})"

    def ends(x: str) -> str:
        return f"({x} = '' OR upper({x}) IN ({sql_list(refdata.OPERAND_ENDS)}))"

    def literal(x: str) -> str:
        return f"(startswith({x}, '\\'') OR substring({x}, 1, 1) BETWEEN '0' AND '9')"

    def shifted(dotted: int, plain: int) -> str:
        return f"CASE WHEN {_at(-1)} = '.' THEN {_at(dotted)} ELSE {_at(plain)} END"

    def ahead_of_name(k: int) -> str:
        return f"upper(CASE WHEN {_at(-1)} <> '.' THEN {_at(-k)} WHEN {_at(-3)} <> '.' THEN {_at(-k - 2)} ELSE {_at(-k - 4)} END)"

    names = {"head": ahead_of_name(1), "head2": ahead_of_name(2)}
    if not compared:
        return names
    signs = sql_list(refdata.COMPARISONS)
    before = shifted(-3, -1)
    # the operand left of the operator before this token, and what precedes it
    other, ahead, farther = shifted(-4, -2), shifted(-5, -3), shifted(-7, -5)
    other_is_column = f"({sql_is_word(other)} AND ({starts(ahead)} OR ({ahead} = '.' AND {starts(farther)})))"
    left = f"({_at(1)} IN ({signs}) AND {starts(before)})"
    right = f"({before} IN ({signs}) AND {ends(_at(1))} AND NOT {other_is_column})"
    return names | {
        "side": f"CASE WHEN NOT {sql_is_word('tok')} THEN NULL WHEN {left} THEN 'L' WHEN {right} THEN 'R' END",
        "literal": f"CASE WHEN NOT {sql_is_word('tok')} THEN NULL WHEN {left} AND {literal(_at(2))} AND {ends(_at(3))} THEN {_at(2)} "
                   f"WHEN {right} AND {literal(other)} AND {starts(ahead)} THEN {other} END",
    }


def _neighbours(texts: DataFrame, columns: Sequence[str], compared: bool) -> DataFrame:
    """One row per word and bracket of ``_toks``, with the tokens around it.

    The token array is zipped with copies of itself that are moved by some
    places, which costs far less than a function of every token.
    """
    places = [k for k in (range(-7, 4) if compared else range(-6, 3)) if k]
    moved = [f"concat(array_repeat('', {-k}), _toks)" if k < 0 else f"slice(_toks, {k + 1}, size(_toks))" for k in places]
    # the tokens that get a row keep their place among all tokens
    near = (f"filter(transform(arrays_zip(_toks, {', '.join(moved)}), (t, i) -> named_struct('pos', i, 'tok', t._toks, 'at', t)), "
            f"n -> n.tok IN ('(', ')', ',', '*', ';') OR {sql_is_word('n.tok')})")
    rows = texts.select(*columns, F.explode(F.expr(near)).alias("_near"))
    around = rows.select(*columns, "_near.pos", "_near.tok", *[
        F.coalesce(F.col("_near.at")[str(i)], F.lit("")).alias(_at(k)) for i, k in enumerate(places, 1)])
    return around.select(*columns, "pos", "tok", "p1", "p2", "n1", "n2", *[F.expr(text).alias(name) for name, text in _near(compared).items()])


def is_word(token: Column) -> Column:
    """A plain or quoted name or a keyword."""
    return F.substring(token, 1, 1).rlike(r'[\p{L}_"`]')


def token_rows(df: DataFrame, keys: Sequence[str], sql: str = "sql", keep: Sequence[str] = (), spread: bool = True,
               compared: bool = True) -> DataFrame:
    """One row per word and bracket of a statement with its neighbours, depth, block and clause.

    The statements (text, not tokens) are hash partitioned by their key first,
    unless they lie so already (``spread``); both windows below then work on that partitioning, so exploded tokens are
    sorted locally and never shuffled. A statement is one key, so a hot script
    or repository spreads over all tasks. Literals and operators only appear as
    neighbours, which keeps the rows to sort few.

    * ``head``, ``head2``: the two tokens before the (dotted) name
    * ``depth``: both parentheses of a pair carry the depth outside of it
    * ``block``: position of the parenthesis the token is inside of, -1 outside
    * ``owner``: word before that parenthesis
    * ``clause``: last clause word before the token in the same block
    * ``side``: L or R where a name is that operand of a comparison, alone
    * ``literal``: the other operand when it is one literal

    The last two cost most and are left out where they are not ``compared``.
    """
    in_order = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same_depth = Window.partitionBy(*keys, "inner").orderBy("pos").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    opening, closing = F.col("tok") == "(", F.col("tok") == ")"
    texts = spread_by(fixed(df), *keys) if spread else df
    rows = (
        _neighbours(once(texts, _toks=tokens(clean(F.col(sql)), dialect_of(df))), [*keys, *keep], compared)
        .withColumn("_after", F.sum(F.when(opening, 1).when(closing, -1).otherwise(0)).over(in_order))
        .withColumn("depth", (F.col("_after") - F.when(opening, 1).otherwise(0)).cast("int"))
        # the depth a parenthesis opens or closes; equal to the depth for other tokens
        .withColumn("inner", (F.col("depth") + F.when(opening | closing, 1).otherwise(0)).cast("int"))
        .withColumn("word", F.upper("tok"))
    )
    clause_word = F.expr(f"word IN ({sql_list(refdata.CLAUSE_WORDS)}) AND p1 <> '.'")
    others = [c for c in rows.columns if c != "_after"]
    return (
        rows.select(
            *others,
            F.max(F.when(opening, F.struct("pos", F.upper("p1").alias("owner")))).over(same_depth).alias("_open"),
            F.max(F.when(clause_word, F.struct("pos", "word"))).over(same_depth).alias("_last"),
        )
        .withColumn("block", F.coalesce("_open.pos", F.lit(-1)))
        .withColumn("owner", F.coalesce("_open.owner", F.lit("")))
        .withColumn("clause", F.when(F.col("_last.pos") > F.col("block"), F.col("_last.word")))
        .drop("_open", "_last")
    )
