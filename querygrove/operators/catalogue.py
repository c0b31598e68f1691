"""Schema catalogue from migrations: ordering, change events, replay and state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querygrove import refdata
from querygrove.functions import lexing
from querygrove.prims import accounted, cut_lineage, once, segmented

NEVER = 2**62


def _name(path: str = "name") -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def convention(name: Column) -> Column:
    """Naming convention of a migration file; null when it has none."""
    out = None
    for label, pattern in refdata.CONVENTIONS:
        test = name.rlike(f"(?i){pattern}")
        out = F.when(test, label) if out is None else out.when(test, label)
    return out


def migration_convention(files: DataFrame) -> DataFrame:
    return files.withColumn("convention", convention(_name()))


def _versioned(files: DataFrame) -> DataFrame:
    """Files with a convention and their ``version``, as text without leading zeros."""
    digits = F.regexp_extract(_name(), r"(?i)^V?(\d+)_", 1)
    kept = migration_convention(files).filter(F.col("convention").isNotNull())
    text = F.when(F.col("convention").isin("numeric", "flyway"),
                  F.coalesce(F.nullif(F.regexp_replace(digits, "^0+", ""), F.lit("")), F.lit("0"))).otherwise(digits)
    return kept.withColumn("version", text)


def _numbered(keyed: DataFrame, lexical: bool) -> DataFrame:
    # numbers too long for a bigint still compare right: by length, then text
    order = [F.col("version")] if lexical else [F.length("version"), F.col("version")]
    ranks = segmented(keyed.select("repo", "path", "version").distinct(), ["repo"], [*order, F.col("path")], {"file_ord": ("sum", F.lit(1))})
    return keyed.join(ranks.select("repo", "path", "version", F.col("file_ord").cast("int").alias("file_ord")), ["repo", "path", "version"])


def migration_order(files: DataFrame, lexical: bool = False) -> DataFrame:
    """Files with a convention, numbered per repository by version.

    Versions are compared as numbers; ``lexical`` compares their text without
    leading zeros instead. Only paths and versions are scanned in order; a
    repository with most of the files spreads over all tasks.
    """
    return _numbered(_versioned(files), lexical)


def ambiguous_migrations(files: DataFrame) -> DataFrame:
    """Repositories whose files cannot be put in order, with the reason."""
    keyed = _versioned(files)
    mixed = keyed.groupBy("repo").agg(F.min("convention").alias("lo"), F.max("convention").alias("hi")).filter("lo <> hi").select(
        "repo", F.lit("ambiguous_migration_conventions").alias("kind"), F.concat_ws(",", "lo", "hi").alias("detail"))
    twice = keyed.groupBy("repo", "version").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("lo"), F.max("path").alias("hi")).filter("n > 1")
    twice = twice.groupBy("repo").agg(F.min(F.struct("version", "lo", "hi")).alias("d")).select(
        "repo", F.lit("duplicate_migration_version").alias("kind"), F.concat_ws(",", "d.version", "d.lo", "d.hi").alias("detail"))
    return mixed.unionByName(twice.join(mixed.select("repo"), "repo", "left_anti"))


def ordered_migrations(files: DataFrame) -> DataFrame:
    """Numbered files of the repositories that can be put in order."""
    good = files.join(ambiguous_migrations(files).select("repo"), "repo", "left_anti")
    return migration_order(good)


# --- change events ------------------------------------------------------------------------

_ID = r'["`]?([\p{L}_][\p{L}\p{N}_$]*)["`]?'
_QID = rf"(?:{_ID}\s*\.\s*)?{_ID}"
_ATTRIBUTE = r"(?i)\s+(?:NOT\s+NULL|NULL|DEFAULT|PRIMARY|UNIQUE|REFERENCES|CHECK|CONSTRAINT|COLLATE|GENERATED)\b.*$"
_DEFAULT = r"(?i)\bDEFAULT\s+('(?:[^']|'')*'|[^\s,]+(?:\([^)]*\))?)"
#: A table that a statement names, whatever else it says.
_MENTION = rf"(?i)\b(?:TABLE|ON|REFERENCES|INTO|UPDATE|FROM|JOIN)\s+(?:IF\s+(?:NOT\s+)?EXISTS\s+)?(?:ONLY\s+)?{_QID}"
_REFERENCE = rf"(?i)\bREFERENCES\s+{_QID}\s*(?:\(([^)]*)\))?"


#: Pieces of a list that together give it back: literals, the three signs that matter, and the rest.
_PIECE = r"'(?:[^']++|'')*+'|[(),]|[^(),']++|'"


def _items(text: Column) -> Column:
    """Comma separated items, with parentheses nested to any depth and literals inside."""
    def step(acc: Column, piece: Column) -> Column:
        depth = acc["depth"] + F.when(piece == "(", 1).when(piece == ")", -1).otherwise(0)
        ends = (piece == ",") & (acc["depth"] == 0)
        return F.struct(
            depth.alias("depth"), F.when(ends, F.lit("")).otherwise(F.concat(acc["item"], piece)).alias("item"),
            F.when(ends, F.array_append(acc["items"], acc["item"])).otherwise(acc["items"]).alias("items"))

    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("item"), F.array().cast("array<string>").alias("items"))
    found = F.aggregate(F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0)), start, step, lambda acc: F.array_append(acc["items"], acc["item"]))
    return F.filter(F.transform(found, lambda i: F.trim(i)), lambda i: i != "")


def _names(text: Column) -> Column:
    """Identifiers of a comma separated list."""
    return F.filter(
        F.transform(F.split(text, ","), lambda n: F.regexp_replace(F.trim(n), r'^["`]|["`]$|\s.*$', "")), lambda n: n != "")


EVENT = (
    "op string, tbl string, col string, new_col string, data_type string, nullable boolean, default_text string, "
    "idx string, cols array<string>, is_unique boolean, is_partial boolean, is_expression boolean, ref_tbl string, "
    "ref_cols array<string>"
)
_EVENTS = "array<struct<" + ",".join(part.replace(" ", ":", 1) for part in EVENT.split(", ")) + ">>"
_FIELDS = [tuple(part.strip().split(" ", 1)) for part in EVENT.split(", ")]


def _event(op: str, **values: Column) -> Column:
    return F.struct(*[
        (F.lit(op) if name == "op" else values[name] if name in values else F.lit(None)).cast(kind).alias(name)
        for name, kind in _FIELDS
    ])


def _column_events(tbl: Column, item: Column) -> Column:
    """Events of one column definition: the column, its keys and its reference."""
    name = F.regexp_extract(item, rf"^{_ID}", 1)
    rest = F.regexp_replace(item, rf"^{_ID}\s*", "")
    data_type = F.upper(F.trim(F.regexp_replace(F.regexp_replace(F.concat(F.lit(" "), rest), _ATTRIBUTE, ""), r"\s*\(\s*", "(")))
    data_type = F.regexp_replace(data_type, r"\s*,\s*", ", ")
    has = lambda p: rest.rlike(rf"(?i)\b{p}\b")
    add = _event("add_column", tbl=tbl, col=name, data_type=F.when(data_type == "", "UNKNOWN").otherwise(data_type),
                 nullable=~has(r"NOT\s+NULL"), default_text=F.nullif(F.regexp_extract(rest, _DEFAULT, 1), F.lit("")))
    ref = F.regexp_extract(rest, _REFERENCE, 2)
    return F.array_compact(F.array(
        add,
        F.when(has(r"PRIMARY\s+KEY"), _event("primary_key", tbl=tbl, cols=F.array(name))),
        F.when(has("UNIQUE"), _event("unique", tbl=tbl, cols=F.array(name))),
        F.when(ref != "", _event("foreign_key", tbl=tbl, cols=F.array(name), ref_tbl=ref, ref_cols=_names(F.regexp_extract(rest, _REFERENCE, 3)))),
    ))


def _table_item_events(tbl: Column, item: Column) -> Column:
    body = F.regexp_replace(item, rf"(?i)^CONSTRAINT\s+{_ID}\s+", "")
    inner = _names(F.regexp_extract(body, r"^[^(]*\(([^)]*)\)", 1))
    word = lambda p: body.rlike(rf"(?i)^{p}")
    return (
        F.when(word(r"PRIMARY\s+KEY"), F.array(_event("primary_key", tbl=tbl, cols=inner)))
        .when(word(r"UNIQUE\s*\("), F.array(_event("unique", tbl=tbl, cols=inner)))
        .when(word(r"FOREIGN\s+KEY"), F.array(_event(
            "foreign_key", tbl=tbl, cols=inner, ref_tbl=F.regexp_extract(body, _REFERENCE, 2),
            ref_cols=_names(F.regexp_extract(body, _REFERENCE, 3)))))
        .when(word(r"(?:CHECK|EXCLUDE|LIKE)\b"), F.array(_event("unsupported_table_expression", tbl=tbl)))
        .otherwise(_column_events(tbl, item))
    )


def _alter_events(tbl: Column, item: Column) -> Column:
    drop = rf"(?i)^DROP\s+COLUMN\s+(?:IF\s+EXISTS\s+)?{_ID}"
    rename = rf"(?i)^RENAME\s+(?:COLUMN\s+)?{_ID}\s+TO\s+{_ID}"
    add = r"(?i)^ADD\s+(?:COLUMN\s+)?(?:IF\s+NOT\s+EXISTS\s+)?"
    return (
        F.when(item.rlike(drop), F.array(_event("drop_column", tbl=tbl, col=F.regexp_extract(item, drop, 1))))
        .when(item.rlike(rename), F.array(_event(
            "rename_column", tbl=tbl, col=F.regexp_extract(item, rename, 1), new_col=F.regexp_extract(item, rename, 2))))
        .when(item.rlike(r"(?i)^ADD\s+(?:COLUMN\b|(?!CONSTRAINT\b|PRIMARY\b|UNIQUE\b|FOREIGN\b|CHECK\b))"),
              F.slice(_column_events(tbl, F.regexp_replace(item, add, "")), 1, 1))
        .otherwise(F.array(_event("unsupported_alter_action", tbl=tbl)))
    )


def ddl_events(migrations: DataFrame) -> DataFrame:
    """Change rows of ordered migrations, in order, all from inside the row.

    ``seq`` orders the events of a repository: file, statement, action.
    Statements that are no supported DDL are ``unsupported_*`` rows.
    """
    statements = migrations.select(
        "repo", "path", "file_ord", F.posexplode(lexing.statement_texts(F.col("content"))).alias("stmt_idx", "sql"))
    flat = F.regexp_replace(lexing.without_comments(F.col("sql")), r"\s+", " ")
    ready = once(lexing.with_profile(statements), _t=F.trim(flat))
    t, mask = F.col("_t"), F.col("mask")
    create = rf"(?i)^CREATE (?:TEMP(?:ORARY)? )?TABLE (?:IF NOT EXISTS )?{_QID} ?\("
    tbl = F.regexp_extract(t, create, 2)
    body = F.regexp_replace(F.regexp_replace(t, create, ""), r"\)[^)]*$", "")
    items = _items(body)
    created = F.concat(F.array(_event("create_table", tbl=tbl)), F.flatten(F.transform(items, lambda i: _table_item_events(tbl, i))))
    index = rf"(?i)^CREATE (UNIQUE )?INDEX (?:CONCURRENTLY )?(?:IF NOT EXISTS )?{_ID} ON (?:ONLY )?{_QID} ?(?:USING \w+ ?)?\((.*)\)( WHERE .*)?$"
    index_items = _items(F.regexp_extract(t, index, 5))
    indexed = F.array(_event(
        "create_index", idx=F.regexp_extract(t, index, 2), tbl=F.regexp_extract(t, index, 4),
        cols=F.transform(index_items, lambda i: F.when(F.contains(i, F.lit("(")), i).otherwise(F.regexp_extract(i, _ID, 1))),
        is_unique=F.regexp_extract(t, index, 1) != "", is_partial=F.regexp_extract(t, index, 6) != "",
        is_expression=F.exists(index_items, lambda i: F.contains(i, F.lit("(")))))
    alter = rf"(?i)^ALTER TABLE (?:IF EXISTS )?(?:ONLY )?{_QID} "
    altered_table = F.regexp_extract(t, alter, 2)
    altered = F.flatten(F.transform(_items(F.regexp_replace(t, alter, "")), lambda i: _alter_events(altered_table, i)))
    dropped = rf"(?i)^DROP TABLE (?:IF EXISTS )?"
    drops = F.transform(_names(F.regexp_replace(t, dropped, "")), lambda n: _event("drop_table", tbl=F.regexp_replace(n, r"^.*\.", "")))
    drop_index = rf"(?i)^DROP INDEX (?:CONCURRENTLY )?(?:IF EXISTS )?{_QID}"
    mentioned = F.array_distinct(F.regexp_extract_all(t, F.lit(_MENTION), F.lit(2)))
    new_type = F.array(F.regexp_extract(t, rf"(?i)^CREATE TYPE {_QID}", 2))
    events = (
        F.when(F.col("problem").isin("unclosed_quote", "unbalanced_parentheses"), F.array(_event("parse_failure", cols=mentioned)))
        .when(F.col("problem") == "no_statement", F.array().cast(_EVENTS))
        .when(t.rlike(create), created).when(t.rlike(index), indexed)
        .when(mask.rlike("^ CREATE TYPE "), F.array(_event("unsupported_type", cols=new_type)))
        .when(mask.rlike("^ CREATE "), F.array(_event("unsupported_create")))
        .when(t.rlike(alter), altered).when(t.rlike(dropped), drops)
        .when(t.rlike(drop_index), F.array(_event("drop_index", idx=F.regexp_extract(t, drop_index, 2))))
        .when(F.col("kind").isin("command", "unknown"), F.array(_event("unsupported_command")))
    )
    rows = once(ready, _e=events).select("repo", "path", "file_ord", "stmt_idx", F.posexplode("_e").alias("action", "e")).select(
        "repo", "path", "file_ord", "stmt_idx", "action", "e.*")
    return rows.withColumn("seq", event_order())


# --- state --------------------------------------------------------------------------------

def live_tables(events: DataFrame) -> DataFrame:
    """Tables whose last create or drop is a create, with the place of that create."""
    last = events.filter(F.col("op").isin("create_table", "drop_table")).groupBy("repo", "tbl").agg(
        F.max("seq").alias("born"), F.max_by("op", "seq").alias("op"))
    return last.filter(F.col("op") == "create_table").drop("op")


_COLUMN_OPS = ("add_column", "drop_column", "rename_column")
_TABLE_OPS = ("create_table", "drop_table")


def with_table_state(events: DataFrame) -> DataFrame:
    """``events`` with ``_table``: (seq, op) of the last CREATE or DROP of its table before it; a scan that a hot table does not hold up."""
    mark = F.when(F.col("op").isin(*_TABLE_OPS), F.struct("seq", "op"))
    return segmented(events, ["repo", "tbl"], ["seq"], {"_table": ("max_before", mark)})


def _followed(nodes: DataFrame, rounds: int) -> DataFrame:
    """Pointer doubling: every node (at, next, exit, hops) with the hops to the end of its chain and the exit there.

    In a round each node asks the one it points to. Nodes and questions meet by
    key in one shuffle, and the plan grows by one step a round: nothing is
    written and no job runs in between. A node that is asked for and does not
    exist is an end that is still open.
    """
    for _ in range(rounds):
        met = nodes.select("*", F.explode(F.when(
            F.col("next").isNull(), F.array(F.struct(F.col("at").alias("key"), F.lit(False).alias("ask"))),
        ).otherwise(F.array(F.struct(F.col("at").alias("key"), F.lit(False).alias("ask")), F.struct(F.col("next").alias("key"), F.lit(True).alias("ask"))))).alias("q"))
        told = met.withColumn("own", F.first(F.when(~F.col("q.ask"), F.struct("next", "exit", "hops")), ignorenulls=True).over(Window.partitionBy("q.key")))
        ask = F.col("q.ask")
        nodes = told.filter(ask | F.col("next").isNull()).select(
            "at", F.when(ask, F.col("own.next")).alias("next"), F.when(ask, F.col("own.exit")).otherwise(F.col("exit")).alias("exit"),
            F.when(ask & F.col("own").isNotNull(), F.concat("hops", "own.hops")).otherwise(F.col("hops")).alias("hops"))
    return nodes


def column_history(events: DataFrame) -> DataFrame:
    """Every column with the span of its validity: repo, tbl, col, data_type, valid_from, valid_to (null: still there).

    Events count from a table's CREATE to its next CREATE or DROP. In that time
    a name is cut into segments at the events that clear it (ADD, DROP, RENAME
    to another name). An added column starts in its segment and moves on to the
    new name's segment where a RENAME ends it, so that each segment has one
    successor and all chains are followed together in as many rounds as the
    logarithm of the longest possible one. Where two columns come to be in a
    segment the later one replaces the other; a RENAME without a column moves nothing.
    A column's row holds one entry per rename it went through.
    """
    marked = with_table_state(events.filter(F.col("tbl").isNotNull()).select("repo", "tbl", "seq", "op", "col", "new_col", "data_type"))
    marked = marked.filter(F.col("_table.op") == "create_table").withColumn("born", F.col("_table.seq"))
    ended = marked.filter(F.col("op").isin(*_TABLE_OPS)).select("repo", "tbl", "born", F.col("seq").alias("ended"))
    spans = _column_spans(marked).join(ended, ["repo", "tbl", "born"], "left")
    return spans.select("repo", "tbl", "col", "data_type", "valid_from", F.coalesce("valid_to", "ended").alias("valid_to"))


def _column_spans(marked: DataFrame) -> DataFrame:
    """Spans of the columns in the time of their table, which began at ``born``."""
    recent = marked.filter(F.col("op").isin(*_COLUMN_OPS) & (F.coalesce("new_col", F.lit("")) != F.col("col")))

    def touch(name: str, kind: str) -> Column:
        return F.struct(F.col(name).alias("name"), F.lit(kind).alias("kind"))

    touches = recent.select("repo", "tbl", "born", "seq", "data_type", F.explode(
        F.when(F.col("op") == "rename_column", F.array(touch("col", "away"), touch("new_col", "into")))
        .when(F.col("op") == "add_column", F.array(touch("col", "add"))).otherwise(F.array(touch("col", "drop")))).alias("t")).select(
        "repo", "tbl", "born", "seq", "data_type", "t.*")
    earlier = Window.partitionBy("repo", "tbl", "born", "name").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    touches = cut_lineage(touches.withColumn("start", F.coalesce(F.max(F.when(F.col("kind") != "into", F.col("seq"))).over(earlier), F.col("born"))))

    def segment(name: str, start: str) -> Column:
        return F.struct("repo", "tbl", "born", F.col(name).alias("name"), F.col(start).alias("start"))

    renamed = touches.filter(F.col("kind").isin("away", "into")).groupBy("repo", "tbl", "born", "seq").agg(*[
        F.max(F.when(F.col("kind") == kind, F.col(c))).alias(f"{kind}_{c}") for kind in ("away", "into") for c in ("name", "start")])
    hop = F.struct(F.col("into_name").alias("name"), F.col("into_start").alias("start"), F.col("seq").alias("entry"))
    links = renamed.select(segment("away_name", "away_start").alias("at"), segment("into_name", "into_start").alias("next"), F.col("seq").alias("exit"), F.array(hop).alias("hops"))
    nothing = F.lit(None).cast(links.schema["next"].dataType).alias("next"), F.array().cast(links.schema["hops"].dataType).alias("hops")
    closed = touches.filter(F.col("kind").isin("add", "drop")).select(segment("name", "start").alias("at"), nothing[0], F.col("seq").alias("exit"), nothing[1])
    longest = renamed.groupBy("repo", "tbl", "born").count().agg(F.max("count")).first()[0] or 0
    ends = _followed(links.unionByName(closed), longest.bit_length())

    added = touches.filter("kind = 'add'").select("data_type", F.col("seq").alias("entry"), segment("name", "seq").alias("at"))
    added = added.join(ends, "at", "left")
    first = F.array(F.struct(F.col("at.name").alias("name"), F.col("at.start").alias("start"), F.col("entry").alias("entry")))
    added = added.withColumn("stay", F.concat(first, F.coalesce("hops", nothing[1])))
    stays = added.select("at", "data_type", "exit", "stay", F.posexplode(F.transform("stay", lambda x: x["entry"])).alias("i", "from"))
    stays = stays.select(
        F.col("at.repo").alias("repo"), F.col("at.tbl").alias("tbl"), F.col("at.born").alias("born"), F.get("stay", F.col("i"))["name"].alias("col"),
        F.get("stay", F.col("i"))["start"].alias("start"), "from", "data_type", F.coalesce(F.get("stay", F.col("i") + 1)["entry"], F.col("exit")).alias("leave"),
        F.reverse(F.slice(F.transform("stay", lambda x: x["entry"]), F.lit(1), F.col("i") + 1)).alias("path"))
    place = ["repo", "tbl", "born", "col", "start"]
    # Of columns that took the same rename, only the one that had replaced the others was there.
    real = stays.groupBy(*place, "from").agg(F.max_by(F.struct("data_type", "leave"), "path").alias("c"))
    pushed = F.lead("from").over(Window.partitionBy(*place).orderBy("from"))
    return real.select("repo", "tbl", "born", "col", "c.data_type", F.col("from").alias("valid_from"), F.least(F.col("c.leave"), pushed).alias("valid_to"))


def live_columns(events: DataFrame) -> DataFrame:
    """Final columns of the live tables with the event they came from: only what follows the last CREATE is looked at."""
    recent = events.select("repo", "tbl", "seq", "op", "col", "new_col", "data_type").join(live_tables(events), ["repo", "tbl"]).filter(F.col("seq") > F.col("born"))
    return _column_spans(recent).filter("valid_to is null").drop("valid_to")


def schema_state(events: DataFrame) -> DataFrame:
    """Final columns of the live tables."""
    return live_columns(events).select("repo", "tbl", "col", "data_type")


def schema_as_of(events: DataFrame, requests: DataFrame) -> DataFrame:
    """Columns at each requested point: ``requests`` (repo, version) with tbl, col and data_type.

    An as-of join by interval tree: a span is filed under the smallest binary
    range of versions that holds it, and a request looks into its one range per
    size. All comparisons are by equal keys, and what is met in a range but not
    valid at the request is no more than what is valid at the range's middle.
    """
    spans = column_history(events).withColumn("_last", F.coalesce("valid_to", F.lit(NEVER)) - 1)
    differ = F.col("valid_from").bitwiseXOR(F.col("_last"))
    spans = spans.withColumn("_level", F.when(differ == 0, 0).otherwise(F.length(F.bin(differ))))
    spans = spans.withColumn("_range", F.expr("shiftright(valid_from, _level)"))
    wanted = requests.select("repo", "version", F.explode(F.sequence(F.lit(0), F.lit(62))).alias("_level")).withColumn("_range", F.expr("shiftright(version, _level)"))
    met = wanted.join(spans, ["repo", "_level", "_range"]).filter("valid_from <= version and version <= _last")
    return met.select("repo", "version", "tbl", "col", "data_type")


_ALTERS = ("add_column", "drop_column", "rename_column", "unsupported_alter_action")


def _alters_unknown() -> Column:
    """For events of ``with_table_state``: an ALTER on a table that does not exist at that moment."""
    missing = F.coalesce(F.col("_table.op"), F.lit("drop_table")) == "drop_table"
    return F.col("tbl").isNotNull() & F.col("op").isin(*_ALTERS) & missing


def altered_unknown(events: DataFrame) -> DataFrame:
    """ALTER events on tables that do not exist at that moment: the last create or drop before an event decides."""
    return with_table_state(events).filter(_alters_unknown()).drop("_table")


def foreign_keys(events: DataFrame) -> DataFrame:
    """Foreign keys that no later drop of either table removed."""
    drops = events.filter(F.col("op") == "drop_table").groupBy("repo", "tbl").agg(F.max("seq").alias("_dropped"))
    keys = events.filter(F.col("op") == "foreign_key").select("repo", "seq", "tbl", "cols", "ref_tbl", "ref_cols")
    source = drops.withColumnRenamed("_dropped", "_s")
    target = drops.select("repo", F.col("tbl").alias("ref_tbl"), F.col("_dropped").alias("_t"))
    return keys.join(source, ["repo", "tbl"], "left").join(target, ["repo", "ref_tbl"], "left").filter(
        (F.coalesce("_s", F.lit(-1)) < F.col("seq")) & (F.coalesce("_t", F.lit(-1)) < F.col("seq"))).drop("_s", "_t")


def index_state(events: DataFrame) -> DataFrame:
    """Indexes created after their table's last CREATE and not dropped since."""
    last = events.filter(F.col("op").isin("create_index", "drop_index")).groupBy("repo", "idx").agg(
        F.max_by(F.struct("op", "seq", "tbl", "cols", "is_unique", "is_partial", "is_expression"), "seq").alias("l")).select("repo", "idx", "l.*")
    return last.filter(F.col("op") == "create_index").join(live_tables(events), ["repo", "tbl"]).filter(
        F.col("seq") > F.col("born")).select("repo", "tbl", "idx", "cols", "is_unique", "is_partial", "is_expression")


def event_order() -> Column:
    """One long in the order of file, statement and action: room for 2**25 statements a file and 2**15 actions a statement; more is an error."""
    file, stmt = F.col("file_ord").cast("long"), F.col("stmt_idx").cast("long")
    fits = (stmt < (1 << 25)) & (F.col("action") < (1 << 15))
    return F.when(fits, file * F.lit(1 << 40) + stmt * F.lit(1 << 15) + F.col("action")).otherwise(
        F.raise_error(F.concat(F.lit("too many statements or actions in "), "path")).cast("long"))


def ddl_warnings(events: DataFrame, cap: int | None = None) -> DataFrame:
    """Unsupported DDL with the capabilities it compromises, per repository the first ``cap`` (None: all), with how many were left out."""
    every = F.array(*[F.lit(c) for c in refdata.SCHEMA_CAPABILITIES])
    none = F.array().cast("array<string>")
    compromised = F.when(F.col("op") == "unsupported_type", F.array(F.lit("column_type"))).when(
        F.col("op") == "parse_failure", every).otherwise(none)
    marked = with_table_state(events.select("repo", "seq", "path", "stmt_idx", "op", "tbl")).withColumn("_unknown", _alters_unknown())
    plain = marked.filter((F.col("op").startswith("unsupported") | (F.col("op") == "parse_failure")) & ~F.col("_unknown")).select("repo", "seq", "path", "op", "tbl")
    unknown = marked.filter("_unknown").groupBy("repo", "path", "stmt_idx").agg(F.min(F.struct("seq", "tbl")).alias("u")).select(
        "repo", "u.seq", "path", F.lit("alter_unknown_table").alias("op"), "u.tbl")
    found = plain.unionByName(unknown).withColumn("compromised", compromised).withColumn(
        "affects", F.size("compromised") > 0)
    return accounted(found, ["repo"], [F.col("seq"), F.col("op")], cap)


def completeness_warnings(events: DataFrame, columns: DataFrame) -> DataFrame:
    """(repo, object_name, capability): what the replayed catalogue cannot be sure of, table by table.

    A statement that could not be read compromises every capability of the
    tables it names; a type that is not understood, the type of the columns
    declared with it.
    """
    every = F.array(*[F.lit(c) for c in refdata.SCHEMA_CAPABILITIES])
    unread = events.filter("op = 'parse_failure'").select("repo", F.explode("cols").alias("object_name")).distinct().select(
        "repo", "object_name", F.explode(every).alias("capability"))
    types = events.filter("op = 'unsupported_type'").select("repo", F.upper(F.get("cols", F.lit(0))).alias("data_type")).distinct()
    typed = columns.join(types, ["repo", "data_type"], "left_semi").select("repo", F.col("tbl").alias("object_name"), F.lit("column_type").alias("capability"))
    return unread.unionByName(typed).distinct()


def replayed(events: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The catalogue of replayed events as the lint rules read it: columns, indexes and warnings."""
    columns = cut_lineage(catalogue_of(events))
    indexes = index_state(events).withColumnRenamed("cols", "columns")
    return columns, indexes, completeness_warnings(events, columns)


def fk_graph(keys: DataFrame) -> DataFrame:
    """Adjacency of tables: targets in key order (one table has a bounded number of keys)."""
    return keys.groupBy("repo", F.col("tbl").alias("src")).agg(
        F.array_sort(F.collect_list(F.struct("seq", "ref_tbl"))).alias("_t")).select(
        "repo", "src", F.transform("_t", lambda t: t["ref_tbl"]).alias("targets"))


def schema_fingerprint(migrations: DataFrame, block: int = 4096) -> DataFrame:
    """Order-sensitive hash over the paths and contents of a repository's migrations.

    Hashes of ``block`` consecutive files are hashed, and then those: no list
    holds all files of a repository.
    """
    part = F.concat_ws(":", "path", F.sha2("content", 256))
    parts = migrations.select("repo", F.floor(F.col("file_ord") / block).alias("at"), "file_ord", part.alias("part"))

    def folded(df: DataFrame, keys: list[str], order: str) -> DataFrame:
        listed = F.array_sort(F.collect_list(F.struct(order, "part")))
        return df.groupBy(*keys).agg(F.sha2(F.array_join(F.transform(listed, lambda p: p["part"]), "|"), 256).alias("part"))

    return folded(folded(parts, ["repo", "at"], "file_ord"), ["repo"], "at").withColumnRenamed("part", "fingerprint")


def catalogue_of(events: DataFrame) -> DataFrame:
    """Column catalogue in the form the lint rules read, from replayed events: columns in the order in which they came to be."""
    return live_columns(events).select("repo", "tbl", "col", F.col("valid_from").alias("ordinal"), "data_type", F.col("born").alias("tbl_ord"))
