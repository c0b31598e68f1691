"""Captured planner plans: ingest, flatten, bound, redact, summarise and compare.

A plan is one row with its JSON text. Flattening stays inside the row: level
after level of the tree is taken from the parsed value, and the nodes of all
levels become rows once. There is no shuffle and one scan, however deep plans are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querygrove import refdata
from querygrove.functions import lexing
from querygrove.operators.statements import with_rejection
from querygrove.options import UNBOUNDED, options
from querygrove.prims import let, once, ranked


#: What only an object can be read as, at the cost of one field; ``schema_of_variant`` walks all that is below a value, and a value read as a variant is built anew.
_OBJECT = "struct<`Node Type`:string>"


def plan_ingest(plans: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Adds ``doc`` (the one element of the array) and ``error``; fails closed."""
    limit = options()["max_plan_response_bytes"] if max_bytes is None else max_bytes
    parsed = F.when(F.octet_length("plan_json") <= limit, F.try_parse_json("plan_json"))
    df = once(plans, _v=parsed)
    # elements that are no objects, and plans that are none, read as null
    shape = F.try_variant_get("_v", "$", f"array<struct<`Plan`:{_OBJECT}>>")
    error = (
        F.when(F.octet_length("plan_json") > limit, "plan_too_large")
        .when(F.col("_v").isNull(), "invalid_json")
        .when(F.coalesce(F.size(shape), F.lit(0)) != 1, "unexpected_structure")
        .when(F.get(shape, F.lit(0))["Plan"].isNull(), "missing_plan")
    )
    return df.withColumn("doc", F.try_variant_get("_v", "$[0]", "variant")).withColumn("error", error).drop("_v")


def good_plans(plans: DataFrame) -> DataFrame:
    return plan_ingest(plans).filter(F.col("error").isNull())


def _number(raw: Column, target: str) -> Column:
    """A numeric value; those of another type (also numbers in quotes) are null."""
    numeric = F.schema_of_variant(raw).rlike("^(BIGINT|DOUBLE|FLOAT|INT|SMALLINT|TINYINT|DECIMAL)")
    return F.when(numeric, F.try_variant_get(raw, "$", target))


def _text(raw: Column) -> Column:
    return F.when(F.schema_of_variant(raw) == "STRING", F.try_variant_get(raw, "$", "string"))


def visited_nodes(plans: DataFrame, max_depth: int | None = None) -> DataFrame:
    """All nodes (with ``max_depth``: down to one level below it), as an array by levels.

    Each entry has its ``path`` (child numbers from the root) and the node. A
    plan has no more levels than its text has lists of children.
    """
    levels = F.regexp_count("plan_json", F.lit('"Plans"')) + 2
    if max_depth is not None:
        levels = F.least(levels, F.lit(max_depth + 1))
    entry_type = "array<struct<path:array<int>,node:variant>>"
    root = F.array(F.struct(F.array().cast("array<int>").alias("path"),
                            F.try_variant_get("doc", "$.Plan", "variant").alias("node")))

    def children(entry: Column) -> Column:
        kids = F.coalesce(F.try_variant_get(entry["node"], "$.Plans", "array<variant>"), F.array().cast("array<variant>"))
        numbered = F.transform(kids, lambda k, i: F.struct(F.array_append(entry["path"], i).alias("path"), k.alias("node")))
        return F.filter(numbered, lambda k: F.try_variant_get(k["node"], "$", _OBJECT).isNotNull())

    def descend(acc: Column, _: Column) -> Column:
        # a plan without further levels passes its lists on
        below = F.struct(F.flatten(F.transform(acc["here"], children)).alias("here"),
                         F.concat(acc["seen"], acc["here"]).alias("seen"))
        return F.when(F.size(acc["here"]) > 0, below).otherwise(acc)

    start = F.struct(root.alias("here"), F.array().cast(entry_type).alias("seen"))
    return once(plans, _all=F.aggregate(F.sequence(F.lit(1), levels), start, descend)["seen"])


def _ordered(plans: DataFrame, max_nodes: int | None, max_depth: int | None) -> DataFrame:
    """``plans`` with ``_all`` and ``_order``: preorder, path, depth, ``kept`` and the place in ``_all`` of their visited nodes, in preorder."""
    df = visited_nodes(plans, max_depth)
    max_nodes = UNBOUNDED if max_nodes is None else max_nodes
    max_depth = UNBOUNDED if max_depth is None else max_depth

    def entry(o: Column, i: Column) -> Column:
        depth = F.size(o["path"]) + 1
        return F.struct(i.alias("preorder"), o["path"].alias("path"), depth.alias("depth"), ((i < max_nodes) & (depth <= max_depth)).alias("kept"),
                        o["at"].alias("at"))

    # variants have no order: sort the paths and look the nodes up by their place
    paths = F.transform("_all", lambda e, i: F.struct(e["path"].alias("path"), i.alias("at")))
    return once(df, _order=F.transform(F.array_sort(paths), entry))


#: The fields of a node that are read, taken from it at once.
_READ = ("Node Type", "Relation Name", "Index Name", "Startup Cost", "Total Cost", "Plan Rows", "Plan Width")


def plan_tree(plans: DataFrame, max_nodes: int | None = None, max_depth: int | None = None) -> DataFrame:
    """``plans`` with ``_nodes``: their visited nodes in preorder, as an array inside the row.

    ``kept`` is false for nodes that were visited and are beyond a bound. A
    node's place in preorder is its rank among the visited nodes of its plan.
    """
    fields = f"struct<{','.join(f'`{name}`:variant' for name in _READ)}>"

    def opened(o: Column) -> Column:
        node = F.get(F.col("_all"), o["at"])["node"]
        return F.struct(o.alias("o"), node.alias("node"), F.try_variant_get(node, "$", fields).alias("f"))

    def entry(n: Column) -> Column:
        o, f = n["o"], n["f"]
        return F.struct(
            *[o[c].alias(c) for c in ("preorder", "path", "depth", "kept")], n["node"].alias("node"),
            F.coalesce(_text(f["Node Type"]), F.lit("Unknown")).alias("op"), _text(f["Relation Name"]).alias("relation"),
            _text(f["Index Name"]).alias("index"), _number(f["Startup Cost"], "double").alias("startup_cost"),
            _number(f["Total Cost"], "double").alias("total_cost"), _number(f["Plan Rows"], "double").cast("long").alias("n_rows"),
            _number(f["Plan Width"], "double").cast("long").alias("width"))

    df = _ordered(plans, max_nodes, max_depth)
    return once(df, _nodes=F.transform(F.transform("_order", opened), entry)).drop("_all", "_order")


def _kept_columns(plans: DataFrame) -> list[str]:
    return [c for c in plans.columns if c not in ("plan_json", "doc", "error")]


def plan_nodes(plans: DataFrame, max_nodes: int | None = None, max_depth: int | None = None) -> DataFrame:
    """Node rows of good plans within the bounds, and the cut roots of what was left out."""
    keep = _kept_columns(plans)
    return plan_tree(plans, max_nodes, max_depth).select(*keep, F.explode("_nodes").alias("_n")).select(*keep, "_n.*")


def plan_bounds(plans: DataFrame, max_nodes: int | None = None, max_depth: int | None = None) -> DataFrame:
    """Kept and suppressed nodes per plan, counted inside the row.

    Only cut roots count as suppressed: nodes that were left out below a kept
    parent. In preorder a node's parent is the last node one level up.
    """
    def step(acc: Column, n: Column) -> Column:
        parent_kept = F.coalesce(F.get(acc["above"], n["depth"] - 2), F.lit(True))
        above = F.concat(F.slice(acc["above"], 1, n["depth"] - 1), F.array(n["kept"]))
        return F.struct(above.alias("above"), (acc["cut"] + F.when(~n["kept"] & parent_kept, 1).otherwise(0)).alias("cut"))

    start = F.struct(F.array().cast("array<boolean>").alias("above"), F.lit(0).alias("cut"))
    tree = once(_ordered(plans, max_nodes, max_depth), _cut=F.aggregate("_order", start, step)["cut"].cast("long"))
    return tree.select(
        *_kept_columns(plans), F.size(F.filter("_order", lambda n: n["kept"])).cast("long").alias("nodes"), F.col("_cut").alias("nodes_suppressed"),
        (F.col("_cut") > 0).alias("truncated"), F.when(~F.get("_order", F.lit(0))["kept"], "plan root suppressed by bounds").alias("error"))


_NUMBER = r"(?<![\p{L}\p{N}_$.])[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"


def redact_literals(expression: Column, max_chars: int | None = None) -> Column:
    """Strings and numbers replaced by typed placeholders; fails closed. With ``max_chars`` the text is cut to that length.

    Running it twice changes nothing: placeholders hold no literal.
    """
    def redacted(raw: Column) -> Column:
        comment = F.contains(raw, F.lit("--")) | F.contains(raw, F.lit("/*"))
        odd = comment | F.contains(raw, F.lit("$")) | F.contains(raw, F.lit("`")) | F.contains(raw, F.lit("?"))
        # without quotes, brackets and comments there is nothing to leave open
        quick = ~odd & ~raw.rlike(r"['\"()]")
        fine = F.when(quick, F.lit(True)).otherwise(let(F.when(odd, lexing.masked(raw)).otherwise(lexing.spaced(raw)), sound))
        return F.when(fine, let(lexing.plain_bodies(raw), lambda plain: let(
            # literals go first, so that digits inside of them are not looked at
            F.when(comment, F.regexp_replace(plain, lexing.KEPT, "$1")).otherwise(plain), lambda bare: placed(raw, bare)))
        ).otherwise(F.lit(refdata.UNPARSED))

    def sound(mask: Column) -> Column:
        top = let(lexing.outline(mask), lexing.full_outline)
        return ~mask.rlike(r" ['\"`] ") & ~F.coalesce(mask.rlike(r"[()]") & top.rlike(r"[()]"), F.lit(False))

    def placed(raw: Column, bare: Column) -> Column:
        text = F.when(F.contains(bare, F.lit("'")), F.regexp_replace(bare, r"'(?:[^']++|'')*+'", '"<string>"')).otherwise(bare)
        numbered = let(text, lambda t: F.when(t.rlike("[0-9\u0001]"), F.replace(F.replace(
            F.regexp_replace(t, r'("[^"]*")|' + _NUMBER, "$1\u0001"), F.lit('"\u0001'), F.lit('"')), F.lit("\u0001"), F.lit('"<number>"'))).otherwise(t))
        whole = F.when(bare == raw, numbered).otherwise(F.rtrim(numbered))  # a comment at the end leaves blanks
        return whole if max_chars is None else F.substring(whole, 1, max_chars)

    return let(expression, redacted)


def plan_conditions(nodes: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Condition rows of kept nodes; list values stay repeated rows."""
    def values(field: str) -> Column:
        raw = F.try_variant_get("node", f"$['{field}']", "variant")
        kind = F.schema_of_variant(raw)
        one = F.when(kind == "STRING", F.array(F.try_variant_get("node", f"$['{field}']", "string")))
        return F.when(kind.startswith("ARRAY<"), F.try_variant_get("node", f"$['{field}']", "array<string>")).otherwise(one)

    none = F.array().cast("array<struct<kind:string,expression:string>>")

    def labelled(field: str, kind: str) -> Column:
        pairs = F.transform(values(field), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("expression")))
        return F.coalesce(pairs, none)

    found = F.concat(*[labelled(field, kind) for field, kind in refdata.PLAN_CONDITIONS])
    keep = [c for c in ("query_id", "preorder") if c in nodes.columns]
    kept = once(nodes.filter("kept"), _c=found)
    return kept.select(*keep, F.posexplode("_c").alias("ordinal", "c")).select(
        *keep, "ordinal", "c.kind", redact_literals(F.col("c.expression"), max_chars).alias("expression"))


def plan_settings(plans: DataFrame) -> DataFrame:
    """Allow-listed planner settings, values as text."""
    raw = F.try_variant_get("doc", "$.Settings", "map<string,string>")
    kept = F.map_filter(raw, lambda k, v: k.isin(*refdata.ALLOWED_SETTINGS))
    return plans.withColumn("settings", F.coalesce(kept, F.create_map().cast("map<string,string>")))


def planning_time(doc: Column) -> Column:
    return _number(F.try_variant_get(doc, "$['Planning Time']", "variant"), "double")


_NODE_FIELDS = ("preorder", "path", "depth", "op", "relation", "index", "startup_cost", "total_cost", "n_rows", "width")


def plan_summary(plans: DataFrame, max_nodes: int | None = None, max_depth: int | None = None, listed: bool = False) -> DataFrame:
    """Root, node count, scans and joins in preorder per plan, read inside the row; and whether a bound cut nodes.

    ``listed`` adds ``nodes``: the kept nodes in preorder.
    """
    tree = once(plan_tree(plans, max_nodes, max_depth), _kept=F.filter("_nodes", lambda n: n["kept"]))
    root = F.get("_kept", F.lit(0))

    def ops(test) -> Column:
        return F.transform(F.filter("_kept", lambda n: test(n["op"])), lambda n: n["op"])

    return tree.filter(F.size("_kept") > 0).select(
        *_kept_columns(plans), root["op"].alias("root_op"), root["relation"].alias("root_relation"), root["total_cost"].alias("root_total_cost"),
        root["n_rows"].alias("root_rows"), F.size("_kept").cast("long").alias("node_count"),
        ops(lambda op: F.contains(op, F.lit("Scan"))).alias("scan_ops"),
        ops(lambda op: F.contains(op, F.lit("Join")) | (op == "Nested Loop")).alias("join_ops"),
        (F.size("_kept") < F.size("_nodes")).alias("truncated"),
        *([F.transform("_kept", lambda n: F.struct(*[n[f].alias(f) for f in _NODE_FIELDS])).alias("nodes")] if listed else []))


def plan_delta(pairs: DataFrame) -> DataFrame:
    """Cost and cardinality differences; absent operands give null."""
    o, c = F.col("original_cost"), F.col("candidate_cost")
    orows, crows = F.col("original_rows"), F.col("candidate_rows")
    changed = (orows > 0) & (crows > 0) & (F.abs(crows - orows) / F.nullif(orows, F.lit(0)) > 0.10)
    return (
        pairs.withColumn("cost_delta", c - o)
        .withColumn("cost_delta_pct", F.when(o > 0, (c - o) / F.nullif(o, F.lit(0.0)) * 100.0))
        .withColumn("rows_delta", crows - orows)
        .withColumn("cardinality_changed", F.coalesce(changed, F.lit(False)))
    )


def eligible_candidates(candidates: DataFrame, cap: int | None = None) -> DataFrame:
    """Validated, not withheld, explainable candidates; the first ``cap`` per query in order."""
    cap = options()["max_explain_candidates"] if cap is None else cap
    fit = candidates.filter((F.col("validation_status") == "validated") & (F.col("security_status") != "withheld"))
    admitted = with_rejection(fit).filter(F.col("rejection").isNull()).select(*candidates.columns)
    return ranked(admitted, ["query_id"], [F.col("candidate_id")], cap, "position")


def attach_plan_evidence(candidates: DataFrame, originals: DataFrame, cap: int | None = None) -> DataFrame:
    """Candidates with the delta of their own plan, joined by candidate id, never re-ranked; ``cap`` bounds the explained ones per query."""
    eligible = eligible_candidates(candidates, cap).select("query_id", "candidate_id", F.lit(True).alias("_eligible"))
    pairs = candidates.join(eligible, ["query_id", "candidate_id"], "left").join(
        originals.select("query_id", "original_cost", "original_rows"), "query_id", "left")
    planned = F.col("_eligible") & F.col("failure").isNull() & F.col("original_cost").isNotNull()
    delta = plan_delta(pairs)
    note = F.when(planned & F.col("cardinality_changed"), F.array(F.lit(refdata.CARDINALITY_NOTE))).otherwise(
        F.array().cast("array<string>"))
    return delta.select(
        "query_id", "candidate_id", F.coalesce("_eligible", F.lit(False)).alias("eligible"),
        F.when(planned, "runtime").otherwise("schema").alias("evidence"),
        F.when(planned, F.col("cost_delta")).alias("cost_delta"),
        F.when(F.col("_eligible") & F.col("original_cost").isNotNull(), F.col("failure")).alias("runtime_failure"), note.alias("preconditions"))


def evidence_status(attached: DataFrame, originals: DataFrame) -> DataFrame:
    """Per query how much of the evidence there is; counted map-side."""
    per = attached.groupBy("query_id").agg(
        F.count_if("eligible").alias("eligible"), F.count_if(F.col("evidence") == "runtime").alias("verified"))
    status = (
        F.when(~F.col("admitted"), "unavailable").when(F.col("original_cost").isNull(), "failed")
        .when(F.coalesce("verified", F.lit(0)) == F.coalesce("eligible", F.lit(0)), "available").otherwise("partial")
    )
    return originals.join(per, "query_id", "left").select(
        "query_id", F.coalesce("eligible", F.lit(0).cast("long")).alias("eligible"),
        F.coalesce("verified", F.lit(0).cast("long")).alias("verified"), status.alias("status"))


def plan_regressions(pairs: DataFrame, nodes: DataFrame, k: int = 20) -> tuple[DataFrame, DataFrame]:
    """Worst relative cost increases, and the share of sequential scans per relation."""
    worst = plan_delta(pairs).filter(F.col("cost_delta_pct").isNotNull()).orderBy(
        F.desc("cost_delta_pct"), "query_id").limit(k)
    shares = nodes.filter(F.col("kept") & F.contains("op", F.lit("Scan"))).groupBy("relation").agg(
        F.count(F.lit(1)).alias("scans"), F.count_if(F.col("op") == "Seq Scan").alias("seq_scans"))
    return worst, shares.withColumn("seq_share", F.round(F.col("seq_scans") / F.col("scans"), 6))


LIMITATIONS = (
    "Planner estimates, not measured execution.",
    "Costs are planner units and only comparable between plans of one query.",
)


def plan_report(plans: DataFrame, max_nodes: int | None = None) -> DataFrame:
    """Summary and nodes per captured plan; a plan that cannot be read is a row with its error."""
    read = plan_ingest(plans).withColumn("fingerprint", F.sha2("plan_json", 256))
    good = plan_settings(read.filter(F.col("error").isNull()).withColumn("planning_time_ms", planning_time(F.col("doc"))))
    fine = plan_summary(good, max_nodes, listed=True).withColumn("error", F.lit(None).cast("string")).withColumn(
        "limitations", F.array(*[F.lit(t) for t in LIMITATIONS]))
    bad = read.filter(F.col("error").isNotNull()).select("query_id", "error", "fingerprint")
    return fine.unionByName(bad, allowMissingColumns=True)
