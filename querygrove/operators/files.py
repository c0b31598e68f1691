"""File corpora: listing, pruning, classification, budgets and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querygrove import refdata
from querygrove.options import options
from querygrove.prims import cut_lineage, first_over

SCAN_KEYWORD = r"(?iU)\b(?:" + "|".join(refdata.SCAN_KEYWORDS) + r")\b"
ORM_MARKER = "|".join(marker.replace(".", r"\.") for marker in refdata.ORM_MARKERS)
MIGRATION_NAME = "|".join(f"(?:{p})" for p in refdata.MIGRATION_NAMES)


def describe_paths(files: DataFrame) -> DataFrame:
    """Adds dir, name, ext and depth to rows with a relative ``path``."""
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    return (
        files.withColumn("dir", F.when(folder == "", ".").otherwise(folder))
        .withColumn("name", F.regexp_extract("path", "([^/]*)$", 1))
        .withColumn("ext", F.lower(F.regexp_extract("name", r"^.+(\.[^.]+)$", 1)))
        .withColumn("depth", F.size(F.split("dir", "/")) - 1)
    )


def prune_paths(files: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Drops whatever lies below a skipped or too deep folder. Needs paths only."""
    limit = options()["max_scan_depth"] if max_depth is None else max_depth
    skipped = F.array(*[F.lit(d) for d in refdata.SKIP_DIRS])
    return files.filter(~F.arrays_overlap(F.split("path", "/"), skipped) & (F.col("depth") < limit))


def is_sql(name: Column | None = None) -> Column:
    return (F.col("name") if name is None else name).endswith(".sql")


def _raw() -> Column:
    return F.col("content").cast("binary")


def _text() -> Column:
    return F.col("content").cast("string")


def _binary() -> Column:
    return F.contains(F.substring(_raw(), 1, refdata.BINARY_CHECK_BYTES), F.lit(b"\x00"))


def unreadable(max_size: int | None = None, by_extension: bool = True) -> Column:
    """Why a file's content is not looked at; null when it is (or need not be) read."""
    limit = options()["max_file_size"] if max_size is None else max_size
    named = is_sql()
    unread = named
    if by_extension:
        unread = named | F.col("ext").isin(*refdata.CONFIG_EXTS, *refdata.DOC_EXTS)
    return (
        F.when(~named & (F.col("size") > limit), "oversize")
        .when(unread, F.lit(None).cast("string"))
        .when(_binary(), "binary")
        .when(~F.is_valid_utf8(_text()), "not_utf8")
    )


def skip_unreadable(files: DataFrame, max_size: int | None = None) -> DataFrame:
    """Adds ``skip_reason`` instead of dropping rows silently."""
    return files.withColumn("skip_reason", unreadable(max_size))


def has_orm_marker() -> Column:
    return _text().rlike(ORM_MARKER)


def has_sql_keyword() -> Column:
    return _text().rlike(SCAN_KEYWORD)


def classification() -> Column:
    """Class of a readable file; null when it has nothing to do with SQL."""
    return (
        F.when(is_sql() & F.col("name").rlike(f"(?i){MIGRATION_NAME}"), "migration")
        .when(is_sql(), "query")
        .when(F.col("ext").isin(*refdata.CONFIG_EXTS),
              F.when(~F.contains(F.lower("name"), F.lit("lock")), "config"))
        .when(F.col("ext").isin(*refdata.DOC_EXTS), "doc")
        .when(F.col("ext").isin(*refdata.ORM_EXTS) & has_orm_marker(), "orm")
        .when(has_sql_keyword(), "unknown")
    )


def classify_files(files: DataFrame, max_size: int | None = None) -> DataFrame:
    """Adds ``skip_reason`` and ``classification``; irrelevant files get a reason too."""
    seen = skip_unreadable(files, max_size).withColumn(
        "classification", F.when(F.col("skip_reason").isNull(), classification())
    )
    return seen.withColumn(
        "skip_reason",
        F.when(F.col("skip_reason").isNull() & F.col("classification").isNull(), "not_relevant")
        .otherwise(F.col("skip_reason")),
    )


def sql_bearing_files(files: DataFrame, max_size: int | None = None) -> DataFrame:
    """Every ``.sql`` file by name and every readable text file with a SQL keyword."""
    readable = unreadable(max_size, by_extension=False).isNull()
    return files.filter(is_sql() | (readable & has_sql_keyword()))


def admit_within_budget(classified: DataFrame, max_files: int | None = None,
                        max_bytes: int | None = None) -> DataFrame:
    """Classified files in path order up to the count or byte cap.

    ``truncated`` tells, on every row, whether the scan stopped early. Only
    classified non-``.sql`` files use up bytes; a readable file that would not
    fit stops the scan even when it is not relevant.
    """
    bounds = options()
    max_files = bounds["max_files_per_scan"] if max_files is None else max_files
    max_bytes = bounds["max_total_bytes"] if max_bytes is None else max_bytes
    hit = F.col("classification").isNotNull()
    counted = (
        classified.filter(F.coalesce(F.col("skip_reason"), F.lit("")) != "oversize")
        .select("path", "dir", "name", "size", "classification")
        .withColumn("_hit", hit.cast("long"))
        .withColumn("_bytes", F.when(hit & ~is_sql(), F.col("size")).otherwise(F.lit(0)).cast("long"))
    )
    # Names and sizes are written once: what they were derived from, the contents, is not read again.
    counted, room = cut_lineage(counted), F.lit(max_bytes)

    def exceeded(before: dict[str, Column]) -> Column:
        return (before["seen"] >= max_files) | (~is_sql() & (before["used"] + F.col("size") > room))

    def bounds(before: dict[str, float], bucket) -> tuple[bool, bool]:
        largest = bucket["largest"] or 0
        may = before["seen"] + bucket["seen"] >= max_files or (bucket["largest"] is not None and before["used"] + bucket["used"] + largest > max_bytes)
        must = before["seen"] >= max_files or (bucket["largest"] is not None and before["used"] + largest > max_bytes)
        return may, must

    stop = first_over(counted.drop("dir", "classification"), ["path"], {"seen": "_hit", "used": "_bytes"}, exceeded, bounds,
                      {"largest": F.max(F.when(~is_sql(), F.col("size")))})
    admitted = counted.filter(hit) if stop is None else counted.filter(hit & (F.col("path") < stop["path"]))
    return admitted.select("path", "dir", "name", "size", "classification", F.lit(stop is not None).alias("truncated"))


def context_map(classified: DataFrame) -> DataFrame:
    """Folder by folder, sorted names with their class.

    Long form in one global order: a folder with a large share of all files
    is split over many tasks and is never gathered into one list.
    """
    return (
        classified.filter(F.col("classification").isNotNull())
        .select("dir", "name", "classification")
        .repartitionByRange("dir", "name")
        .sortWithinPartitions("dir", "name")
    )


def scan_summary(classified: DataFrame) -> DataFrame:
    """Counts per class and per skip reason, one row each, plus totals per outcome."""
    outcome = F.when(F.col("classification").isNotNull(), "seen").otherwise("skipped")
    label = F.coalesce("classification", "skip_reason")
    return (
        classified.select(outcome.alias("outcome"), label.alias("label"), "size")
        .rollup("outcome", "label")
        .agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
        .select(F.coalesce("outcome", F.lit("all")).alias("outcome"),
                F.coalesce("label", F.lit("all")).alias("label"), "files", "bytes")
    )


def file_manifest(files: DataFrame, max_size: int | None = None) -> DataFrame:
    """Freshness manifest: ``.sql`` files and texts (with ``max_size``: up to it) with a keyword or marker."""
    readable = unreadable(max_size, by_extension=False).isNull()
    return files.filter(is_sql() | (readable & (has_sql_keyword() | has_orm_marker()))).select(
        "path", "mtime_ns", "size"
    )


def manifest_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """added / removed / changed / same for every path of two manifests."""
    old = before.select("path", F.col("mtime_ns").alias("old_mtime"), F.col("size").alias("old_size"),
                        F.lit(True).alias("in_old"))
    new = after.select("path", F.col("mtime_ns").alias("new_mtime"), F.col("size").alias("new_size"),
                       F.lit(True).alias("in_new"))
    same = F.col("old_mtime").eqNullSafe(F.col("new_mtime")) & F.col("old_size").eqNullSafe(F.col("new_size"))
    status = (
        F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed")
        .when(same, "same").otherwise("changed")
    )
    return old.join(new, "path", "full_outer").select("path", status.alias("status"))


def manifests_match(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: whether both manifests agree on every path, time and size."""
    return manifest_diff(before, after).agg(
        F.coalesce(F.every(F.col("status") == "same"), F.lit(True)).alias("fresh")
    )


def migration_sources(files: DataFrame, repo: str = "repo", **limits: int) -> DataFrame:
    """Per repository its one migration root, or why there is none.

    ``limits`` are ``max_schema_files``, ``max_schema_file_bytes`` and ``max_schema_total_bytes``; without one nothing is refused for its size.
    """
    bounds = options(**limits)
    found = files.filter(F.col("root").isin(*refdata.MIGRATION_ROOTS) & is_sql())
    per_root = found.groupBy(repo, "root").agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.max("size").alias("largest")
    )
    roots = per_root.groupBy(repo).agg(
        F.count(F.lit(1)).alias("n_roots"), F.min("root").alias("root"), F.sum("files").alias("files"),
        F.sum("bytes").alias("bytes"), F.max("largest").alias("largest"),
    )
    reason = (
        F.when(F.col("n_roots") > 1, "ambiguous_migration_roots")
        .when(F.col("files") > bounds["max_schema_files"], "too_many_migration_files")
        .when(F.col("largest") > bounds["max_schema_file_bytes"], "migration_file_too_large")
        .when(F.col("bytes") > bounds["max_schema_total_bytes"], "migration_set_too_large")
    )
    return roots.select(repo, "root", "files", "bytes", reason.alias("unavailable_reason"))


def size_guard(df: DataFrame, text: str, max_bytes: int, allow_empty: bool = False) -> DataFrame:
    """Adds the quarantine columns; ``kind`` is null on accepted rows."""
    value = F.coalesce(F.col(text), F.lit(""))
    kind = F.when(F.octet_length(value) > max_bytes, "input_too_large")
    if not allow_empty:
        kind = kind.when(~value.rlike(r"\S"), "no_input")
    steps = F.when(F.col("kind") == "input_too_large", F.array(F.lit("Reduce the input size."))).when(
        F.col("kind") == "no_input", F.array(F.lit("Provide the input text.")))
    return (
        df.withColumn("kind", kind)
        .withColumn("recoverable", F.col("kind").isNotNull())
        .withColumn("next_steps", steps)
    )
