"""Small building blocks shared by the operators."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType


def rule_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A fixed rule table. Its size is the length of a constant in this package."""
    return F.broadcast(spark.createDataFrame(list(rows), schema))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns whose expressions are evaluated exactly once per row.

    A plain projection may be merged into the filters and projections above it
    and then repeats its expressions there. The one-element generator is a
    barrier for that; use it for expensive array expressions that several
    later columns read.
    """
    fields = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select("*", F.explode(F.array(fields)).alias("_once")).select("*", "_once.*").drop("_once")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value evaluated once, however often the body reads it; for functions of columns that have no frame for ``once``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def spread(df: DataFrame) -> DataFrame:
    """Deals rows out evenly, for steps that cost far more per row than reading it.

    A table is read by no more tasks than its files have row groups; what
    follows runs in as many tasks as shuffles have partitions.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def spread_by(df: DataFrame, *keys: str) -> DataFrame:
    """Hash partitions ``df`` by ``keys`` into the configured number of shuffle partitions.

    With an explicit number the partitions are not merged by the size of the
    (still compact) rows: what follows multiplies them, by tokens or pieces.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def shared(df: DataFrame, by: Sequence[str], n: int | None = None) -> DataFrame:
    """Hash partitions ``df`` by ``by`` in one exchange for all that read the result.

    What a reader leaves out would else be taken out below the exchange, which
    would make it another one for each reader. The barrier above it lets neither columns nor filters through.
    """
    rows = (df.repartition(n, *by) if n else df.repartition(*by)).withColumn("_part", F.spark_partition_id())
    return rows.select(*by, F.inline(F.array(F.struct(*[c for c in rows.columns if c not in by])))).drop("_part")


#: Bytes of text whose tokens one task sorts; sorted tokens take up to 200 times as much memory as their text.
TASK_TEXT = 1_000_000


def text_partitions(texts: DataFrame, text: str) -> int:
    """Partitions for steps that sort the tokens of ``text``: as many as shuffles have, or more where a task would get too much text."""
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = texts.agg(F.sum(F.octet_length(text)).alias("size")).first()["size"]
    return max(n, -(-(size or 0) // TASK_TEXT))


def shared_base(spark: SparkSession) -> str:
    """The folder all executors share, ``spark.checkpoint.dir``.

    Only a session whose tasks run in the driver's process gets a temporary
    folder when none is set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="querygrove-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder that all executors share."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_base(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once, compressed, below the folder that all executors share."""
    folder = f"{shared_base(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], cap: int,
           rank_col: str = "rank") -> DataFrame:
    """First ``cap`` rows per key.

    The filter on ``row_number`` is planned as a window group limit: every
    task keeps at most ``cap`` rows per key before the shuffle, so a hot key
    sends ``cap`` rows per task and not the whole group.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(window)).filter(F.col(rank_col) <= cap)


def suppressed(df: DataFrame, keys: Sequence[str], cap: int) -> DataFrame:
    """Rows per key beyond ``cap``, by a map-side combined count."""
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("total"))
        .withColumn("suppressed_count", F.greatest(F.col("total") - cap, F.lit(0).cast("long")))
        .withColumn("truncated", F.col("total") > cap)
    )


def accounted(df: DataFrame, keys: Sequence[str], order: Sequence[Column], cap: int | None = None, rank_col: str = "rank") -> DataFrame:
    """First ``cap`` rows per key (None: all) with ``suppressed_count`` and ``truncated`` of the key."""
    if cap is None:
        rows = segmented(df, keys, order, {rank_col: ("sum", F.lit(1))})
        rows = rows.withColumn(rank_col, F.col(rank_col).cast("int"))
        return rows.withColumn("suppressed_count", F.lit(0).cast("long")).withColumn("truncated", F.lit(False))
    counts = suppressed(df, keys, cap).drop("total")
    return ranked(df, keys, order, cap, rank_col).join(counts, list(keys))


def prefix_sums(df: DataFrame, order_cols: Sequence[str], sums: dict[str, str]) -> DataFrame:
    """Running totals over the whole frame in the order of ``order_cols``.

    ``sums`` maps a value column to the name of its running total. Rows are
    range partitioned by the order columns, whose last one must make the order
    unique. Each partition is summed on its own, the (few) partition totals are
    accumulated, and each row adds its partition's offset to its running total
    inside the partition. No window ever sees the whole frame.
    """
    ranged = df.repartitionByRange(*[F.col(c) for c in order_cols]).withColumn(
        "_part", F.spark_partition_id()
    )
    # The range bounds come from a sample, so both passes must read one
    # materialisation to agree on the partition of each row.
    ranged = cut_lineage(ranged)
    totals = ranged.groupBy("_part").agg(*[F.sum(v).alias(f"_t_{v}") for v in sums])
    # One row per partition of the range shuffle: small by construction.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_part", *[F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0)).alias(f"_o_{v}") for v in sums]
    )
    inside = (
        Window.partitionBy("_part")
        .orderBy(*[F.col(c) for c in order_cols])
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return ranged.join(F.broadcast(offsets), "_part").select(
        *df.columns, *[(F.sum(v).over(inside) + F.col(f"_o_{v}")).alias(out) for v, out in sums.items()]
    )


def segmented(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], running: dict[str, tuple[str, Column]],
              partitions: int | None = None) -> DataFrame:
    """Values along each key in the order of ``order``; a key with most of the rows spreads over all tasks.

    ``running`` maps an output column to (kind, value):

    * "sum", "max": over the rows of the key up to and with the row itself;
    * "max_before": over the rows before it. The last value so far is the maximum of a struct that begins with the order;
    * "next": the value of the row after it, which has to grow with the order;
    * "total": the sum over all rows of the key.

    Rows are range partitioned by key and order, so a large key fills several
    ranges. Each range is scanned per key. Only the first and the last key of a
    range can reach over its borders, so what is carried between ranges is at
    most two rows a range: their totals, scanned in turn and broadcast. No
    window holds more of a key than one range. The order has to be unique
    inside a key for "sum" to be well defined.
    """
    names = {out: f"_v_{i}" for i, out in enumerate(running)}
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    valued = df.select("*", *[value.alias(names[out]) for out, (_, value) in running.items()])
    by = [*[F.col(k) for k in keys], *order]
    ranged = valued.repartitionByRange(partitions, *by) if partitions else valued.repartitionByRange(*by)
    # The range borders come from a sample: all steps must read one materialisation.
    ranged = cut_lineage(ranged.withColumn("_part", F.spark_partition_id()))
    key = F.struct(*keys)
    ends = ranged.groupBy("_part").agg(F.min(key).alias("_low"), F.max(key).alias("_high"))
    border = ranged.join(F.broadcast(ends), "_part").filter(key.eqNullSafe(F.col("_low")) | key.eqNullSafe(F.col("_high")))
    total = {"sum": F.sum, "total": F.sum, "max": F.max, "max_before": F.max, "next": F.min}
    border = border.groupBy("_part", *keys).agg(*[total[kind](names[out]).alias(names[out]) for out, (kind, _) in running.items()])
    parts = Window.partitionBy(*keys).orderBy("_part")
    earlier, later = parts.rowsBetween(Window.unboundedPreceding, -1), parts.rowsBetween(1, Window.unboundedFollowing)

    def carry(out: str, kind: str) -> Column:
        value = F.col(names[out])
        if kind == "total":
            return F.sum(value).over(Window.partitionBy(*keys)) - value
        return F.min(value).over(later) if kind == "next" else total[kind](value).over(earlier)

    carried = border.select(F.col("_part").alias("_at"), *[F.col(k).alias(f"_k_{i}") for i, k in enumerate(keys)],
                            *[carry(out, kind).alias(f"_c{names[out]}") for out, (kind, _) in running.items()])
    inside = Window.partitionBy("_part", *keys).orderBy(*order)

    def scanned(out: str, kind: str) -> Column:
        value = F.col(names[out])
        if kind == "next":
            return F.lead(value).over(inside)
        if kind == "total":
            return F.sum(value).over(Window.partitionBy("_part", *keys))
        return total[kind](value).over(inside.rowsBetween(Window.unboundedPreceding, -1 if kind == "max_before" else Window.currentRow))

    same = F.col("_part") == F.col("_at")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{i}"))
    local = ranged.select("*", *[scanned(out, kind).alias(f"_r{names[out]}") for out, (kind, _) in running.items()])

    def value(out: str, kind: str) -> Column:
        own, carry = F.col(f"_r{names[out]}"), F.col(f"_c{names[out]}")
        if kind in ("sum", "total"):
            return F.coalesce(own, F.lit(0)) + F.coalesce(carry, F.lit(0))
        return F.coalesce(own, carry) if kind == "next" else F.greatest(own, carry)

    rows = local.join(F.broadcast(carried), same, "left")
    return rows.select(*df.columns, *[value(out, kind).alias(out) for out, (kind, _) in running.items()])


#: Rows that one ordered window may hold.
WINDOW_ROWS = 100_000
#: Borders that cut an order into buckets.
BORDERS = 63


def _bucket(df: DataFrame, order: Sequence[str], borders: Sequence[Sequence]) -> Column:
    """How many of ``borders`` are at or below the order key; the borders are one constant, whatever their number."""
    kind = StructType([StructField(c, df.schema[c].dataType) for c in order])
    table = F.from_json(F.lit(json.dumps([dict(zip(order, b, strict=True)) for b in borders])), ArrayType(kind))
    return F.size(F.filter(table, lambda b: b <= F.struct(*order)))


def key_literal(df: DataFrame, order: Sequence[str], row: Sequence) -> Column:
    """A constant that compares with ``F.struct(*order)`` of ``df``."""
    return F.struct(*[F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in zip(order, row, strict=True)])


@dataclass
class Stretch:
    """Where in an order the first row over a limit lies: its rows, those before it, and the sums before it."""

    low: Sequence | None
    high: Sequence | None
    rows: int
    ahead: int
    before: dict[str, float]

    def holds(self, df: DataFrame, order: Sequence[str]) -> Column:
        low = F.lit(True) if self.low is None else F.struct(*order) >= key_literal(df, order, self.low)
        return low & self.reached(df, order)

    def reached(self, df: DataFrame, order: Sequence[str]) -> Column:
        """Rows of the stretch and before it."""
        return F.lit(True) if self.high is None else F.struct(*order) < key_literal(df, order, self.high)


def stretch_over(df: DataFrame, order: Sequence[str], sums: dict[str, str], bounds: Callable[[dict[str, float], Row], tuple[bool, bool]],
                 extremes: dict[str, Column] | None = None) -> Stretch | None:
    """The stretch of the order in which a limit is first passed; None where it never is.

    A selection by weight without a sort: a few dozen keys cut the order into
    buckets, one aggregation gives the sums of ``sums`` (value column by name) and the
    ``extremes`` of each bucket, and only the buckets that may hold the first such row are
    looked at again, until they have few enough rows for one ordered window. ``bounds`` tells of
    a bucket, from the sums before it and its own row of aggregates, whether a row in it
    may pass the limit and whether one surely does. Only order keys and numbers are read, and nothing is shuffled but sums.
    """
    found = Stretch(None, None, 0, 0, dict.fromkeys(sums, 0))
    while True:
        rows = df.filter(found.holds(df, order))
        keys = rows.select(*order).orderBy(F.xxhash64(*order), *order).limit(BORDERS).orderBy(*order).collect()
        borders = list(dict.fromkeys(tuple(r) for r in keys))
        total = rows.withColumn("_bucket", _bucket(df, order, borders)).groupBy("_bucket").agg(
            F.count(F.lit(1)).alias("_n"), *[F.coalesce(F.sum(v), F.lit(0)).alias(name) for name, v in sums.items()],
            *[c.alias(name) for name, c in (extremes or {}).items()])
        buckets = sorted(total.collect(), key=lambda r: r["_bucket"])
        reached, ahead, region, start = dict(found.before), found.ahead, [], None
        for bucket in buckets:
            may, must = bounds(reached, bucket)
            if may and start is None:
                start = dict(reached)
            if start is not None:
                region.append(bucket)
            else:
                ahead += bucket["_n"]
            if must:
                break
            for name in sums:
                reached[name] += bucket[name]
        if start is None:
            return None
        first, last = region[0]["_bucket"], region[-1]["_bucket"]
        n = sum(b["_n"] for b in region)
        found = Stretch(borders[first - 1] if first else found.low, borders[last] if last < len(borders) else found.high, n, ahead, start)
        if n <= WINDOW_ROWS or len(region) == len(buckets):  # few rows, or keys that no border parts
            return found


def first_over(df: DataFrame, order: Sequence[str], sums: dict[str, str], exceeded: Callable[[dict[str, Column]], Column],
               bounds: Callable[[dict[str, float], Row], tuple[bool, bool]], extremes: dict[str, Column] | None = None) -> Row | None:
    """The order key of the first row at which ``exceeded`` holds; it reads the sums of the rows before a row. The rest as ``stretch_over``."""
    part = stretch_over(df, order, sums, bounds, extremes)
    if part is None:
        return None
    rows = df.filter(part.holds(df, order))
    if part.rows <= WINDOW_ROWS:
        ahead = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        exact = rows.select("*", *[(F.coalesce(F.sum(v).over(ahead), F.lit(0)) + F.lit(part.before[name])).alias(f"_before_{name}") for name, v in sums.items()])
    else:
        exact = prefix_sums(rows, order, {v: f"_upto_{name}" for name, v in sums.items()})
        exact = exact.select("*", *[(F.col(f"_upto_{name}") - F.col(v) + F.lit(part.before[name])).alias(f"_before_{name}") for name, v in sums.items()])
    hit = exact.filter(exceeded({name: F.col(f"_before_{name}") for name in sums}))
    return hit.agg(F.min(F.struct(*order)).alias("stop")).first()["stop"]


def prefix_sum(df: DataFrame, order_cols: Sequence[str], value: str, out: str = "running") -> DataFrame:
    return prefix_sums(df, order_cols, {value: out})


def joined(column: Column | str, sep: str = "|") -> Column:
    """An array as text, for results compared by value."""
    return F.array_join(F.col(column) if isinstance(column, str) else column, sep)
