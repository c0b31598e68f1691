"""Near-duplicate groups by b-bit MinHash.

1. Every whole text becomes its set of distinct 5-word shingles (64-bit
   hashes), ``MINIMA`` minima of it, ``BANDS`` band keys of ``ROWS`` full minima
   each, and a packed signature of the low ``BITS`` bits of every minimum.
2. Texts with equal sets are one class. Classes that share a band key are
   candidates: the smallest class of a key stands for it, so that a key of n
   classes gives n edges, and connected candidates form a cluster.
3. Clusters are dealt to tasks in blocks of ``BLOCK_BYTES`` of text and ``BLOCK_TEXTS`` texts; a larger
   cluster is compared block against block. In a task, similarities are
   estimated from bit counts of packed signatures, corrected for chance
   collisions of low bits; pairs that may reach the threshold are confirmed on
   the full sets, most similar first, as long as they join two groups. A task
   returns a spanning forest of confirmed links, never all pairs.
4. Components over classes give the smallest document of each.

At the threshold of 0.75 a pair shares no band with probability
(1 - 0.75**3)**24 = 2e-6, and the estimate misses the margin (0.25, more than
five standard deviations) with probability 1e-7; a group joined by several
links survives either. No link, class or component passes through the driver.

Defined cases: texts that are null, empty or without words have no shingle and
are linked with nothing; rows without doc_id are counted, linked with nothing
and kept; repeated rows are one class and each gets the same answer; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from querygrove.llm.components import components
from querygrove.llm.kernel import byte_values, combine, mix, prefix_hashes, slices, span_hashes, words
from querygrove.llm.scratch import fresh, text_batches, written

SHINGLE = 5
BANDS, ROWS = 24, 3
BITS = 4
MINIMA = 96
MARGIN = 0.25
#: A block has at most about this many bytes of text and this many texts.
BLOCK_BYTES = 4 << 20
BLOCK_TEXTS = 8192
#: Pairs whose similarity is estimated together.
PAIRS = 1 << 18

_VALUES = byte_values(7, lower=True)
_RNG = np.random.default_rng(7)
_FACTORS = (_RNG.integers(0, 1 << 31, MINIMA, dtype=np.uint64).astype(np.uint32) << np.uint32(1)) | np.uint32(1)
_SHIFTS = _RNG.integers(0, 1 << 32, MINIMA, dtype=np.uint64).astype(np.uint32)
_PER_LONG = 64 // BITS


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts of a slice, and the ends of each text's part."""
    n = len(offsets) - 1
    starts, ends, text = words(data, offsets)
    hashes = span_hashes(prefix_hashes(data, _VALUES), starts, ends)
    windows = combine(hashes, SHINGLE)
    inside = text[:len(windows)] == text[SHINGLE - 1:] if len(windows) else np.zeros(0, bool)
    owners, values = text[:len(windows)][inside], windows[inside]
    count = np.bincount(text, minlength=n)
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    if len(short):
        first = np.concatenate(([0], np.cumsum(count)))
        whole = [mix(np.array([count[i]], np.uint64) + sum((hashes[first[i] + k:first[i] + k + 1] * np.uint64(2 * k + 11) for k in range(count[i])), np.zeros(1, np.uint64)))[0] for i in short]
        owners, values = np.concatenate((owners, short)), np.concatenate((values, np.array(whole, np.uint64)))
    order = np.lexsort((values, owners))
    owners, values = owners[order], values[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owners[1:] != owners[:-1])
    owners, values = owners[new], values[new]
    return values, np.searchsorted(owners, np.arange(n + 1))


def class_keys(values: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name a set, as two longs."""
    sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(values ^ np.uint64(salt)), dtype=np.uint64))) for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
    sizes = (ends[1:] - ends[:-1]).astype(np.uint64)
    return tuple(mix(s[ends[1:]] - s[ends[:-1]] + sizes).view(np.int64) for s in sums)


def minima(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """MINIMA minima of each set; sets are not empty."""
    x = (values >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(ends) - 1, MINIMA), np.uint32)
    for k in range(MINIMA):
        out[:, k] = np.minimum.reduceat(x * _FACTORS[k] + _SHIFTS[k], ends[:-1])
    return out


def band_keys(minimum: np.ndarray) -> np.ndarray:
    keys = np.empty((len(minimum), BANDS), np.uint64)
    for band in range(BANDS):
        total = np.full(len(minimum), band + 1, np.uint64)
        for row in range(ROWS):
            total = mix(total + minimum[:, band * ROWS + row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        keys[:, band] = total
    return keys.view(np.int64)


def packed(minimum: np.ndarray) -> np.ndarray:
    """The low bits of the minima, side by side in longs."""
    low = (minimum & np.uint32((1 << BITS) - 1)).astype(np.uint64)
    out = np.zeros((len(low), MINIMA // _PER_LONG), np.uint64)
    for k in range(MINIMA):
        out[:, k // _PER_LONG] |= low[:, k] << np.uint64(BITS * (k % _PER_LONG))
    return out


def estimated(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of every signature of ``a`` to every one of ``b``: equal fields by bit count, corrected for chance."""
    differ = a[:, None, :] ^ b[None, :, :]
    fold = differ.copy()
    for i in range(1, BITS):
        fold |= differ >> np.uint64(i)
    field = np.uint64(sum(1 << (BITS * i) for i in range(_PER_LONG)))
    equal = 1 - np.bitwise_count(fold & field).sum(2) / MINIMA
    chance = 2.0 ** -BITS
    return (equal - chance) / (1 - chance)


class _Forest:
    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def join(self, a: int, b: int) -> None:
        low, high = sorted((self.label[a], self.label[b]))
        self.label[self.label == high] = low


def confirmed_links(sets: list[np.ndarray], signatures: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between members of ``left`` and of ``right`` (index arrays, equal or disjoint).

    Rows of ``left`` are taken a few at a time, so that about ``PAIRS`` pairs are
    held whatever the sizes, and each is confirmed before the next are looked
    at: pairs of one group are not estimated again.
    """
    sizes, forest, links = np.array([len(s) for s in sets]), _Forest(len(sets)), []
    low = 0
    while low < len(left):
        rows, others = left[low:low + max(1, PAIRS // len(right))], right
        low += len(rows)
        groups = np.unique(forest.label[rows])
        if len(groups) == 1:
            others = others[forest.label[others] != groups[0]]
        if not len(others):
            continue
        close = estimated(signatures[rows], signatures[others])
        smaller, larger = np.minimum(sizes[rows][:, None], sizes[others][None, :]), np.maximum(sizes[rows][:, None], sizes[others][None, :])
        able = (close >= percent / 100 - MARGIN) & (100 * smaller >= percent * larger)
        if left is right:
            able &= rows[:, None] < others[None, :]
        able &= forest.label[rows][:, None] != forest.label[others][None, :]
        i, j = np.nonzero(able)
        order = np.argsort(-close[i, j], kind="stable")
        a, b = rows[i[order]], others[j[order]]
        for at in range(0, len(a), 1024):
            x, y = a[at:at + 1024], b[at:at + 1024]
            apart = forest.label[x] != forest.label[y]
            for i, j in zip(x[apart].tolist(), y[apart].tolist(), strict=True):
                if forest.label[i] == forest.label[j]:
                    continue
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    forest.join(i, j)
                    links.append((i, j))
    return links


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, data, offsets in slices(batch.column("text")):
            values, ends = shingle_sets(data, offsets)
            k1, k2 = class_keys(values, ends)
            n, sizes = high - low, ends[1:] - ends[:-1]
            full = np.flatnonzero(sizes)
            bands = np.zeros((0, BANDS), np.int64)
            if len(full):
                bands = band_keys(minima(values, np.append(ends[:-1][full], ends[-1])))
            rows = np.concatenate(([0], np.cumsum(np.where(sizes > 0, BANDS, 0)))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(rows), pa.array(bands.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(low, n), pa.array(sizes.astype(np.int64)), pa.array(k1), pa.array(k2),
                 pa.array((offsets[1:] - offsets[:-1]).astype(np.int64)), lists],
                names=["doc_id", "n_shingles", "k1", "k2", "n_bytes", "bands"])


def _links_of(percent: int):
    """Links of every (root, i, j) group of rows that come sorted by it."""

    def group_links(keys: list[tuple[int, int]], sides: list[int], sets: list[np.ndarray], own: bool) -> list[tuple[int, int, int, int]]:
        distinct: dict[tuple[int, int], int] = {}
        for at, key in enumerate(keys):
            distinct.setdefault(key, at)
        picked = list(distinct.values())
        if len(picked) < 2:
            return []
        members = [sets[i] for i in picked]
        ends = np.concatenate(([0], np.cumsum([len(m) for m in members])))
        signatures = packed(minima(np.concatenate(members), ends))
        side = np.array([sides[i] for i in picked])
        everything = np.arange(len(picked))
        left, right = (everything, everything) if own else (everything[side == 0], everything[side == 1])
        if not len(left) or not len(right):
            return []
        names = [keys[i] for i in picked]
        return [(*names[i], *names[j]) for i, j in confirmed_links(members, signatures, left, right, percent)]

    def emit(found: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True)) if found else [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a1", "a2", "b1", "b2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, keys, sides, sets = None, [], [], []
        found: list[tuple[int, int, int, int]] = []
        for batch in batches:
            meta = [batch.column(c).to_pylist() for c in ("root", "i", "j", "block", "k1", "k2")]
            for low, high, data, offsets in slices(batch.column("text")):
                values, ends = shingle_sets(data, offsets)
                real = class_keys(values, ends)
                for at in range(high - low):
                    root, i, j, block, k1, k2 = (m[low + at] for m in meta)
                    if (root, i, j) != group:
                        if group is not None:
                            found += group_links(keys, sides, sets, group[1] == group[2])
                        group, keys, sides, sets = (root, i, j), [], [], []
                    if (real[0][at], real[1][at]) == (k1, k2):  # an id may stand for several texts
                        keys.append((k1, k2))
                        sides.append(0 if block == i else 1)
                        sets.append(values[ends[at]:ends[at + 1]].copy())
            if len(found) > 10_000:
                yield emit(found)
                found = []
        if group is not None:
            found += group_links(keys, sides, sets, group[1] == group[2])
        yield emit(found)

    return run


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (doc_id, text)."""
    return _verdicts(docs, percent).drop("k1", "k2")


def _verdicts(docs: DataFrame, percent: int) -> DataFrame:
    """The columns of ``near_duplicates`` and the class of each row."""
    text_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    described = written(docs.mapInArrow(_describe, f"doc_id {kind}, n_shingles long, k1 long, k2 long, n_bytes long, bands array<long>"), "minhash-rows")
    able = described.filter("n_shingles > 0 and doc_id is not null")
    # Candidates: the classes of a band key, each tied to the smallest.
    banded = able.select("k1", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("k1").alias("low"), F.max("k1").alias("high")).filter("low <> high").drop("high")
    edges = banded.join(shared, "band").filter("k1 <> low").select(F.col("k1").alias("a"), F.col("low").alias("b")).distinct()
    clusters = components(edges)
    classes = able.groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"))
    members = written(classes.join(clusters.withColumnRenamed("node", "k1"), "k1").select("root", "k1", "k2", "doc_id", "n_bytes"), "minhash-members")
    blocks = members.groupBy("root").agg(F.greatest(F.ceil(F.sum("n_bytes") / BLOCK_BYTES), F.ceil(F.count(F.lit(1)) / BLOCK_TEXTS)).alias("blocks"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    dealt = members.join(blocks, "root").withColumn("block", F.pmod(F.xxhash64("k1", "k2"), F.greatest("blocks", F.lit(1))))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest("blocks", F.lit(1)) - 1)))
    dealt = dealt.select("doc_id", "root", "k1", "k2", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    texts = docs.filter("doc_id is not null and text is not null").join(dealt, "doc_id").select("root", "i", "j", "block", "k1", "k2", "text")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_texts = texts.repartition(n, "root", "i", "j").sortWithinPartitions("root", "i", "j")
    links = sorted_texts.mapInArrow(_links_of(percent), "a1 long, a2 long, b1 long, b2 long")

    def name(x: str, y: str) -> F.Column:
        return F.concat(F.lpad(F.hex(x), 16, "0"), F.lpad(F.hex(y), 16, "0"))

    links = written(links.select(name("a1", "a2").alias("a"), name("b1", "b2").alias("b")), "minhash-links")
    roots = components(links)
    named = classes.select(name("k1", "k2").alias("node"), "k1", "k2", "doc_id").join(roots, "node")
    lowest = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    linked = named.join(lowest, "root").select("k1", "k2", "component_id")
    answer = classes.select("k1", "k2", F.col("doc_id").alias("_first")).join(linked, ["k1", "k2"], "left")
    answer = answer.select("k1", "k2", F.coalesce("component_id", "_first").alias("_component"), F.lit(1).alias("_able"))
    rows = described.join(answer, ["k1", "k2"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("_component")).otherwise(F.col("doc_id"))
    rows = rows.select("doc_id", "n_shingles", component.alias("component_id"), "k1", "k2")
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [class_keys(*shingle_sets(data, offsets)) for _, _, data, offsets in slices(batch.column("text"))]
        k1, k2 = (np.concatenate([k[side] for k in keys]) if keys else np.zeros(0, np.int64) for side in (0, 1))
        yield pa.RecordBatch.from_arrays([batch.column("own"), pa.array(k1), pa.array(k2)], names=["own", "k1", "k2"])


def keep_first(docs: DataFrame, percent: int = 75) -> DataFrame:
    """``docs`` without the documents that another of their group stands for.

    Where an id stands for several texts, each of them is decided by itself;
    of rows with the same id and class (a repeated row), and of rows without an
    id and of one class, one stays.
    """
    rows = written(_verdicts(docs, percent).groupBy("doc_id", "k1", "k2").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")), "minhash-verdicts")
    gone, own = fresh(docs, "_gone"), "own"
    ids = rows.groupBy(F.col("doc_id").alias(gone)).agg(F.max("kept").alias("some"), F.sum("n").alias("n"))
    # Ids with one row are decided by their id; the others by id and class, in a second pass over their texts.
    several = written(ids.filter((F.col("n") > 1) & F.col("some") & F.col(gone).isNotNull()).select(gone), "minhash-several")
    others = ids.filter((F.col("n") > 1) | ~F.col("some")).select(gone)
    rest = docs.filter(docs["doc_id"].isNotNull()).join(others, docs["doc_id"] == F.col(gone), "left_anti")
    nameless = rows.filter("doc_id is null").isEmpty()
    if several.isEmpty() and nameless:
        return rest
    source = docs.select("text", F.struct(*docs.columns).alias(own))
    picked = source.filter("own.doc_id is null").unionByName(source.join(several, F.col("own.doc_id") == F.col(gone), "left_semi"))
    keyed = picked.mapInArrow(_keyed, StructType([picked.schema[own], StructField("k1", LongType()), StructField("k2", LongType())]))
    # ordered by a struct: where the text is null, a plain order would give no row at all
    one = keyed.groupBy("own.doc_id", "k1", "k2").agg(F.min_by("own", F.struct(F.col("own.text").isNull(), "own.text")).alias(own))
    kept = rows.filter("kept").select(F.col("doc_id").alias("_id"), F.col("k1").alias("_k1"), F.col("k2").alias("_k2"))
    stays = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2"))
    return rest.unionByName(one.join(kept, stays, "left_semi").select("own.*"))
