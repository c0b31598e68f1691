"""Importance resampling towards a target distribution, drawn by a distributed radix sort.

1. Words of whole texts (A-Z lower-cased) and their runs of up to ``width`` words
   fall into ``buckets`` by the crc32 of their bytes. Bucket counts of all documents
   and of the target are added up per task and then by bucket; the only thing that
   reaches the driver are two arrays of ``buckets`` numbers, from which it makes one
   array of gains.
2. Every text is scored against that array in one map-only pass. Gumbel noise from
   a digest of seed and doc_id turns the highest scores into a weighted sample
   without replacement.
3. The order is made by a least-significant-digit radix sort: for each digit of the
   composite key (score down, then doc_id up) one stable counting sort. Rows lie in
   chunks of ``2**CHUNK_BITS`` positions. A pass counts (chunk, digit), adds up the
   counts in the order (digit, chunk) to global offsets, and a row's destination is
   its offset plus its place among the equal digits of its chunk. Chunks are cut by
   position, so that equal scores, however many, never meet in one task. Only keys
   and a row number travel, never texts. After the last digit the position is the rank.

Defined cases: a null or empty text has no features and weight 0; rows without
doc_id are counted and weighed, but have no score, are not among the N documents
and are never drawn; repeated rows are ranked next to each other; without documents
the result is empty, without target texts the target is uniform; other columns are
not read. Texts longer than a slice are cut between words; one word is held whole.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from querygrove.llm.kernel import LOWER, SLICE_BYTES, owner, slices, spans
from querygrove.llm.scratch import remove, text_batches, written

DIGIT_BITS = 11
CHUNK_BITS = 17
_SIGN = -(1 << 63)

#: Bytes of words, after lower-casing: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]``.
WORD_BYTE = np.ones(256, bool)
WORD_BYTE[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False
#: Longer words take the library's loop.
_SHORT = 32


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def crc32s(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of the spans [start, end): byte by byte for all short spans at once."""
    out = np.zeros(len(starts), np.uint32)
    lengths = ends - starts
    short = np.flatnonzero(lengths <= _SHORT)
    short = short[np.argsort(-lengths[short], kind="stable")]
    state, first, size = np.full(len(short), 0xFFFFFFFF, np.uint32), starts[short], lengths[short]
    for step in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -step, "left"))
        state[:n] = _CRC[(state[:n] ^ data[first[:n] + step]) & np.uint32(255)] ^ (state[:n] >> np.uint32(8))
    out[short] = ~state
    for i in np.flatnonzero(lengths > _SHORT):
        out[i] = zlib.crc32(data[starts[i]:ends[i]].tobytes())
    return out


def pieces(data: np.ndarray, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Byte ranges of one text, cut where no word goes on."""
    low = 0
    while len(data) - low > max_bytes:
        gap = np.flatnonzero(~WORD_BYTE[LOWER[data[low:low + max_bytes]]])
        high = low + int(gap[-1]) + 1 if len(gap) else low + max_bytes
        while not len(gap) and high < len(data):  # a word longer than a piece
            rest = np.flatnonzero(~WORD_BYTE[LOWER[data[high:high + max_bytes]]])
            if len(rest):
                high += int(rest[0]) + 1
                break
            high = min(high + max_bytes, len(data))
        yield low, high
        low = high
    yield low, len(data)


def features(data: np.ndarray, offsets: np.ndarray, buckets: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every feature of the texts of a slice."""
    data = LOWER[data]
    starts, ends = spans(WORD_BYTE[data], offsets)
    texts = owner(offsets, starts)
    owners, found = [texts], [crc32s(data, starts, ends)]
    for n in range(2, width + 1):
        joined, bounds, own = _runs(data, starts, ends, texts, n)
        owners.append(own)
        found.append(crc32s(joined, bounds[:-1], bounds[1:]))
    return np.concatenate(owners), (np.concatenate(found) % np.uint32(buckets)).astype(np.int64)


def _runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, texts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all runs of ``n`` words of one text, joined by a space, with their bounds and texts."""
    at = np.flatnonzero(texts[:max(len(texts) - n + 1, 0)] == texts[n - 1:])
    out, bounds = bytearray(), np.zeros(len(at) + 1, np.int64)
    for k, i in enumerate(at.tolist()):
        out += b" ".join(data[starts[j]:ends[j]].tobytes() for j in range(i, i + n))
        bounds[k + 1] = len(out)
    return np.frombuffer(bytes(out), np.uint8), bounds, texts[at]


def batch_features(column: pa.Array, buckets: int, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, text, bucket) of slices and, where the features are single words, of pieces of long texts."""
    for low, high, data, offsets in slices(column):
        if width == 1 and len(data) > SLICE_BYTES:
            for a, b in pieces(data):
                yield low, high, *features(data[a:b], np.array([0, b - a]), buckets, width)
        else:
            yield low, high, *features(data, offsets, buckets, width)


def _counted(buckets: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, _, found in batch_features(batch.column("text"), buckets, width):
                total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, buckets: int, width: int = 1) -> np.ndarray:
    """Features of all rows of ``texts`` (text) per bucket: at most ``buckets`` rows a task, and as many here."""
    text_batches(texts.sparkSession)
    rows = texts.select("text").mapInArrow(_counted(buckets, width), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    total = np.zeros(buckets, np.int64)
    for bucket, n in rows.collect():
        total[bucket] = n
    return total


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the smoothed target share over the smoothed source share of each bucket."""
    k, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    ratio = ((float(t) + 1) * (s_all + k) / ((float(s) + 1) * (t_all + k)) for s, t in zip(source.tolist(), target.tolist(), strict=True))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def noise(seed: int, doc_id: int) -> int:
    """Gumbel noise in thousandths, from a digest of seed and id."""
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _scored(gain: np.ndarray, width: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count, weight = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for low, high, text, found in batch_features(batch.column("text"), len(gain), width):
                n = high - low
                count[low:high] += np.bincount(text, minlength=n)
                # Sums of whole numbers below 2**53: exact in doubles.
                weight[low:high] += np.bincount(text, weights=gain[found], minlength=n).astype(np.int64)
            ids = batch.column("doc_id").to_pylist()
            score = [None if i is None else w + noise(seed, i) for i, w in zip(ids, weight.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(count), pa.array(weight), pa.array(score, pa.int64())],
                                             names=["doc_id", "n_features", "weight", "score"])

    return run


def scored(docs: DataFrame, gain: np.ndarray, width: int = 1, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, weight and score of every row of ``docs`` (doc_id, text)."""
    text_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_scored(gain, width, seed), "doc_id long, n_features long, weight long, score long")


def _ordered_bits(column: str, descending: bool, low: int, high: int) -> tuple[F.Column, int]:
    """A column whose low bits order like ``column``, and how many of them differ between rows."""
    if high - low < 1 << 63:
        return (F.lit(high) - F.col(column) if descending else F.col(column) - F.lit(low)), (high - low).bit_length()
    flipped = F.col(column).bitwiseXOR(F.lit(_SIGN))  # unsigned order, all 64 bits
    return (F.bitwise_not(flipped) if descending else flipped), 64


def radix_ranks(rows: DataFrame, seq: str, order: Sequence[tuple[str, bool]]) -> DataFrame:
    """(seq, position): the 0-based place of every row in the order of the long columns ``order`` = (column, descending).

    ``seq`` numbers the rows as ``monotonically_increasing_id`` does; it breaks ties.
    """
    limits = rows.agg(*[f(c) for c, _ in order for f in (F.min, F.max)]).first()
    if limits[0] is None:
        return rows.select(seq, F.col(seq).alias("position"))
    keys, digits = [], []
    for k, (column, descending) in enumerate(order):
        key, bits = _ordered_bits(column, descending, limits[2 * k], limits[2 * k + 1])
        keys.append(key.alias(f"k{k}"))
        digits.append([(f"k{k}", shift) for shift in range(0, bits, DIGIT_BITS)])
    state = written(rows.select(F.col(seq).alias("seq"), F.col(seq).alias("position"), *keys), "radix")
    for key, shift in [d for column in reversed(digits) for d in column]:
        passed = written(_pass(state, key, shift), "radix")
        remove(state)
        state = passed
    if not any(digits):  # all keys equal
        state = _pass(state, "k0", 0)
    return state.select(F.col("seq").alias(seq), "position")


def _pass(state: DataFrame, key: str, shift: int) -> DataFrame:
    """One stable counting sort by a digit of ``key``."""
    digit = F.shiftrightunsigned(key, shift).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1)).cast("int")
    rows = state.withColumn("chunk", F.shiftrightunsigned("position", CHUNK_BITS)).withColumn("digit", digit)
    counts = rows.groupBy("chunk", "digit").agg(F.count(F.lit(1)).alias("n"))
    # At most 2**DIGIT_BITS rows: the only window without a partition, and small enough to broadcast.
    totals = counts.groupBy("digit").agg(F.sum("n").alias("n"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("digit", F.coalesce(F.sum("n").over(before.orderBy("digit")), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("n").over(before.partitionBy("digit").orderBy("chunk")), F.lit(0))
    offsets = counts.withColumn("inside", inside).join(F.broadcast(bases), "digit").select("chunk", "digit", (F.col("base") + F.col("inside")).alias("offset"))
    place = F.row_number().over(Window.partitionBy("chunk", "digit").orderBy("position"))
    placed = rows.withColumn("place", place).join(offsets, ["chunk", "digit"])
    return placed.select("seq", (F.col("offset") + F.col("place") - 1).alias("position"), *[c for c in state.columns if c.startswith("k")])


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, buckets: int = 10_000, width: int = 1, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of ``docs``; the drawn ones have a rank.

    ``percent`` of the documents with ``min_words`` features or more are drawn.
    """
    gain = gains(bucket_counts(docs, buckets, width), bucket_counts(target, buckets, width))
    rows = written(scored(docs, gain, width, seed).withColumn("seq", F.monotonically_increasing_id()), "importance")
    able = rows.filter((F.col("n_features") >= min_words) & F.col("score").isNotNull())
    drawn = percent * able.count() // 100
    ranks = radix_ranks(able, "seq", [("score", True), ("doc_id", False)]).filter(F.col("position") < drawn)
    return rows.join(ranks, "seq", "left").select("doc_id", "n_features", "weight", "score", (F.col("position") + 1).alias("rank"))
