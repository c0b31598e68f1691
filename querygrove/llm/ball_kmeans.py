"""Vector code compression: product codes from Ball k-means.

Vectors become whole numbers (``floor(scale x)``) and are cut into ``parts`` equal
pieces, each with a codebook of ``entries``. All sums and distances are exact, so
the result does not depend on how rows are dealt to tasks.

A round is one map-only pass that keeps each row's codes, and one aggregation of
the rows whose codes changed, ``parts * entries * (width + 1)`` sums at most. The first pass
compares every piece with every entry. Later ones work on balls, the members of
an entry within one block of rows:

* the ball's radius decides its neighbour entries: one whose centre is farther than
  twice the radius can take no member;
* a member nearer to its centre than half the distance to the nearest neighbour
  lies in the stable core and is not compared at all;
* the others lie in annular rings between half the distances to successive
  neighbours, and a member is compared only with the neighbours of its ring
  and of those inside it.

Balls of a block are no larger than those of the whole table, so the bounds hold and
no pass over the table is needed for radii. At equal bounds the neighbour is
compared, which keeps ties with the lower index.

Defined cases: rows whose vector is null, has null or non-finite components, is
empty, or has another length than that of the smallest vec_id (or one that ``parts``
does not divide) are dropped, as are components too large for squared distances of
64 bits; rows without vec_id are coded but start no entry; of equal vec_ids the least
vector starts one; with fewer vectors than ``entries`` there are as many entries; an empty
table gives an empty result; null labels are one group; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querygrove.llm.scratch import remove, written

#: Rows a task looks at together.
BLOCK_ROWS = 16_384
#: Shares of a label when its sum is joined back.
SALTS = 64


@dataclass
class Codebooks:
    """Entries of every part: whole numbers, (parts, entries, width)."""

    entries: np.ndarray

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry to each row, by comparing all; ties to the lower index."""
    best, code = None, np.zeros(len(x), np.uint8)
    for i, entry in enumerate(book):
        d = np.square(x - entry).sum(1)
        if best is None:
            best = d
            continue
        better = d < best
        code[better] = i
        best = np.where(better, d, best)
    return code, best


def ball_nearest(x: np.ndarray, old: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``nearest``, from the entries ``old`` that the rows belong to so far."""
    best = np.square(x - book[old]).sum(1)
    code = old.copy()
    between = np.square(book[:, None] - book[None]).sum(2)
    for j in range(len(book)):
        members = np.flatnonzero(old == j)
        if not len(members):
            continue
        reach = 4 * best[members]
        near = np.argsort(between[j], kind="stable")
        near = near[near != j]
        near = near[between[j][near] <= reach.max()]
        ring = np.searchsorted(between[j][near], reach, "right")  # 0: stable core
        for inner, i in enumerate(near):
            rows = members[ring > inner]
            d = np.square(x[rows] - book[i]).sum(1)
            better = (d < best[rows]) | ((d == best[rows]) & (i < code[rows]))
            code[rows[better]] = i
            best[rows[better]] = d[better]
    return code, best


def _cells(batch: pa.RecordBatch, size: int) -> np.ndarray:
    return batch.column("cells").flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.int64)


def _codes(column: pa.Array, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, parts)


def _blob(codes: np.ndarray) -> pa.Array:
    n, parts = codes.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1, dtype=np.int32) * parts).tobytes()), pa.py_buffer(np.ascontiguousarray(codes).tobytes())])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(len(b) for b in held) >= BLOCK_ROWS:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if sum(len(b) for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _assigned(books: Codebooks, first: bool, final: bool):
    """The rows with their new codes: in the first pass by all entries, then by balls; in the final one with their error."""
    entries = books.entries
    parts, _, width = entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            x = _cells(block, parts * width)
            old = None if first else _codes(block.column("code"), parts)
            new, error = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for p in range(parts):
                piece = x[:, p * width:(p + 1) * width]
                new[:, p], d = nearest(piece, entries[p]) if first else ball_nearest(piece, old[:, p], entries[p])
                error += d
            arrays = [block.column("vec_id"), block.column("label")]
            if final:
                arrays += [_blob(new), pa.array(error)]
                names = ["vec_id", "label", "code", "error"]
            else:
                arrays += [block.column("cells"), _blob(new), block.column("code")]
                names = ["vec_id", "label", "cells", "code", "before"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def _moved(parts: int, k: int, width: int):
    """What rows add to the sums and counts of their entries and take from those of their earlier ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, k, width + 1), np.int64)
        for batch in batches:
            if not len(batch):
                continue
            x = _cells(batch, parts * width)
            before, one = batch.column("before"), np.ones((len(x), 1), np.int64)
            sides = [(1, _codes(batch.column("code"), parts), np.ones(len(x), bool))]
            had = ~before.is_null().to_numpy(zero_copy_only=False)
            if had.any():
                earlier = np.zeros((len(x), parts), np.uint8)
                earlier[had] = _codes(before.drop_null(), parts)
                sides.append((-1, earlier, had))
            for sign, codes, rows in sides:
                for p in range(parts):
                    piece = np.concatenate((x[:, p * width:(p + 1) * width], one), 1)
                    np.add.at(total[p], codes[rows, p], sign * piece[rows])
        flat = total.ravel()
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(flat[at])], names=["slot", "n"])

    return run


def quantised(vectors: DataFrame, parts: int = 8, scale: int = 4096) -> tuple[DataFrame, int]:
    """(vec_id, label, cells) of the usable rows of ``vectors`` (vec_id, embedding, label), and the common length (0: no usable row)."""
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    # NaN is larger than every number, so one comparison rejects it with the infinities.
    finite = F.coalesce(F.forall("x", lambda v: F.abs(v) < float("inf")), F.lit(False))
    able = rows.filter(finite & (F.size("x") > 0) & (F.size("x") % parts == 0))
    first = able.select("vec_id", F.size("x").alias("n")).orderBy(F.asc_nulls_last("vec_id"), "n").first()
    if first is None:
        return rows.limit(0).select("vec_id", "label", F.lit(None).cast("array<int>").alias("cells")), 0
    size = first["n"]
    largest = min(math.isqrt((1 << 59) // (size // parts)), (1 << 31) - 1)
    able = able.filter((F.size("x") == size) & F.forall("x", lambda v: F.abs(v) < largest / scale))
    return able.select("vec_id", "label", F.transform("x", lambda v: F.floor(v * scale).cast("int")).alias("cells")), size


def starting_books(cells: DataFrame, size: int, parts: int, entries: int) -> Codebooks:
    """The pieces of the vectors of the ``entries`` smallest vec_ids."""
    ids = cells.select("vec_id").filter("vec_id is not null").distinct().orderBy("vec_id").limit(entries)
    picked = [r["vec_id"] for r in ids.collect()]
    rows = cells.filter(F.col("vec_id").isin(picked)).groupBy("vec_id").agg(F.min("cells").alias("cells")).orderBy("vec_id").collect()
    whole = np.array([r["cells"] for r in rows], np.int64).reshape(-1, parts, size // parts)
    return Codebooks(np.ascontiguousarray(whole.transpose(1, 0, 2)))


def trained(cells: DataFrame, books: Codebooks, rounds: int = 6) -> tuple[Codebooks, DataFrame]:
    """The codebooks after ``rounds`` rounds, and the rows with the codes of the last round."""
    kind = cells.schema
    schema = f"vec_id {kind['vec_id'].dataType.simpleString()}, label {kind['label'].dataType.simpleString()}, cells array<int>, code binary, before binary"
    parts, k, width = books.entries.shape
    total = np.zeros((parts, k, width + 1), np.int64)
    state = cells.withColumn("code", F.lit(None).cast("binary"))
    for turn in range(rounds):
        passed = written(state.select("vec_id", "label", "cells", "code").mapInArrow(_assigned(books, turn == 0, False), schema), "ball-rows")
        if turn:
            remove(state)
        state = passed
        changed = state.filter("before is null or before <> code").select("cells", "code", "before")
        sums = changed.mapInArrow(_moved(parts, k, width), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
        for slot, n in sums.collect():
            total.reshape(-1)[slot] += n
        used = total[:, :, width] > 0
        entries = books.entries.copy()
        entries[used] = total[:, :, :width][used] // total[:, :, width:][used]
        books = Codebooks(entries)
    return books, state


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> tuple[DataFrame, Codebooks | None]:
    """(vec_id, label, code, error) of every usable row of ``vectors``, a byte of code per part, and the codebooks."""
    if not (1 <= entries <= 256 and rounds >= 1):
        raise ValueError("a code is one byte a part: 1 to 256 entries, and at least one round")
    cells, size = quantised(vectors, parts, scale)
    kind = vectors.schema
    schema = f"vec_id {kind['vec_id'].dataType.simpleString()}, label {kind['label'].dataType.simpleString()}, code binary, error long"
    none = vectors.sparkSession.createDataFrame([], schema)
    if not size:
        return none, None
    cells = written(cells, "ball-cells")
    books = starting_books(cells, size, parts, entries)
    if not books.entries.size:  # no row has a vec_id to start from
        return none, None
    books, state = trained(cells, books, rounds)
    return written(state.mapInArrow(_assigned(books, False, True), schema), "ball-codes"), books


def with_label_errors(codes: DataFrame) -> DataFrame:
    """``codes`` with ``label_error``: the error summed over equal labels, nulls together.

    Sums combine before they shuffle; they are joined back in ``SALTS`` shares of each label.
    """
    share = F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int")
    sums = codes.groupBy("label").agg(F.sum("error").alias("label_error"))
    sums = sums.select(F.col("label").alias("_label"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_share"))
    rows = codes.withColumn("_own", share)
    return rows.join(sums, F.col("label").eqNullSafe(F.col("_label")) & (F.col("_own") == F.col("_share"))).drop("_label", "_share", "_own")


def coded(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error and the digest of all entries."""
    rows, books = compress(vectors, parts, entries, rounds, scale)
    return with_label_errors(rows).select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.digest() if books else "").alias("codebooks_sha256"))
