"""Benchmark decontamination by latent semantic retrieval.

1. Fit. Every text is cut into passages of ``PASSAGE`` tokens. Tasks sum
   C^T (C R), C being their passages' hashed term counts and R a fixed random
   matrix, and document frequencies: one row per term and task, summed by Spark.
   From those sums the driver, with matrices of ``TERMS`` x ``SKETCH`` numbers,
   gets the leading right singular vectors of the TF-IDF matrix of all passages
   (single-pass randomised SVD in Nystroem form).
2. Search. Windows of ``WINDOW`` (for short items, also ``NARROW``) tokens, one
   every ``STEP``, are projected and compared by cosine with the windows of all
   benchmark items.
   Items below ``NARROW`` tokens fill too little of a window; a text that holds
   all of their tokens in a row is found by the hash of that run instead.
3. Checks. For each candidate the longest common subsequence of the item and
   the stretch of text it lines up with must hold ``share`` of the item's
   tokens, and half of its answer (its last tokens) unless nearly all of the
   item is there. So reworded passages are caught and short overlaps are not.

Both passes read whole texts and shuffle none. Items are broadcast in blocks of
``BLOCK_BYTES`` of text, held one at a time.

Defined cases: null and empty texts, and texts without tokens, are clean; items
without tokens match nothing; without documents or items the result has no
contaminated row; repeated rows are judged each; of items that repeat an
item_id each counts; an item without item_id contaminates, and is not named in
item_ids; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querygrove.llm.kernel import SPACE, byte_values, combine, owner, prefix_hashes, slices, span_hashes, spans
from querygrove.llm.scratch import text_batches

TERMS = 4096
SKETCH = 56
DIMENSIONS = 48
PASSAGE = 256
WINDOW = 32
#: Items shorter than a window are also sought with windows of this many tokens.
NARROW = 16
STEP = 8
SLACK = 12
BLOCK_BYTES = 32 << 20

_VALUES = byte_values(2, lower=True)
_TOKEN = ~SPACE
_TOKEN[[*range(0, 48), *range(58, 65), *range(91, 97), *range(123, 128)]] = False


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens (runs of letters, digits and bytes beyond ASCII, A-Z as a-z) and the first of each text."""
    starts, ends = spans(_TOKEN[data], offsets)
    hashes = span_hashes(prefix_hashes(data, _VALUES), starts, ends)
    return hashes, np.searchsorted(owner(offsets, starts), np.arange(len(offsets)))


def _terms(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(20)).astype(np.int64) & (TERMS - 1)


def _random() -> np.ndarray:
    return np.random.default_rng(2).normal(size=(TERMS, SKETCH)).astype(np.float32)


def _counts(hashes: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """Term counts of consecutive passages, the last of a text being shorter."""
    lengths = first[1:] - first[:-1]
    per_text = -(-lengths // size)
    base = np.concatenate(([0], np.cumsum(per_text)))
    text = np.repeat(np.arange(len(lengths)), lengths)
    passage = base[text] + (np.arange(len(hashes)) - first[text]) // size
    return np.bincount(passage * TERMS + _terms(hashes), minlength=int(base[-1]) * TERMS).reshape(-1, TERMS).astype(np.float32)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    random, total, seen, passages = _random(), np.zeros((TERMS, SKETCH)), np.zeros(TERMS), 0
    for batch in batches:
        for _, _, data, offsets in slices(batch.column("text")):
            hashes, first = tokens(data, offsets)
            if len(hashes):
                c = np.sqrt(_counts(hashes, first, PASSAGE))
                total += c.T @ (c @ random)
                seen += (c > 0).sum(0)
                passages += len(c)
    if passages:
        arrays = [pa.array(np.arange(TERMS, dtype=np.int32)), pa.array(np.full(TERMS, passages)), pa.array(seen)]
        yield pa.RecordBatch.from_arrays([*arrays, *[pa.array(total[:, k]) for k in range(SKETCH)]], names=["term", "passages", "seen", *[f"s{k}" for k in range(SKETCH)]])


@dataclass
class LatentSpace:
    """Row of each hashed term in the latent space, weighted by its inverse document frequency."""

    table: np.ndarray

    @classmethod
    def fit(cls, docs: DataFrame) -> LatentSpace:
        fields = ", ".join(["term int", "passages long", "seen double", *[f"s{k} double" for k in range(SKETCH)]])
        sums = docs.select("text").mapInArrow(_sketch, fields).groupBy("term").agg(*[F.sum(c).alias(c) for c in ("passages", "seen", *[f"s{k}" for k in range(SKETCH)])])
        got = sums.toArrow()  # TERMS rows at most
        if not len(got):
            return cls(np.zeros((TERMS, 1), np.float32))
        term = got.column("term").to_numpy()
        s, seen = np.zeros((TERMS, SKETCH)), np.zeros(TERMS)
        s[term] = np.stack([got.column(f"s{k}").to_numpy() for k in range(SKETCH)], 1)
        seen[term] = got.column("seen").to_numpy()
        n = got.column("passages")[0].as_py()
        idf = np.log((n + 1) / (seen + 1)) + 0.01
        core = _random().T.astype(float) @ s
        values, vectors = np.linalg.eigh((core + core.T) / 2)
        good = values > values.max() * 1e-9
        factor = (idf[:, None] * s) @ (vectors[:, good] / np.sqrt(values[good]))
        left, singular, _ = np.linalg.svd(factor, full_matrices=False)
        keep = singular > singular.max() * 1e-6
        left, singular = left[:, keep][:, :DIMENSIONS], singular[keep][:DIMENSIONS]
        return cls((idf[:, None] * left / singular).astype(np.float32))


def _windows(vectors: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors, texts and first tokens of the windows of all texts, one every STEP tokens."""
    lengths = first[1:] - first[:-1]
    blocks = -(-lengths // STEP)
    base = np.concatenate(([0], np.cumsum(blocks)))
    text = np.repeat(np.arange(len(lengths)), blocks)
    start = first[text] + (np.arange(base[-1]) - base[text]) * STEP
    sums = np.add.reduceat(vectors, start, axis=0) if len(start) else np.zeros((0, vectors.shape[1]), np.float32)
    out = sums.copy()
    for k in range(1, width // STEP):
        same = text[k:] == text[:-k]
        out[:-k][same] += sums[k:][same]
    # A text's last windows are parts of the one before them, except for a text of one window.
    whole = (start + width <= first[1:][text] + STEP - 1) | (start == first[:-1][text])
    out, text, start = out[whole], text[whole], start[whole]
    return out / np.maximum(np.sqrt((out * out).sum(1, keepdims=True)), 1e-12), text, start


@dataclass
class Items:
    """A block of benchmark items with their windows in the latent space."""

    ids: list[int | None]
    hashes: list[np.ndarray]
    #: Width: (vectors, item numbers, first tokens) of windows.
    windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    #: Tokens of an item below NARROW: (sorted hashes of whole items, item numbers).
    runs: dict[int, tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, ids: list[int | None], texts: list[str | None], space: LatentSpace) -> Items:
        hashes, first = np.zeros(0, np.uint64), np.zeros(1, int)
        for _, _, data, offsets in slices(pa.array(texts, pa.large_string()), 1 << 60, 1 << 60):
            hashes, first = tokens(data, offsets)
        parts = [hashes[a:b] for a, b in zip(first, first[1:], strict=False)]
        windows = {}
        for width in (WINDOW, NARROW):
            rows, item, at = [], [], []
            for number, own in enumerate(parts):
                if not len(own) or width == NARROW and len(own) >= WINDOW:
                    continue
                last = max(len(own) - width, 0)
                for begin in sorted({*range(0, last + 1, width // 2), last}):
                    vector = space.table[_terms(own[begin:begin + width])].sum(0)
                    rows.append(vector / max(float(np.linalg.norm(vector)), 1e-12))
                    item.append(number)
                    at.append(begin)
            if rows:
                windows[width] = np.array(rows, np.float32), np.array(item), np.array(at)
        runs = {}
        for size in sorted({len(own) for own in parts if 0 < len(own) < NARROW}):
            item = np.array([number for number, own in enumerate(parts) if len(own) == size])
            run = np.concatenate([combine(parts[number], size) for number in item])
            order = np.argsort(run, kind="stable")
            runs[size] = run[order], item[order]
        return cls(ids, parts, windows, runs)

    def whole(self, hashes: np.ndarray, first: np.ndarray) -> set[tuple[int, int]]:
        """(text, item number) of the short items whose tokens stand in a row in a text."""
        found: set[tuple[int, int]] = set()
        text = np.repeat(np.arange(len(first) - 1), first[1:] - first[:-1])
        for size, (run, item) in self.runs.items():
            own = combine(hashes, size)
            inside = text[:len(own)] == text[size - 1:] if len(own) else np.zeros(0, bool)
            own, of = own[inside], text[:len(inside)][inside]
            low, high = np.searchsorted(run, own), np.searchsorted(run, own, "right")
            for t, a, b in {(t, a, b) for t, a, b in zip(of[low < high].tolist(), low[low < high].tolist(), high[low < high].tolist(), strict=True)}:
                found.update((t, number) for number in item[a:b].tolist())
        return found


class _Checker:
    """Longest common subsequences with one item, as bit operations on whole rows of the table."""

    def __init__(self, item: np.ndarray) -> None:
        self.n = len(item)
        self.answer = max(3, self.n // 5)
        self.masks: dict[int, int] = {}
        for place, token in enumerate(item.tolist()):
            self.masks[token] = self.masks.get(token, 0) | 1 << place

    def common(self, text: list[int], keep: int) -> int:
        """Length of the longest common subsequence of ``text`` and the item's last ``keep`` tokens."""
        drop, full = self.n - keep, (1 << keep) - 1
        row = full
        for token in text:
            mask = self.masks.get(token)
            if mask is not None:
                hit = row & (mask >> drop)
                row = ((row + hit) | (row - hit)) & full
        return keep - row.bit_count()

    def verdict(self, text: list[int], share: float) -> tuple[bool, float]:
        part = self.common(text, self.n) / self.n
        if part < share:
            return False, part
        answer = min(self.answer, self.n)
        return part >= 0.9 or 2 * self.common(text, answer) >= answer, part


def _search(space: Broadcast, blocks: list[Broadcast], cosine: float, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = space.value.table
        for batch in batches:
            n = len(batch)
            found: list[dict[int | None, float]] = [{} for _ in range(n)]
            best, candidates = np.full(n, -1.0), np.zeros(n, np.int64)
            for block in blocks:
                items: Items = block.value
                checkers: dict[int, _Checker] = {}
                for low, _, data, offsets in slices(batch.column("text")):
                    hashes, first = tokens(data, offsets)
                    if not len(hashes):
                        continue
                    for t, number in items.whole(hashes, first):
                        candidates[low + t] += 1
                        found[low + t][items.ids[number]] = 1.0
                    vectors, tried = table[_terms(hashes)], set()
                    for width, (wanted, item, at) in items.windows.items():
                        own, text, start = _windows(vectors, first, width)
                        for a in range(0, len(own), 8192):
                            near = own[a:a + 8192] @ wanted.T
                            top = near.max(1)
                            np.maximum.at(best, low + text[a:a + 8192], top)
                            rows = np.flatnonzero(top >= cosine)
                            i, j = np.nonzero(near[rows] >= cosine)
                            for w, q in zip((a + rows[i]).tolist(), j.tolist(), strict=True):
                                t, number, lined = int(text[w]), int(item[q]), int(start[w] - at[q])
                                if (t, number, lined // SLACK) in tried:
                                    continue
                                tried.add((t, number, lined // SLACK))
                                candidates[low + t] += 1
                                if number not in checkers:
                                    checkers[number] = _Checker(items.hashes[number])
                                size = len(items.hashes[number])
                                region = hashes[max(lined - 2 * SLACK, int(first[t])):min(lined + size + 2 * SLACK, int(first[t + 1]))]
                                leaked, part = checkers[number].verdict(region.tolist(), share)
                                if leaked:
                                    of = found[low + t]
                                    of[items.ids[number]] = max(part, of.get(items.ids[number], 0.0))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([bool(x) for x in found]), pa.array([sorted(i for i in x if i is not None) for x in found], pa.list_(pa.int64())),
                 pa.array([max(x.values(), default=0.0) for x in found]), pa.array(candidates), pa.array(np.maximum(best, 0.0)), *[batch.column(c) for c in batch.schema.names if c == "own"]],
                names=["doc_id", "contaminated", "item_ids", "common_share", "candidates", "cosine", *[c for c in batch.schema.names if c == "own"]])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = 0.62, share: float = 0.7, own: bool = False) -> DataFrame:
    """For every row of ``docs``: is it contaminated, the leaked items, and the largest share of an item found.

    With ``own`` the row itself comes along as a struct.
    """
    spark = docs.sparkSession
    text_batches(spark)
    space = LatentSpace.fit(docs)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts, blocks = max(1, -(-size // BLOCK_BYTES)), []
    for part in range(parts):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).toArrow()
        blocks.append(spark.sparkContext.broadcast(Items.of(rows.column("item_id").to_pylist(), rows.column("text").to_pylist(), space)))
    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select("doc_id", "text", *([F.struct(*docs.columns).alias("own")] if own else []))
    schema = f"doc_id {kind}, contaminated boolean, item_ids array<long>, common_share double, candidates long, cosine double"
    if own:
        schema += f", own {source.schema['own'].dataType.simpleString()}"
    return source.mapInArrow(_search(spark.sparkContext.broadcast(space), blocks, cosine, share), schema)


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item."""
    return leaks(docs, benchmark, own=True).filter(~F.col("contaminated")).select("own.*")
