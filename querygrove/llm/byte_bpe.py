"""Byte-level BPE encoding and decoding with a two-tier lookup.

First tier: a minimal perfect hash (hash and displace) over the vocabulary
resolves every whole pre-token that is a vocabulary entry. Second tier: a miss
is merged with a heap of adjacent pairs over a doubly linked list of bytes,
lowest rank first, leftmost first among equals, in O(n log n) for any length.

Texts are encoded in tasks, batch by batch, without a shuffle. The vocabulary
tables travel as one broadcast; their size is that of the rank file. A worker
keeps the ids of pre-tokens it has met, up to ``MEMO`` + ``ONCE`` of them.

Defined cases: a null text is empty and has no ids; malformed UTF-8 counts as
U+FFFD; unknown and null ids decode to nothing; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querygrove.llm.kernel import byte_values, mix, prefix_hashes, slices, span_hashes
from querygrove.llm.scratch import text_batches

MEMO = 400_000
#: Pre-tokens met once, which are kept if they come again.
ONCE = 400_000
RANK_BITS = 24
#: Bytes of text encoded, and ids decoded, at a time.
ENCODED_BYTES = 1 << 18
DECODED_IDS = 100_000
#: Longer pre-tokens are not kept.
MEMO_BYTES = 48

_VALUES = byte_values(5)
_STEP = np.uint64(0xA24BAED4963EE407)


def _hashes(items: list[bytes]) -> np.ndarray:
    ends = np.cumsum([len(x) for x in items])
    data = np.frombuffer(b"".join(items), np.uint8)
    return span_hashes(prefix_hashes(data, _VALUES), np.concatenate(([0], ends[:-1])).astype(np.int64), ends.astype(np.int64))


@dataclass
class MinimalPerfectHash:
    """Slots 0..n-1 for n distinct keys; other keys get some slot, so the caller compares the key found there."""

    displacement: np.ndarray
    size: int

    @classmethod
    def build(cls, keys: list[bytes]) -> MinimalPerfectHash:
        n, hashes = len(keys), _hashes(keys) if keys else np.zeros(0, np.uint64)
        if len(np.unique(hashes)) < n:
            raise ValueError("two keys have equal hashes, or a key repeats")
        buckets = max(1, n // 4)
        home = (hashes % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        counts = np.bincount(home, minlength=buckets)
        first = np.concatenate(([0], np.cumsum(counts)))
        displacement, taken = np.zeros(buckets, np.int64), np.zeros(n, bool)
        tries = 256
        for bucket in np.argsort(-counts, kind="stable"):
            if counts[bucket] < 2:
                break
            own, base = hashes[order[first[bucket]:first[bucket + 1]]], 1
            while True:
                steps = np.arange(base, base + tries, dtype=np.uint64)[:, None]
                slots = (mix(own[None, :] + steps * _STEP) % np.uint64(n)).astype(np.int64)
                slots.sort(axis=1)
                good = np.flatnonzero(~taken[slots].any(axis=1) & (slots[:, 1:] != slots[:, :-1]).all(axis=1))
                if len(good):
                    displacement[bucket] = base + good[0]
                    taken[slots[good[0]]] = True
                    break
                base += tries
        # Buckets of one key name a free slot outright.
        single = np.flatnonzero(counts == 1)
        displacement[single] = -1 - np.flatnonzero(~taken)[:len(single)]
        return cls(displacement, n)

    def slots(self, items: list[bytes]) -> np.ndarray:
        hashes = _hashes(items)
        step = self.displacement[(hashes % np.uint64(len(self.displacement))).astype(np.int64)]
        jumped = (mix(hashes + step.astype(np.uint64) * _STEP) % np.uint64(max(self.size, 1))).astype(np.int64)
        return np.where(step < 0, -1 - step, jumped)


@dataclass
class Vocabulary:
    """Ranks of byte strings, the pattern that splits text, and the perfect hash over the byte strings."""

    ranks: dict[bytes, int]
    pattern: str
    table: MinimalPerfectHash = field(init=False)
    by_slot: list[bytes] = field(init=False)
    single: list[int | None] = field(init=False)
    double: list[list[int | None]] = field(init=False)

    def __post_init__(self) -> None:
        self.single = [self.ranks.get(bytes([byte])) for byte in range(256)]
        self.double = [[self.ranks.get(bytes([a, b])) for b in range(256)] for a in range(256)]
        keys = list(self.ranks)
        self.table = MinimalPerfectHash.build(keys)
        self.by_slot = [b""] * len(keys)
        for slot, key in zip(self.table.slots(keys).tolist() if keys else [], keys, strict=True):
            self.by_slot[slot] = key

    @classmethod
    def load(cls, path: str, pattern: str) -> Vocabulary:
        """Reads a rank file: a base64 byte string and its rank per line."""
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        return cls(ranks, pattern)

    def pairs(self) -> dict[int, int]:
        """Rank of every pair of entries that together are an entry, keyed by both ranks."""
        found, get = {}, self.ranks.get
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = get(token[:cut]), get(token[cut:])
                if left is not None and right is not None:
                    found[left << RANK_BITS | right] = rank
        return found

    def merge(self, piece: bytes, pairs: dict[int, int]) -> list[int]:
        """Ids of one pre-token that is no vocabulary entry."""
        get, double, n = pairs.get, self.double, len(piece)
        bits = n.bit_length()
        mask, above = (1 << bits) - 1, 2 * bits
        ids = list(map(self.single.__getitem__, piece))  # of the part that begins here
        end = list(range(1, n + 1))  # of that part; 0: merged into an earlier one
        before = list(range(-1, n - 1))
        # A heap entry is one number: rank, begin and end of a pair of neighbours.
        heap = [rank << above | i << bits | i + 2 for i in range(n - 1) if (rank := double[piece[i]][piece[i + 1]]) is not None]
        heapify(heap)
        while heap:
            top = heappop(heap)
            i, stop = top >> bits & mask, top & mask
            middle = end[i]
            if not middle or middle == n or end[middle] != stop:
                continue  # one of the two has changed since
            end[i], end[middle], ids[i] = stop, 0, top >> above
            if stop < n:
                before[stop] = i
                rank = get(ids[i] << RANK_BITS | ids[stop])
                if rank is not None:
                    heappush(heap, rank << above | i << bits | end[stop])
            left = before[i]
            if left >= 0:
                rank = get(ids[left] << RANK_BITS | ids[i])
                if rank is not None:
                    heappush(heap, rank << above | left << bits | stop)
        return [ids[i] for i in range(n) if end[i]]

    def resolve(self, pieces: list[str], pairs: dict[int, int]) -> dict[str, tuple[int, ...]]:
        """Ids of distinct pre-tokens: one vectorised lookup for all, merges for the misses."""
        raw = [piece.encode("utf-8", "replace") for piece in pieces]
        found = {}
        for piece, key, slot in zip(pieces, raw, self.table.slots(raw).tolist() if raw and self.ranks else [0] * len(raw), strict=True):
            if self.ranks and self.by_slot[slot] == key:
                found[piece] = (self.ranks[key],)
            else:
                found[piece] = tuple(self.merge(key, pairs))
        return found


#: The pattern of the public rank files, and the same for the standard library, which is faster. The two
#: agree on text of Latin-1 characters other than LATIN_ODD, where their character classes differ.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LATIN_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"""
LATIN_ODD = bytes([*range(0x1C, 0x20), 0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE])


def splitter(pattern: str):
    """Splits a text into pre-tokens."""
    general = regex.compile(pattern).findall
    if pattern != PATTERN:
        return general
    latin = re.compile(LATIN_PATTERN).findall

    def split(text: str) -> list[str]:
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            return general(text)
        return latin(text) if len(raw.translate(None, LATIN_ODD)) == len(raw) else general(text)

    return split


class Encoder:
    """Encodes texts with a memory of pre-tokens that lives as long as the Python worker.

    A pre-token is kept for good when it comes a second time; those met once
    are kept apart, as most of them never come again.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.split = splitter(vocabulary.pattern)
        self.pairs = vocabulary.pairs()
        self.memo: dict[str, tuple[int, ...]] = {}
        self.once: dict[str, tuple[int, ...]] = {}

    def encode(self, texts: list[str]) -> list[list[int]]:
        memo, once = self.memo, self.once
        if len(memo) > MEMO:
            memo.clear()
        if len(once) > ONCE:
            once.clear()
        split = [self.split(text) for text in texts]
        missing = set().union(*split).difference(memo) if split else set()
        again = {piece for piece in missing if piece in once}  # an intersection would walk through all that is kept
        for piece in again:
            memo[piece] = once.pop(piece)
        extra = self.vocabulary.resolve(list(missing - again), self.pairs)
        memo.update(extra)
        look = memo.__getitem__
        found = [list(chain.from_iterable(map(look, pieces))) for pieces in split]
        for piece, ids in extra.items():
            del memo[piece]
            if len(piece) <= MEMO_BYTES:
                once[piece] = ids
        return found


_ENCODERS: dict[int, Encoder] = {}


def _encoder(broadcast) -> Encoder:
    if id(broadcast.value) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[id(broadcast.value)] = Encoder(broadcast.value)
    return _ENCODERS[id(broadcast.value)]


def _pieces(vocabulary: Vocabulary) -> list[bytes]:
    """The bytes of every id, and no bytes for all ids beyond."""
    pieces = [b""] * (max(vocabulary.ranks.values(), default=-1) + 2)
    for token, rank in vocabulary.ranks.items():
        pieces[rank] = token
    return pieces


def _decoded(flat: np.ndarray, ends: np.ndarray, pieces: list[bytes]) -> pa.Array:
    """The bytes of consecutive lists of ids."""
    beyond = len(pieces) - 1
    ids = np.where((flat < 0) | (flat > beyond), beyond, flat).tolist()
    at = ends.tolist()
    return pa.array([b"".join(map(pieces.__getitem__, ids[a:b])) for a, b in zip(at, at[1:], strict=False)], pa.binary())


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", keep: list[str] | None = None, out: str = "ids",
           decoded: str | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` and ``out``, the ids of each whole text; ``decoded`` names a column for the bytes they decode to."""
    text_batches(docs.sparkSession)
    keep = ["doc_id"] if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        pieces = _pieces(encoder.vocabulary) if decoded else []
        for batch in batches:
            for low, high, data, offsets in slices(batch.column(text), ENCODED_BYTES):
                raw, at = data.tobytes(), offsets.tolist()
                ids = encoder.encode([raw[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:], strict=False)])
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                flat = np.array(list(chain.from_iterable(ids)), np.int32)
                made = [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))] + ([_decoded(flat, ends, pieces)] if decoded else [])
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(low, high - low) for c in keep], *made], names=[*keep, out, *([decoded] if decoded else [])])

    source = docs.select(*[f"`{c}`" for c in dict.fromkeys([*keep, text])])
    fields = [f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep] + [f"`{out}` array<int>"] + ([f"`{decoded}` binary"] if decoded else [])
    return source.mapInArrow(run, ", ".join(fields))


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes that its ids stand for."""
    text_batches(encoded.sparkSession)
    shared, names = encoded.sparkSession.sparkContext.broadcast(vocabulary), encoded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(shared.value)
        for batch in batches:
            column = batch.column(ids)
            ends = np.concatenate(([0], np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(column), 0)))))
            low = 0
            while low < len(column):
                high = max(low + 1, int(np.searchsorted(ends, ends[low] + DECODED_IDS, "right")) - 1)
                high = min(high, len(column))
                flat = np.asarray(pc.fill_null(column.slice(low, high - low).flatten(), -1))
                found = _decoded(flat, ends[low:high + 1] - ends[low], pieces)
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(low, high - low) for c in names], found], names=[*names, out])
                low = high

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{fields}, `{out}` binary")


def digests(decoded: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Counts and digests of ids and decoded bytes."""
    keep = ["doc_id"] if keep is None else keep
    return decoded.select(
        *[f"`{c}`" for c in keep], F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
