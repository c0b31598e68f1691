"""Numpy kernels over slices of Arrow text columns, used inside tasks.

A slice is a run of whole texts of one Arrow batch, laid out as one byte array
with offsets. Slices hold about ``SLICE_BYTES`` (one longer text makes a slice
of its own), so that the temporaries of a kernel stay bounded whatever the size
of a batch. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A little under a power of two, so that a slice with its prefix sums stays within it.
SLICE_BYTES = (1 << 18) - 64
#: Powers kept for the next call.
KEPT_POWERS = 1 << 19

#: White space of the word rule ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_values(seed: int, lower: bool = False) -> np.ndarray:
    """A 64-bit value for each byte; with ``lower`` A-Z count as a-z."""
    values = mix(np.arange(1, 257, dtype=np.uint64) + np.uint64(seed * 1000003))
    return values[LOWER] if lower else values


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64; those of usual slices are kept for the next call."""
    if len(_POWERS["up"]) >= n:
        return _POWERS["up"][:n], _POWERS["down"][:n]
    size, made = 1 << max(n - 1, 1).bit_length(), {}
    for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        made[name] = np.cumprod(steps)
    if size <= KEPT_POWERS:
        _POWERS.update(made)
    return made["up"][:n], made["down"][:n]


def prefix_hashes(data: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``span_hashes`` reads the hash of any span."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * powers(len(data))[0], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end)."""
    down = powers(len(sums))[1]
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def slices(column: pa.Array, max_bytes: int = SLICE_BYTES, max_rows: int = 4096) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts or blobs."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(wide)
    if column.null_count:
        column = pc.fill_null(column, b"" if wide == pa.large_binary() else "")
    if not len(column):
        return
    _, offsets, content = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    content = np.frombuffer(content, np.uint8) if content is not None else np.zeros(0, np.uint8)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + max_bytes, "right")) - 1)
        high = min(high, low + max_rows, len(column))
        yield low, high, content[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low]
        low = high


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of true bytes that do not cross the borders of texts."""
    n = len(inside)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of all words."""
    starts, ends = spans(~SPACE[data], offsets)
    return starts, ends, owner(offsets, starts)


def owner(offsets: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """The text each byte position lies in."""
    return np.searchsorted(offsets, positions, "right") - 1


def combine(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of every ``width`` consecutive items (fewer items: none)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(width):
        total = mix(total + hashes[i:i + n] * np.uint64(2 * i + 3))
    return total


def counts_of(owners: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    out = np.bincount(owners, weights, minlength=n)
    return out if weights is None else out.astype(np.int64)
