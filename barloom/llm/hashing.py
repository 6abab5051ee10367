"""Vectorised word and window hashes over whole Arrow columns: no loop over documents or words."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
MASK = (1 << 64) - 1
_M1, _M2, _M3 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_ROLL = (U64(0xD6E8FEB86659FD93), U64(0xA24BAED4963EE407))

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x ^ (x >> U64(30))
    x = x * _M2
    x = x ^ (x >> U64(27))
    x = x * _M3
    return x ^ (x >> U64(31))


def column_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column without nulls, and each row's offset into them (one more than rows)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def by_bytes(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts add up to about `most` bytes; a longer text is a slice of its own."""
    sizes = np.diff(column_bytes(batch.column(column))[1])
    if not len(sizes):
        return
    part = np.maximum(0, np.cumsum(sizes) - 1) // most
    cuts = np.flatnonzero(np.diff(part, prepend=-1))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(sizes)], strict=True):
        yield batch.slice(a, b - a)


def split_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word (a run of bytes other than ASCII white space; rows are apart)."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, inside[:-1]
    before &= ~edge[:-1]
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = False, inside[1:]
    after &= ~edge[1:]
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, eight bytes at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(padded) - 7,), "<u8", padded.data, strides=(1,))
    size = ends - starts
    out = mix(size.astype(U64) * _M1)
    live, at = np.arange(len(starts)), starts
    left = size
    while len(live):
        keep = U64(8) * np.maximum(0, 8 - left).astype(U64)
        out[live] = mix((out[live] ^ ((eights[at] << keep) >> keep)) * _M1)
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return out


def hash_windows(words: np.ndarray, size: int, lane: int = 0) -> np.ndarray:
    """A hash of each window of `size` word hashes (len(words) - size + 1 of them), built by doubling."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    roll = _ROLL[lane]
    level, length, power = (words if lane == 0 else mix(words ^ _M2)), 1, roll
    done, covered = None, 0
    rest = size
    while True:
        if rest & 1:
            part = level[covered : covered + n]
            done = part.copy() if done is None else done * power + part
            covered += length
        rest >>= 1
        if not rest:
            break
        level = level[: len(level) - length] * power + level[length:]
        length, power = 2 * length, U64(int(power) ** 2 & MASK)
    return mix(done + U64(size * int(_M1) & MASK))


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted unsigned integers as byte planes of their differences; the planes above the random ones compress."""
    gaps = np.diff(values.astype(U64), prepend=U64(0)).astype("<u8")
    planes = gaps.view(np.uint8).reshape(-1, 8).T
    top = int(np.median(gaps)).bit_length() if len(gaps) else 0
    raw = max(0, min(8, (top - 4) // 8))
    return bytes([raw]) + planes[:raw].tobytes() + zlib.compress(planes[raw:].tobytes(), 1)


def unpack_sorted(packed: bytes, n: int) -> np.ndarray:
    raw = packed[0]
    body = packed[1 : 1 + raw * n] + zlib.decompress(packed[1 + raw * n :])
    planes = np.frombuffer(body, np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").reshape(-1).astype(U64), dtype=U64)
