"""A static range asymmetric numeral system over token ids, vectorised across interleaved lanes.

One frequency table is shared by all blocks of a file. A block codes its ids on its own: row t of the block's
(rows, lanes) matrix holds one id per lane, every lane has a 63-bit state, and states shed 32-bit words in lane order.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
SCALE = 18
LOW = 31
LANES = 2048
_LOW, _WORD, _SCALE = U64(1 << LOW), U64(32), U64(SCALE)


def quantised(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Frequencies that add up to 2 ** scale, at least 1 where the count isn't 0."""
    total = int(counts.sum())
    whole = 1 << scale
    used = counts > 0
    if int(used.sum()) > whole:
        raise ValueError("more symbols than the frequency table can hold")
    f = np.where(used, np.maximum(1, (counts.astype(np.float64) * whole / max(1, total)).astype(np.int64)), 0)
    gap = whole - int(f.sum())
    for s in np.argsort(-f, kind="stable"):
        if gap == 0 or not used.any():
            break
        step = gap if gap > 0 else -min(-gap, int(f[s]) - 1)
        f[s] += step
        gap -= step
    return f


def lanes_for(n: int) -> int:
    return max(1, min(LANES, n // 64))


def encode(ids: np.ndarray, freq: np.ndarray) -> bytes:
    """The block's final states, then its words in the order in which they were shed."""
    n = len(ids)
    lanes = lanes_for(n)
    rows = -(-n // lanes)
    padded = np.full(rows * lanes, int(np.argmax(freq)), np.int64)
    padded[:n] = ids
    start = np.cumsum(freq) - freq
    f = freq[padded].astype(U64).reshape(rows, lanes)
    c = start[padded].astype(U64).reshape(rows, lanes)
    most = f << U64(LOW - SCALE + 32)
    x = np.full(lanes, _LOW, U64)
    shed = []
    for t in range(rows - 1, -1, -1):
        over = x >= most[t]
        if over.any():
            shed.append(x[over].astype("<u4"))
            x[over] >>= _WORD
        q = x // f[t]
        x = (q << _SCALE) + (x - q * f[t]) + c[t]
    return x.astype("<u8").tobytes() + b"".join(w.tobytes() for w in shed)


class Decoder:
    def __init__(self, freq: np.ndarray) -> None:
        self.freq = freq.astype(U64)
        self.start = (np.cumsum(freq) - freq).astype(U64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    def decode(self, block: bytes, n: int) -> np.ndarray:
        lanes = lanes_for(n)
        rows = -(-n // lanes)
        x = np.frombuffer(block, "<u8", lanes).astype(U64)
        words = np.frombuffer(block, "<u4", offset=8 * lanes).astype(U64)
        at = len(words)
        out = np.empty((rows, lanes), np.uint32)
        slots = U64((1 << SCALE) - 1)
        for t in range(rows):
            slot = x & slots
            s = self.symbol[slot]
            out[t] = s
            x = self.freq[s] * (x >> _SCALE) + slot - self.start[s]
            under = np.flatnonzero(x < _LOW)
            if len(under):
                x[under] = (x[under] << _WORD) | words[at - len(under) : at]
                at -= len(under)
        if at != 0 or not (x == _LOW).all():
            raise ValueError("the block is damaged")
        return out.reshape(-1)[:n]
