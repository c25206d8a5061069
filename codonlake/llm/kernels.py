"""Numpy text kernels used inside Arrow tasks: words, word hashes and word n-grams of whole texts.

All of them work on the UTF-8 bytes of a block of texts at once. Every character of two or more
bytes is a word character in both word classes, so bytes decide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: `[^\x20\x09-\x0D]+`
SPACED = np.ones(256, bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_U = np.uint64
#: Spans of up to so many bytes are hashed eight bytes at a time, longer ones by BLAKE2.
STEPPED = 256
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], _U)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def blocks(batch: pa.RecordBatch, text: str = "text", limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of whole texts of up to ``limit`` bytes, one text at least."""
    col = batch.column(batch.schema.get_field_index(text))
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    n = len(col)
    if not n:
        return
    offs = np.frombuffer(col.buffers()[1], np.int64, n + 1, col.offset * 8)
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, "right")) - 1)
        b = min(b, n)
        yield a, b, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def words(buf: np.ndarray, offs: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in bytes, and for each text the index of its first word (one more at the end)."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    w = kind[buf]
    cut = w.copy()
    cut[1:] &= ~w[:-1]
    edge = offs[:-1][offs[:-1] < offs[1:]]
    cut[edge] = w[edge]
    starts = np.flatnonzero(cut)
    stop = w.copy()
    stop[:-1] &= ~w[1:]
    last = offs[1:][offs[:-1] < offs[1:]] - 1
    stop[last] = w[last]
    return starts, np.flatnonzero(stop) + 1, np.searchsorted(starts, offs)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, in any order. Each step mixes eight bytes into the state of the spans that have them."""
    size = ends - starts
    out = mix((size.astype(_U) + _U(1)) * _U(0x9E3779B97F4A7C15))
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))
    live = np.flatnonzero((size > 0) & (size <= STEPPED))
    at, left, state = starts[live], size[live], out[live]
    while len(live):
        state = mix(state * _U(0xD6E8FEB86659FD93) ^ (eight[at] & _MASK[np.minimum(left, 8)]))
        more = left > 8
        out[live[~more]] = state[~more]
        live, at, left, state = live[more], at[more] + 8, left[more] - 8, state[more]
    for i in np.flatnonzero(size > STEPPED).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(np.ascontiguousarray(buf[starts[i] : ends[i]]), digest_size=8).digest(), "little")
    return out


def ngrams(hashes: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hashes of all runs of ``k`` neighbours, those across texts included."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    g = np.full(n, _U(0x5851F42D4C957F2D + 2 * salt), _U)
    for t in range(k):
        g *= _U(0xD1342543DE82EF95)
        g += hashes[t : t + n]
    return mix(g)


def inside(first: np.ndarray, n: int, k: int) -> np.ndarray:
    """Which of the first n-k+1 positions start a run of ``k`` words of one text."""
    m = n - k + 1
    if m <= 0:
        return np.zeros(0, bool)
    ok = np.ones(m, bool)
    for e in first[1:-1]:
        ok[max(0, e - k + 1) : min(e, m)] = False
    return ok


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of ``w``."""
    have, m = 1, x
    while 2 * have <= w:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    rest = w - have
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m
