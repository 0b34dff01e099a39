"""Vectorised work on Arrow text columns: byte buffers, words, span hashes, slices."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_RADIX = 0x9E3779B97F4A7C15 | 1
_RADIX_INVERSE = pow(_RADIX, -1, 1 << 64)

#: ASCII white space, as the operators' word patterns name it: 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Lower-cases A to Z and leaves every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def _table(radix: int, n: int) -> np.ndarray:
    """radix to the powers 0 .. n-1, modulo 2**64."""
    have = _powers.get(radix)
    if have is None or len(have) < n:
        size = ((int(n) >> 20) + 1) << 20
        step = np.full(size, radix, U64)
        step[0] = 1
        have = _powers[radix] = np.cumprod(step, dtype=U64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit values."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def prefix_sums(buf: np.ndarray, radix: int = _RADIX) -> np.ndarray:
    out = np.empty(len(buf) + 1, U64)
    out[0] = 0
    np.cumsum((buf.astype(U64) + U64(1)) * _table(radix, len(buf)), out=out[1:])
    return out


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of buf[s:e]; equal bytes have equal hashes wherever they stand."""
    if sums is None:
        sums = prefix_sums(buf)
    h = sums[ends] - sums[starts]
    h *= _table(_RADIX_INVERSE, len(buf) + 1)[starts]
    return mix(h ^ (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def hashes_by_parts(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, radix: int = _RADIX, part: int = 1 << 20) -> np.ndarray:
    """span_hashes() for spans in ascending order of their starts, with tables of about ``part`` bytes' length."""
    out, i = np.empty(len(starts), U64), 0
    inverse = pow(radix, -1, 1 << 64)
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + part)))
        lo, hi = starts[i], ends[i:j].max()
        s, e = starts[i:j] - lo, ends[i:j] - lo
        sums = prefix_sums(buf[lo:hi], radix)
        h = (sums[e] - sums[s]) * _table(inverse, hi - lo + 1)[s]
        out[i:j] = mix(h ^ (e - s).astype(U64) * U64(0xD6E8FEB86659FD93))
        i = j
    return out


def column_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text or binary column and the n+1 places where rows begin; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    large = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    if column.null_count:
        column = column.cast(large).fill_null(b"")
    kind = np.int64 if large == pa.large_binary() else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(buf: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of non-break bytes within rows, and the n+1 word numbers where rows begin."""
    inside = ~breaks[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(buf), bool)
    after = np.empty(len(buf), bool)
    if len(buf):
        before[0] = after[-1] = False
        before[1:], after[:-1] = inside[:-1], inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def give_back() -> None:
    """Returns freed memory of a worker process to the machine, as workers wait for their next task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of each node's component, for nodes 0 .. n-1 and links a-b, by hooking and pointer jumping."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            break
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label
