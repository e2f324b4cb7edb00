"""Vectorised helpers that run inside Spark tasks: polynomial hashes over token streams, word splitting on raw UTF-8.

Everything here works on one bounded chunk of one Arrow batch; Spark deals the rows and shuffles the results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}

#: Bytes of text that one chunk holds at most, unless a single text is longer.
CHUNK_BYTES = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(32)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            _POWERS[name] = np.cumprod(table, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


class RangeHash:
    """Rabin-Karp hashes of any range of a token stream in constant time each (modulo 2^64, then mixed)."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        up, self._down = _powers(n + 1)
        self._sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values * up[:n], out=self._sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self._sums[end] - self._sums[begin]) * self._down[begin])

    def windows(self, size: int) -> np.ndarray:
        n = len(self._sums) - size
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        return mix64((self._sums[size:] - self._sums[:n]) * self._down[:n])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours (two accumulated passes over blocks)."""
    n = len(x)
    if n < width:
        return x[:0]
    if width == 1:
        return x
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(x.dtype).max, dtype=x.dtype)
    padded[:n] = x
    table = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    back = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def string_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], type=column.type)
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    if len(column) == 0:
        return np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [first, last) whose texts together hold about ``most`` bytes; one longer text stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[0x30:0x3A] = _ALNUM[0x61:0x7B] = _ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_bounds(data: np.ndarray, offsets: np.ndarray, alnum: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end byte of each word, and the number of words before each text (n + 1 entries).

    Words are runs without ASCII white space, or with ``alnum`` runs of digits, a-z and non-ASCII bytes. A run ends with its text.
    """
    inside = _ALNUM[data] if alnum else ~SPACE[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts[firsts] = inside[firsts]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    lasts = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    ends[lasts] = inside[lasts]
    begin, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return begin, end, np.searchsorted(begin, offsets)


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes and length."""
    if not len(begin):
        return np.zeros(0, dtype=np.uint64)
    return mix64(RangeHash(_BYTE[data]).of(begin, end) + (end - begin).astype(np.uint64))


_X1, _X2, _X3, _X4, _X5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * _X2, 31) * _X1


def xxh64_slices(data: np.ndarray, begin: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of many byte slices at once; slices of 64 bytes or more go to the library one by one."""
    raw = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    words = np.ndarray((len(raw) - 7,), dtype="<u8", buffer=raw.data, strides=(1,))
    halves = np.ndarray((len(raw) - 3,), dtype="<u4", buffer=raw.data, strides=(1,))
    length = end - begin
    s = np.uint64(seed)
    h = np.full(len(begin), s + _X5, dtype=np.uint64)
    at = begin.copy()
    striped = np.flatnonzero((length >= 32) & (length < 64))
    if len(striped):
        p = begin[striped]
        with np.errstate(over="ignore"):
            v = [_round(np.full(len(p), x, dtype=np.uint64), words[p + 8 * i]) for i, x in enumerate((s + _X1 + _X2, s + _X2, s, s - _X1))]
        acc = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
        for x in v:
            acc = (acc ^ _round(np.zeros(len(p), dtype=np.uint64), x)) * _X1 + _X4
        h[striped] = acc
        at[striped] += 32
    h += length.astype(np.uint64)
    short = length < 64
    for _ in range(3):
        i = np.flatnonzero(short & (end - at >= 8))
        if not len(i):
            break
        h[i] = _rotl(h[i] ^ _round(np.zeros(len(i), dtype=np.uint64), words[at[i]]), 27) * _X1 + _X4
        at[i] += 8
    i = np.flatnonzero(short & (end - at >= 4))
    h[i] = _rotl(h[i] ^ (halves[at[i]].astype(np.uint64) * _X1), 23) * _X2 + _X3
    at[i] += 4
    for _ in range(3):
        i = np.flatnonzero(short & (end > at))
        h[i] = _rotl(h[i] ^ (raw[at[i]].astype(np.uint64) * _X5), 11) * _X1
        at[i] += 1
    h ^= h >> np.uint64(33)
    h *= _X2
    h ^= h >> np.uint64(29)
    h *= _X3
    h ^= h >> np.uint64(32)
    long = np.flatnonzero(~short)
    if len(long):
        text = data.tobytes()
        h[long] = [xxhash.xxh64_intdigest(text[a:b], seed) for a, b in zip(begin[long].tolist(), end[long].tolist())]
    return h
