"""Vectorised views of Arrow text columns: bytes, word bounds, rolling hashes.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D; no byte of a multi-byte UTF-8 character is one of these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(n: int, _kept: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """BASE**i and BASE**-i modulo 2**64 for i below n at least."""
    if len(_kept.get("up", ())) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for name, factor in (("up", BASE), ("down", _INVERSE)):
            a = np.full(size, factor, dtype=U64)
            a[0] = 1
            _kept[name] = np.multiply.accumulate(a)
    return _kept["up"], _kept["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every input bit reaches every output bit."""
    h = h.astype(U64, copy=True)
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(batch: pa.RecordBatch, name: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text each (a longer text is a slice of its own)."""
    _, off = texts(batch.column(batch.schema.get_field_index(name)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start of each word, end of each word, index of each text's first word plus a last entry)."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = ~SPACE[raw]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < len(raw))]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[cut] = inside[cut]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cut - 1] = inside[cut - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, off)


def prefix(raw: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial hash; see span_hash."""
    up, _ = powers(len(raw) + 1)
    out = np.zeros(len(raw) + 1, dtype=U64)
    np.cumsum((raw.astype(U64) + U64(1)) * up[: len(raw)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes in [start, end); equal for equal bytes wherever they are."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start])


def word_hashes(raw: np.ndarray, off: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of each text's first word plus a last entry); fold: A-Z as a-z."""
    start, end, first = words(raw, off)
    return span_hash(prefix(LOWER[raw] if fold else raw), start, end), first


def shingles(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of n words and index of each text's first run; a text of 1 to n-1 words is one run."""
    if not len(h):
        return h, first
    up, _ = powers(n + 1)
    count = np.diff(first)
    runs = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    to = np.concatenate([[0], np.cumsum(runs)])
    begin = np.repeat(first[:-1] - to[:-1], runs) + np.arange(to[-1])
    end_of_text = np.repeat(first[1:], runs)
    out = np.zeros(to[-1], dtype=U64)
    for k in range(n):
        at = begin + k
        ok = at < end_of_text
        out += np.where(ok, h[np.minimum(at, len(h) - 1)], U64(0)) * up[k + 1]
    return mix(out), to
