"""Vectorised byte-level views of Arrow text columns: words, word hashes, rolling hashes.

Every function works on whole texts; only the number of texts held at once is bounded.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one numpy pass holds (a longer single text forms a pass of its own).
CHUNK_BYTES = 2 << 20
#: An odd multiplier, so that it has an inverse modulo 2**64.
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)

_rng = np.random.default_rng(20240229)
BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True

_powers: dict[str, np.ndarray] = {}


def tidy() -> None:
    """Give back to the system what earlier batches took: workers outlive tasks, and their freed memory adds up."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidied(run: Callable) -> Callable:
    """``run`` over batches, with ``tidy`` at its end."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            tidy()

    return out


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n (kept up to 4 Mi, larger ones are made anew)."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, CHUNK_BYTES + 1)
        up, down = np.full(size, _P, np.uint64), np.full(size, _P_INV, np.uint64)
        up[0] = down[0] = 1
        up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        if size > 4 << 20:
            return up[:n], down[:n]
        _powers["up"], _powers["down"] = up, down
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def text_column(batch: pa.RecordBatch, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as an empty text."""
    col = batch.column(batch.schema.get_field_index(name))
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    kind = np.int64 if wide else np.int32
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offs, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``limit`` bytes each (or one row)."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def prefix_sums(data: np.ndarray, lower: bool = False) -> np.ndarray:
    """S with S[i] = sum of code(data[j]) * P**j over j < i, modulo 2**64."""
    up, _ = powers(len(data) + 1)
    code = BYTE_CODE[LOWER] if lower else BYTE_CODE
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(code[data] * up[: len(data)], out=out[1:])
    return out


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every run of bytes that aren't space, tab or line ends; none crosses rows."""
    ink = ~IS_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty_like(ink)
    if len(ink):
        before[0] = False
        before[1:] = ink[:-1]
    starts = np.flatnonzero(ink & (~before | edge[:-1]))
    after = np.empty_like(ink)
    if len(ink):
        after[-1] = False
        after[:-1] = ink[1:]
    ends = np.flatnonzero(ink & (~after | edge[1:])) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, rows


def word_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums))
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix(h ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def shingles(hashes: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every run of ``width`` words of one row; a shorter row forms one run of all its words."""
    n = len(hashes)
    step = np.uint64(0xC2B2AE3D27D4EB4F)
    acc = np.zeros(max(n - width + 1, 0), np.uint64)
    for k in range(width):
        acc = acc * step + hashes[k : k + len(acc)]
    ok = rows[: len(acc)] == rows[width - 1 :] if len(acc) else np.zeros(0, bool)
    out, at = mix(acc[ok]), rows[: len(acc)][ok]
    if n:
        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        count = np.diff(np.r_[first, n])
        short = np.flatnonzero(count < width)
        if len(short):
            extra = []
            for k in short:
                h = np.uint64(count[k])
                with np.errstate(over="ignore"):
                    for x in hashes[first[k] : first[k] + count[k]]:
                        h = h * step + x
                extra.append(h)
            out = np.r_[out, mix(np.array(extra, np.uint64) ^ np.uint64(0xA5A5A5A5A5A5A5A5))]
            at = np.r_[at, rows[first[short]]]
            order = np.argsort(at, kind="stable")
            out, at = out[order], at[order]
    return out, at


def shingle_sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct lower-case shingle hashes of each row), chunk by chunk."""
    data, offsets = text_column(batch)
    for a, b in chunks(offsets):
        part, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        s, e, r = words(part, off)
        h, at = shingles(word_hashes(prefix_sums(part, lower=True), s, e), r, width)
        cut = np.searchsorted(at, np.arange(b - a + 1))
        yield a, [np.unique(h[cut[i] : cut[i + 1]]) for i in range(b - a)]
