"""Words and hashes of whole texts, vectorised over the byte buffers of Arrow string columns."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard

try:
    _LIBC = ctypes.CDLL("libc.so.6")
except OSError:  # another C library
    _LIBC = None

#: Words are runs of other bytes than these; all are ASCII, so UTF-8 bytes can be split directly.
BLANKS = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20)
#: The same as a pattern, for Spark SQL and DuckDB.
WORD = r"[^\x20\x09-\x0D]+"
#: Longer words are hashed one by one instead of in the table of powers.
LONG_WORD = 1 << 14
_BLOCK = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(BLANKS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RNG = np.random.default_rng(20240607)
_BYTES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
with np.errstate(over="ignore"):
    _POWERS = np.cumprod(np.full(LONG_WORD, _BASE, dtype=np.uint64))


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over 64 bits."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def buffers(column: pa.Array | pa.ChunkedArray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, null as empty; lower: A-Z in lower case."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32, count=n + 1, offset=column.offset * (8 if wide else 4)).astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    return (_LOWER[data] if lower else data), offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the row it stands in."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    solid = ~_SPACE[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = solid[cuts]
    last[cuts - 1] = solid[cuts - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes, in blocks of bounded memory."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _BLOCK, "right")))
        lengths = ends[i:j] - starts[i:j]
        long = np.flatnonzero(lengths > LONG_WORD)
        if len(long):
            j = i + max(int(long[0]), 1)
            lengths = lengths[: j - i]
            if long[0] == 0:
                out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes())
                i += 1
                continue
        at = np.cumsum(lengths) - lengths
        place = np.arange(int(at[-1] + lengths[-1])) - np.repeat(at, lengths)
        values = _BYTES[data[np.repeat(starts[i:j], lengths) + place]]
        values *= _POWERS[place]
        out[i:j] = mix(np.add.reduceat(values, at) + lengths.astype(np.uint64))
        i = j
    return out


def ngrams(hashes: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words of one row, and the index of each one's first word."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h *= _BASE
        h += hashes[i : i + n]
    at = np.flatnonzero(rows[:n] == rows[k - 1 :])
    return mix(h[at]), at


def shrink(values: np.ndarray) -> bytes:
    """Whole numbers, byte by byte of equal place, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes())


def grow(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view(np.uint64).ravel()


def shrink_sorted(values: np.ndarray) -> bytes:
    """Ascending 64-bit numbers by their steps."""
    return shrink(np.diff(values, prepend=np.uint64(0)))


def grow_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(grow(data), dtype=np.uint64)


def slices(batch: pa.RecordBatch, column: str, most: int = 2 << 20):
    """The batch in pieces of about `most` bytes of text; a longer text is a piece of its own."""
    texts = batch.column(column)
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    ends = np.cumsum(sizes)
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
        yield batch.slice(i, j - i)
        i = j


def release() -> None:
    """Gives unused memory of Arrow's pool and of the C library back, so that idle workers hold little."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)
