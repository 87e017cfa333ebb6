"""Array kernels shared by the operators: text batches as bytes, words as slices, fingerprints.

Words are fingerprinted block by block through a bijective mixer (no sum of powers, so no words of a regular structure
collide). The rolling polynomial modulo 2^64 serves only where equal fingerprints of different bytes cost time and
never change a result: picking window minimisers, proposing candidates, finding cache entries that are checked.

Every kernel works on one bounded chunk of whole texts laid end to end, so its memory is a constant times
the chunk, whatever the batch holds. A single text longer than a chunk makes a chunk of its own.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
#: Texts are processed in chunks of about this many UTF-8 bytes.
CHUNK_BYTES = 512 << 10
#: Longer words are hashed one by one.
LONG_WORD = 64

_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_BYTE_KEYS = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^i and P^-i modulo 2^64 for i below n; the tables grow with the longest chunk seen."""
    if len(_powers.get("p", ())) < n:
        size = max(n, CHUNK_BYTES + (1 << 17))
        for name, base in (("p", _P), ("q", _P_INV)):
            step = np.full(size, base, dtype=U64)
            step[0] = 1
            _powers[name] = np.cumprod(step, dtype=U64)
    return _powers["p"], _powers["q"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def blocks8(data: np.ndarray) -> np.ndarray:
    """At each byte the eight bytes from there as one little-endian word, zeros after the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def word_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
    """Fingerprints of the slices [start, end): eight bytes a round through the mixer, their length first."""
    size = end - start
    h = mix(size.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(salt))
    if not len(h):
        return h
    at = blocks8(data)
    live = np.arange(len(h))
    for k in range(0, LONG_WORD, 8):
        live = live[size[live] > k]
        if not len(live):
            break
        part = at[start[live] + k] & LOW_BYTES[np.minimum(size[live] - k, 8)]
        h[live] = mix((h[live] ^ part) + U64(0xD6E8FEB86659FD93))
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes(), salt)
    return h


def digests128(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128-bit fingerprints of the slices, an array of two int64 columns."""
    view, digest = memoryview(np.ascontiguousarray(data)), xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(view[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)]), np.int64).reshape(-1, 2)


def give_back() -> None:
    """Free memory of this worker returns to the system, which other workers need."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        return


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """F with F[j] - F[i] = sum of key(byte) * P^position over [i, j)."""
    p, _ = powers(len(data) + 1)
    out = np.empty(len(data) + 1, dtype=U64)
    out[0] = 0
    np.cumsum(_BYTE_KEYS[data] * p[: len(data)], out=out[1:])
    return out


def slice_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Fingerprints of the slices [start, end), equal for equal bytes wherever they stand; see above for what they are not."""
    _, q = powers(len(sums))
    return mix((sums[end] - sums[start]) * q[start] + (end - start).astype(U64))


def string_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One contiguous large_string array without nulls: null becomes the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type) else b"")
    return column


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts of a string array end to end, and the n + 1 offsets."""
    column = string_array(column)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[off[0] : off[-1]], off - off[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES):
    """(first row, data, offsets) of runs of whole texts of about `limit` bytes."""
    data, off = raw(column)
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield i, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def word_slices(data: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes, never across texts, and for each text its first word's index."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    m = is_word[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = m[:-1]
    inner = off[(off < n)]
    before[inner] = False
    starts = np.flatnonzero(m & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = m[1:]
    after[off[off > 0] - 1] = False
    ends = np.flatnonzero(m & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes kept."""
    return _LOWER[data]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 booleans, false within the inclusive ranges."""
    table = np.ones(256, bool)
    for lo, hi in ranges:
        table[lo : hi + 1] = False
    return table


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of w values: prefix and suffix minima within blocks of w."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    if w == 1:
        return x
    top = np.iinfo(x.dtype).max
    blocks = -(-len(x) // w)
    padded = np.full(blocks * w, top, x.dtype)
    padded[: len(x)] = x
    grid = padded.reshape(blocks, w)
    left = np.minimum.accumulate(grid, axis=1).reshape(-1)
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def sliding_max(x: np.ndarray, w: int) -> np.ndarray:
    """Maximum of each window of w values."""
    return ~sliding_min(~x, w)
