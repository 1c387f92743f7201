"""Vectorised text kernels that run inside Arrow tasks.

Every function works on a handful of whole texts laid end to end in one byte
array, so the cost per word is a few numpy passes and memory is bounded by the
chunk (``CHUNK_BYTES``, or one text if that is longer).
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK_BYTES = 1 << 20

_RNG = np.random.Generator(np.random.PCG64(20240607))
BYTE_VALUE = _RNG.integers(1, 1 << 63, 256, dtype=U64) * U64(2) + U64(1)
#: A byte's value keeps the byte itself in its lowest bits, so that it can be read back.
BYTE_VALUE = (BYTE_VALUE & U64(0xFFFFFFFFFFFFFE00)) | (np.arange(256, dtype=U64) << U64(1)) | U64(1)
BASE = int(_RNG.integers(1 << 62, 1 << 63)) * 2 + 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
PIECE = 64
#: A random value for each byte at each place of a piece.
PLACED_BYTE = _RNG.integers(0, 1 << 64, PIECE * 256, dtype=U64)


def byte_of(symbols: np.ndarray) -> np.ndarray:
    """The bytes that BYTE_VALUE has made symbols of."""
    return ((symbols >> U64(1)) & U64(0xFF)).astype(np.uint8)


_codes = np.arange(256)
#: Words between spaces: everything but 0x20 and 0x09-0x0D.
SPACED_WORD = ~((_codes == 0x20) | ((_codes >= 0x09) & (_codes <= 0x0D)))
#: Words of letters and digits: ASCII alphanumerics and all bytes of non-ASCII characters.
PLAIN_WORD = ((_codes >= 0x30) & (_codes <= 0x39)) | ((_codes >= 0x41) & (_codes <= 0x5A)) | ((_codes >= 0x61) & (_codes <= 0x7A)) | (_codes >= 0x80)
LOWER = np.where((_codes >= 0x41) & (_codes <= 0x5A), _codes + 32, _codes).astype(np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_tables: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 … base**(n-1) modulo 2**64, kept for the next call."""
    have = _tables.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        table = np.full(size, base, U64)
        table[0] = 1
        _tables[base] = have = np.multiply.accumulate(table)
    return have[:n]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end, and the n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()).cast(pa.large_binary())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold at most ``limit`` bytes, or one longer text."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def words(data: np.ndarray, offsets: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end byte of each word, and the n + 1 word offsets of the texts.

    A word is a maximal run of bytes for which ``kept`` holds, within one text.
    """
    inside = kept[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    first[edge] = inside[edge]
    edge = offsets[1:][offsets[1:] > 0] - 1
    last[edge] = inside[edge]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each word (or line), none of them empty.

    Each byte counts by a random value of itself and its place in a piece of
    ``PIECE`` bytes, and pieces count by a mixed value of themselves and their
    number: no sum of powers, whose collisions can be written down.
    """
    if not len(starts):
        return np.zeros(0, U64)
    lengths = ends - starts
    pieces = (lengths + (PIECE - 1)) // PIECE
    of, nth = spread(pieces)
    begin = starts[of] + PIECE * nth
    size = np.minimum(ends[of] - begin, PIECE)
    before = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(before, size)
    letters = PLACED_BYTE[(place << 8) | data[place + np.repeat(begin, size)]]
    sums = mix(np.add.reduceat(letters, before) + nth.astype(U64) * U64(0x9E3779B97F4A7C15))
    return mix(np.add.reduceat(sums, np.cumsum(pieces) - pieces) + lengths.astype(U64))


def gram_hashes(symbols: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k symbols from each position on; n - k + 1 values (none if shorter)."""
    n = len(symbols) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    total, done, block, width = None, 0, symbols, 1
    while True:
        if k & width:
            part = block[done : done + n]
            total = part.copy() if total is None else total + part * U64(pow(BASE, done, 1 << 64))
            done += width
        if done == k:
            return mix(total)
        block = block[:-width] + block[width:] * U64(pow(BASE, width, 1 << 64))
        width *= 2


def span_hashes(symbols: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of symbols[begin:end] for each pair, whatever the place; the symbols are mixed hashes, not raw bytes."""
    sums = np.zeros(len(symbols) + 1, U64)
    np.cumsum(symbols * powers(BASE, len(symbols)), out=sums[1:])
    return mix((sums[end] - sums[begin]) * powers(BASE_INVERSE, len(symbols) + 1)[begin] + (end - begin).astype(U64))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum over values[i : i + width]; n - width + 1 values."""
    n, have, low = len(values) - width + 1, 1, values
    if n <= 0:
        return values[:0]
    while 2 * have <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    return np.minimum(low[:n], low[width - have : width - have + n])


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For group sizes: the group of each member and the member's place in its group."""
    group = np.repeat(np.arange(len(counts)), counts)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(counts) - counts, counts)


def winnow(symbols: np.ndarray, bounds: np.ndarray, window: int, k: int) -> dict[str, np.ndarray]:
    """Runs of windows that share a winnowed anchor.

    Each window of ``window`` symbols within one text picks the smallest of its
    k-gram hashes, the leftmost if several tie. The pick follows from the
    window's content alone, so equal windows pick equal anchors wherever they
    stand. Consecutive windows with one anchor form a run: ``doc`` (row),
    ``low`` and ``high`` (first and last window start within the text), ``at``
    (anchor within the text), ``anchor`` (its hash), ``span`` (hash of all the
    k-grams, and so of all the symbols, that the run's windows cover).
    """
    counts = np.maximum(np.diff(bounds) - window + 1, 0)
    none = {name: np.zeros(0, kind) for name, kind in (("doc", np.int64), ("low", np.int64), ("high", np.int64), ("at", np.int64), ("anchor", U64), ("span", U64))}
    if not counts.sum():
        return none
    grams = gram_hashes(symbols, k)
    order = (grams & U64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=U64)
    picked = (sliding_min(order, window - k + 1) & U64(0xFFFFFFFF)).astype(np.int64)
    doc, place = spread(counts)
    start = place + bounds[:-1][doc]
    at = picked[start]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    final = np.append(first[1:], len(at)) - 1
    low, high, at, doc = start[first], start[final], at[first], doc[first]
    base = bounds[:-1][doc]
    return {"doc": doc, "low": low - base, "high": high - base, "at": at - base, "anchor": grams[at], "span": span_hashes(grams, low, high + (window - k + 1))}


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same task, which gives freed memory back at its end: workers wait for the next stage, and the JVM needs it then."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            release = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if release is not None:
                release(0)

    return wrapped


def covered(n: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n places lie in any of the ranges [begin, end)."""
    if not len(begin):
        return np.zeros(n, bool)
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, np.minimum(begin, n), 1)
    np.add.at(steps, np.minimum(end, n), -1)
    return np.cumsum(steps[:-1]) > 0


def planes(values: np.ndarray) -> bytes:
    """Fixed-width values byte plane by byte plane, which block compression shrinks well."""
    width = values.dtype.itemsize
    return np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(-1, width).T).tobytes()


def unplanes(raw: bytes, kind: type) -> np.ndarray:
    """What planes() has written."""
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind).ravel()


class Records:
    """Equal-length numpy columns to and from one binary value."""

    def __init__(self, **kinds: type):
        self.kinds = {name: np.dtype(kind) for name, kind in kinds.items()}
        self.width = sum(kind.itemsize for kind in self.kinds.values())

    def pack(self, columns: dict[str, np.ndarray], rows: slice | np.ndarray = slice(None)) -> bytes:
        return b"".join(planes(columns[name][rows].astype(kind, copy=False)) for name, kind in self.kinds.items())

    def unpack(self, raw: bytes) -> dict[str, np.ndarray]:
        n, at, out = len(raw) // self.width, 0, {}
        for name, kind in self.kinds.items():
            out[name] = unplanes(raw[at : at + n * kind.itemsize], kind)
            at += n * kind.itemsize
        return out

    def unpack_all(self, raws: list[bytes]) -> dict[str, np.ndarray]:
        parts = [self.unpack(raw) for raw in raws]
        return {name: np.concatenate([p[name] for p in parts]) if parts else np.zeros(0, kind) for name, kind in self.kinds.items()}

    def split(self, columns: dict[str, np.ndarray], bucket: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """One packed value for each bucket number, rows in their present order."""
        order = np.argsort(bucket, kind="stable")
        keys, first = np.unique(bucket[order], return_index=True)
        sorted_columns = {name: columns[name][order] for name in self.kinds}
        for key, a, b in zip(keys.tolist(), first.tolist(), [*first[1:].tolist(), len(order)]):
            yield key, self.pack(sorted_columns, slice(a, b))
