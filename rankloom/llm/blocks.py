"""Arrow text columns as numpy arrays: slabs of bounded size, word positions and 64-bit word hashes.

Everything here works on whole texts.  A slab holds about ``SLAB_BYTES`` of text (a longer text has a slab of its
own), which bounds the memory of a Python worker whatever the size of an Arrow batch.
Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLAB_BYTES = 1 << 20

_U64 = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers (the splitmix64 finaliser)."""
    x = x ^ (x >> _U64(30))
    x = x * _U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U64(27))
    x = x * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, _U64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """base**0, base**1, ... modulo 2**64, made once and lengthened on demand."""

    def __init__(self, base: int):
        self.base, self.have = base, _powers(base, 1 << 12)

    def __call__(self, n: int) -> np.ndarray:
        if n > len(self.have):
            self.have = _powers(self.base, max(n, 2 * len(self.have)))
        return self.have[:n]


_pow, _inv = _Powers(_P), _Powers(_PINV)
#: One random value for each byte, so that the sums below behave as random ones do.
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _U64(0xD1342543DE82EF95))
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Slab:
    """Some consecutive texts of a batch: ``data`` are their bytes, text i is data[offsets[i]:offsets[i+1]]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first = data, offsets, first

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def words(self) -> Words:
        return Words(self)


class Words:
    """Maximal runs of bytes other than white space (0x20, 0x09-0x0D); no word goes over the end of a text.

    starts, ends: byte positions in the slab.  bounds: text i has the words bounds[i]:bounds[i+1].
    """

    def __init__(self, slab: Slab):
        self.slab = slab
        inside = ~_SPACE[slab.data]
        edge = np.ones(len(inside) + 1, dtype=bool)
        edge[1:-1] = inside[1:] != inside[:-1]
        edge[slab.offsets] = True
        at = np.flatnonzero(edge)
        begin, end = at[:-1], at[1:]
        keep = inside[begin] if len(begin) else np.zeros(0, dtype=bool)
        self.starts, self.ends = begin[keep], end[keep]
        self.bounds = np.searchsorted(self.starts, slab.offsets)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def doc(self) -> np.ndarray:
        """For each word, the place of its text in the slab."""
        return np.repeat(np.arange(len(self.slab)), self.counts)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word's bytes (lower: of A-Z as a-z)."""
        return span_hashes(self.slab.data, self.starts, self.ends, lower)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each span of bytes, from prefix sums: the cost doesn't depend on the spans' lengths."""
    n = len(data)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * _pow(n), out=sums[1:])
    h = (sums[ends] - sums[starts]) * _inv(n + 1)[starts]
    return mix64(h + (ends - starts).astype(np.uint64) * _U64(0xA0761D6478BD642F))


def grams(hashes: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hashes of the n-word windows that start at each word; the last n-1 have no such window and are left out."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(m, _U64(seed))
    for i in range(n):
        out = out * _U64(0xC2B2AE3D27D4EB4F) + hashes[i : i + m]
        if i % 2:
            out = out ^ (out >> _U64(29))
    return mix64(out)


def window_bounds(bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts of windows of n words that stay within their text, the text of each)."""
    counts = np.maximum(np.diff(bounds) - n + 1, 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    return ranges(bounds[:-1], counts), doc


def ranges(begin: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """begin[0], begin[0]+1, ... (counts[0] of them), begin[1], ..."""
    counts = np.asarray(counts, dtype=np.int64)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    shift = np.repeat(np.asarray(begin, dtype=np.int64) - (np.cumsum(counts) - counts), counts)
    return np.arange(total, dtype=np.int64) + shift


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if pa.types.is_null(texts.type):
        texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1] if offs else np.zeros(1, np.int64)
    return np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8), offsets.astype(np.int64)


def slabs(texts: pa.Array, most: int = SLAB_BYTES) -> Iterator[Slab]:
    """The texts of an Arrow column as slabs of up to ``most`` bytes, in order."""
    if not len(texts):
        return
    data, offsets = _buffers(texts)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        j = min(j, len(texts))
        yield Slab(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], i)
        i = j


def of_texts(texts: list[str | None]) -> Slab:
    """One slab with all of a few texts, for tests and small uses."""
    return next(slabs(pa.array(texts, pa.string()), 1 << 62), Slab(np.zeros(0, np.uint8), np.zeros(1, np.int64), 0))


def crc32_of_ids(ids) -> np.ndarray:
    """zlib's crc32 of each id as decimal text; null counts as the empty text."""
    from zlib import crc32

    return np.fromiter((crc32(b"" if i is None else str(i).encode()) for i in ids), dtype=np.int64)
