"""BPE encoding and decoding by content-defined chunk reuse.

A rolling hash over the last ``WINDOW`` bytes cuts texts into chunks whose borders depend on nearby bytes alone, so that
documents which share a passage share its chunks.  A chunk is encoded once for each worker (``CACHE_BYTES`` bounds what is
kept) and its ids are used again.  A border can fall inside a token, so every join is then repaired: the stretch between
the nearest *seams* on both sides of the border is encoded anew.  A seam is a place where the pre-tokenizer starts a
token whatever surrounds it: a space between a byte that isn't white space and an ASCII letter.  A repair is accepted
when both of its ends are token borders of what it joins; else it grows to the next seams, and to the whole text in the
end.  The result equals one encoding of the whole text, for every text.

Rules for odd rows: a null text is empty and has no ids; texts that hold the string of an added token go to the library
itself; repeated rows give repeated results; other columns pass through untouched.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import _pow, _inv, column, mix64, ranges, slabs, span_hashes
from .runtime import prepare

#: Bytes that decide on a border; borders are 512 bytes apart on average.
WINDOW, MASK = 16, 511
CACHE_BYTES = 64 << 20
#: Fixed value: the pattern by which byte-level BPE of this kind splits texts.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_ROLL = mix64(np.arange(900, 1156, dtype=np.uint64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def _byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in the vocabulary file: printable ones for themselves, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def _seams(data: np.ndarray, hard: np.ndarray) -> np.ndarray:
    """For each place whether the pre-tokenizer starts a token there in any case; the places in ``hard`` count too."""
    seam = np.zeros(len(data) + 1, dtype=bool)
    if len(data) > 2:
        seam[1:-2] = (data[1:-1] == 0x20) & ~_SPACE[data[:-2]] & _LETTER[data[2:]]
        inner = hard[(hard > 0) & (hard < len(data))]
        seam[inner - 1] = False  # its letter is in the next text
    seam[hard] = True
    return seam


class Memo:
    """Ids by 64-bit key, in sorted arrays."""

    MOST = 1 << 20

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = self.n = np.zeros(0, np.int64)
        self.store, self.used = np.zeros(1 << 16, np.uint32), 0

    @property
    def ids(self) -> np.ndarray:
        return self.store

    def full(self) -> bool:
        return len(self.keys) > self.MOST

    def has(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys), dtype=bool)
        return self.keys[np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)] == keys

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.searchsorted(self.keys, keys)
        return self.at[i], self.n[i]

    def add(self, keys: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        need = self.used + len(ids)
        if need > len(self.store):
            self.store = np.concatenate([self.store[: self.used], np.zeros(2 * need - self.used, np.uint32)])
        self.store[self.used : need] = ids
        order = np.argsort(keys)
        place = np.searchsorted(self.keys, keys[order])
        at = self.used + np.cumsum(n) - n
        self.keys, self.at, self.n = np.insert(self.keys, place, keys[order]), np.insert(self.at, place, at[order]), np.insert(self.n, place, n[order])
        self.used = need


class Codec:
    """Encodes and decodes batches of texts with one vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = _byte_alphabet()
        self.added = {t["content"].encode(): t["id"] for t in spec.get("added_tokens", [])}
        vocab = {bytes(alphabet[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s.encode() not in self.added}
        size = 1 + max([*vocab.values(), *self.added.values()])
        pieces = [b""] * size
        for s, i in [*vocab.items(), *self.added.items()]:
            pieces[i] = s
        self.lengths = np.array([len(p) for p in pieces], dtype=np.int64)
        self.bytes = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        self.at = np.cumsum(self.lengths) - self.lengths
        self.fast = self._ranked(spec, vocab, alphabet)
        self.cache: dict[bytes, np.ndarray] = {}
        self.cached = 0
        self.memo = Memo()

    def _ranked(self, spec: dict, vocab: dict[bytes, int], alphabet: dict[str, int]):
        """An encoder by ranks, if the ids follow the order of the merges and the splits are the usual ones; else None."""
        import tiktoken

        pre = spec.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
        merged = [bytes(alphabet[c] for c in "".join(m if isinstance(m, list) else m.split(" "))) for m in spec["model"]["merges"]]
        ids = [vocab.get(m, -1) for m in merged]
        if not plain or spec["model"].get("ignore_merges") or any(a >= b for a, b in zip(ids, ids[1:])) or any(i < 0 for i in ids) or len(vocab) != len(merged) + 256:
            return None
        return tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=vocab, special_tokens={})

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _pieces(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of the stretches data[0:ends[0]], data[ends[0]:ends[1]], ..., each encoded by itself.

        Between seams a stretch falls into pieces whose ids don't depend on what is beside them.  What each piece gave is
        kept by a 64-bit hash; the pieces not yet seen are encoded in one call.  Decoding the result and comparing it with
        the bytes rules out that two pieces shared a hash."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(ends) + 1, np.int64)
        hard = np.concatenate([[0], ends])
        edge = np.flatnonzero(_seams(data, hard))
        begin, end = edge[:-1], edge[1:]
        begin, end = begin[end > begin], end[end > begin]
        keys = span_hashes(data, begin, end)
        _, where, back = np.unique(keys, return_index=True, return_inverse=True)
        new = where[~self.memo.has(keys[where])]
        if len(new):
            if self.memo.full():
                self.memo.clear()
                new = where
            self._learn(data, keys[new], begin[new], end[new])
        at, n = self.memo.find(keys[where])
        at, n = at[back], n[back]
        ids = self.memo.ids[ranges(at, n)]
        lengths = self.lengths[ids]
        if not np.array_equal(self.bytes[ranges(self.at[ids], lengths)], data):
            got = [self._plain(data[a:b].tobytes()) for a, b in zip(hard[:-1].tolist(), hard[1:].tolist())]
            return np.concatenate([*got, np.zeros(0, np.uint32)]), np.cumsum([0, *map(len, got)])
        return ids, np.searchsorted(np.concatenate([[0], np.cumsum(lengths)]), hard)

    def _plain(self, raw: bytes) -> np.ndarray:
        return np.array(self.fast.encode_ordinary(raw.decode("utf-8")), dtype=np.uint32)

    def _learn(self, data, keys, begin, end) -> None:
        """Encodes unseen pieces: those that begin at a seam on end in one call, the others one by one."""
        joined = (data[begin] == 0x20) & (end - begin > 1)
        joined &= _LETTER[data[np.minimum(begin + 1, len(data) - 1)]] & ~_SPACE[data[end - 1]]
        order = np.concatenate([np.flatnonzero(joined), np.flatnonzero(~joined)])
        k, begin, end = int(joined.sum()), begin[order], end[order]
        raw = data[ranges(begin[:k], (end - begin)[:k])].tobytes()
        got = [self._plain(raw)] if k else []
        sums = np.concatenate([[0], np.cumsum(self.lengths[got[0]])]) if k else np.zeros(1, np.int64)
        bounds = np.searchsorted(sums, np.concatenate([[0], np.cumsum((end - begin)[:k])]))
        single = [self._plain(data[a:b].tobytes()) for a, b in zip(begin[k:].tolist(), end[k:].tolist())]
        self.memo.add(keys[order], np.concatenate([*got, *single]), np.concatenate([np.diff(bounds), [len(x) for x in single]]).astype(np.int64))

    def encode(self, slab, chunks: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts of the slab on end, bounds: text i has the ids bounds[i]:bounds[i+1]).

        chunks: by chunk reuse; else straight by the pieces between seams, which gives the same ids."""
        coded = self._chunked if chunks else lambda s: self._pieces(s.data, s.offsets[1:])
        odd = [i for i in range(len(slab)) if any(a in slab.text(i) for a in self.added)] if any(a in slab.data.tobytes() for a in self.added) else []
        if self.fast is None or odd:
            some = range(len(slab)) if self.fast is None else odd
            own = {i: self.whole(slab.text(i).decode("utf-8", "replace")) for i in some}
            ids, bounds = coded(slab) if self.fast is not None else (np.zeros(0, np.uint32), np.zeros(len(slab) + 1, np.int64))
            out = [own[i] if i in own else ids[bounds[i] : bounds[i + 1]] for i in range(len(slab))]
            return np.concatenate([*out, np.zeros(0, np.uint32)]), np.cumsum([0, *map(len, out)])
        return coded(slab)

    def _chunked(self, slab) -> tuple[np.ndarray, np.ndarray]:
        data, n = slab.data, len(slab.data)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(slab) + 1, np.int64)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_ROLL[data] * _pow(n), out=sums[1:])
        roll = np.zeros(n, dtype=np.uint64)
        if n > WINDOW:
            roll[WINDOW:] = mix64((sums[WINDOW:-1] - sums[: n - WINDOW]) * _inv(n)[: n - WINDOW])
        cut = (roll & np.uint64(MASK)) == np.uint64(1)
        cut &= (data & 0xC0) != 0x80  # only between characters
        edge = np.union1d(np.flatnonzero(cut), slab.offsets)
        raw = data.tobytes()
        ids = self._reused(raw, edge)
        starts = np.zeros(len(ids) + 1, dtype=np.int64)
        np.cumsum(self.lengths[ids], out=starts[1:])
        inner = np.setdiff1d(edge, slab.offsets, assume_unique=False)
        if len(inner):
            ids, starts = self._repair(slab, raw, ids, starts, inner)
        return ids, np.searchsorted(starts, slab.offsets)

    def _reused(self, raw: bytes, edge: np.ndarray) -> np.ndarray:
        """The ids of the chunks between edges, each as if it stood alone: from the cache, or encoded once now."""
        chunks = [raw[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()) if b > a]
        new = list({c: None for c in chunks if c not in self.cache})
        if self.cached > CACHE_BYTES:
            self.cache.clear()
            self.cached, new = 0, list(dict.fromkeys(chunks))
        ids, bounds = self._pieces(np.frombuffer(b"".join(new), dtype=np.uint8), np.cumsum([len(c) for c in new], dtype=np.int64)) if new else (None, [])
        for i, c in enumerate(new):
            self.cache[c] = ids[bounds[i] : bounds[i + 1]].copy()
            self.cached += 3 * len(c) + 200
        return np.concatenate([self.cache[c] for c in chunks])

    def _repair(self, slab, raw: bytes, ids, starts, joins):
        data, n = slab.data, len(slab.data)
        seams = np.flatnonzero(_seams(data, slab.offsets))
        hard = np.zeros(len(seams), dtype=bool)
        hard[np.searchsorted(seams, slab.offsets)] = True
        lo = np.searchsorted(seams, joins, side="left") - 1
        hi = np.searchsorted(seams, joins, side="right")
        # A stretch ends where what is beside it has a token border; ends of texts always do.
        border = lambda at: hard[at] | (starts[np.minimum(np.searchsorted(starts, seams[at]), len(starts) - 1)] == seams[at])
        while len(bad := np.flatnonzero(~border(lo))):
            lo[bad] -= 1
        while len(bad := np.flatnonzero(~border(hi))):
            hi[bad] += 1
        first = np.ones(len(lo), dtype=bool)
        reach = np.maximum.accumulate(hi)
        first[1:] = lo[1:] >= reach[:-1]
        group = np.flatnonzero(first)
        a, b = seams[lo[group]], seams[reach[np.append(group[1:], len(lo)) - 1]]
        anew, bounds = self._pieces(data[ranges(a, b - a)], np.cumsum(b - a))
        out, last = [], 0
        for k, (i, j) in enumerate(zip(np.searchsorted(starts, a).tolist(), np.searchsorted(starts, b).tolist())):
            out += [ids[last:i], anew[bounds[k] : bounds[k + 1]]]
            last = j
        ids = np.concatenate([*out, ids[last:]])
        starts = np.zeros(len(ids) + 1, dtype=np.int64)
        np.cumsum(self.lengths[ids], out=starts[1:])
        return ids, starts

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of some ids; as text, what isn't UTF-8 becomes U+FFFD."""
        raw = self.bytes[ranges(self.at[ids], self.lengths[ids])].tobytes()
        return raw.decode("utf-8", "replace").encode()


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One for each worker process and vocabulary."""
    return Codec(path)


def encoded_slabs(batch: pa.RecordBatch, text: str, path: str, chunks: bool = True) -> Iterator[tuple]:
    """(first row, number of rows, ids, bounds) of each slab of a batch."""
    c = codec(path)
    for s in slabs(column(batch, text)):
        ids, bounds = c.encode(s, chunks)
        yield s.first, len(s), ids, bounds


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Adds a column with each whole text's ids (array<int>)."""
    schema = T.StructType([*(f for f in docs.schema.fields if f.name != out), T.StructField(out, T.ArrayType(T.IntegerType()))])
    names = [f.name for f in schema.fields[:-1]]
    prepare(docs.sparkSession)

    def run(batches):
        for batch in batches:
            got = list(encoded_slabs(batch, text, path))
            ids = np.concatenate([np.zeros(0, np.uint32), *(g[2] for g in got)]).astype(np.int32)
            sizes = np.concatenate([np.zeros(0, np.int64), *(np.diff(g[3]) for g in got)])
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(column(batch, x) for x in names), pa.ListArray.from_arrays(offsets, ids)], names=[*names, out])

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds a column with the text of each row's ids; null ids count as none."""
    schema = T.StructType([*(f for f in rows.schema.fields if f.name != out), T.StructField(out, T.StringType())])
    names = [f.name for f in schema.fields[:-1]]
    prepare(rows.sparkSession)

    def run(batches):
        c = codec(path)
        for batch in batches:
            texts = [c.decode(np.array(x or [], dtype=np.int64)).decode() for x in column(batch, ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(column(batch, x) for x in names), pa.array(texts, pa.string())], names=[*names, out])

    return rows.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A digest of ids and decoded text for each row: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Ids go into their hash as little-endian unsigned 32-bit integers.  Nothing but digests leaves the workers."""
    prepare(docs.sparkSession)

    def run(batches):
        c = codec(path)
        for batch in batches:
            n, a, b = [], [], []
            for _, count, ids, bounds in encoded_slabs(batch, text, path):
                for i in range(count):
                    own = ids[bounds[i] : bounds[i + 1]]
                    n.append(len(own))
                    a.append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest())
                    b.append(hashlib.sha256(c.decode(own)).hexdigest())
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias(text)).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def crc(ids: np.ndarray) -> int:
    return crc32(ids.astype("<u4").tobytes())
