"""Words, lines and hashes straight from the UTF-8 bytes of an Arrow string column.

Every separator of the word pattern ``[^\\x20\\x09-\\x0D]+`` is one ASCII byte and no byte of a longer UTF-8
sequence can equal it, so words can be cut on bytes without decoding.  All work is in numpy, over slices of
bounded size; a document is never split between slices.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
LONG_WORD = 256  # bytes, from which on words are hashed one by one
U64 = np.uint64
BASE = 0x5851F42D4C957F2D  # odd
MASK = (1 << 64) - 1

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_SOME = (U64(1) << (U64(8) * np.arange(8, dtype=U64))) - U64(1)  # masks of the low 0 .. 7 bytes
_LOW = np.append(_SOME, ~U64(0))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """Keyed 64-bit hashes of data[start:end], eight bytes at a time through a bijection that is not linear.

    Spans of one length of up to eight bytes never share a hash; others do by chance, and another seed parts them.
    """
    size = end - start
    out = mix(size.astype(U64) * U64(BASE) + U64((seed * 0x9E3779B97F4A7C15 + 0x3C6EF372FE94F82B) & MASK))
    if not len(start):
        return out
    eight = np.ndarray(len(data) + 1, "<u8", np.concatenate((data, np.zeros(8, np.uint8))), strides=(1,))
    at, left, place = np.arange(len(start)), size, start
    for _ in range(LONG_WORD // 8):
        out[at] = mix(out[at] ^ (eight[place] & _LOW[np.minimum(left, 8)]))
        more = np.flatnonzero(left > 8)
        if not len(more):
            return out
        at, left, place = at[more], left[more] - 8, place[more] + 8
    key = seed.to_bytes(8, "little")
    for i in at.tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, key=key).digest(), "little")
    return out


@dataclass
class Words:
    """Words of a run of documents: byte spans into data, hash, and the document each is of.

    ``first[d]`` is the index of document d's first word; it has one entry more than there are documents.
    """

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def column(batch: pa.RecordBatch | pa.Table, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as the empty text."""
    col = batch.column(batch.schema.get_field_index(name))
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        col = pa.concat_arrays(col.chunks) if isinstance(col, pa.ChunkedArray) else col
    if col.type == pa.null():
        col = col.cast(pa.string())
    if col.null_count:
        col = pc.fill_null(col, "")
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    _, where, data = col.buffers()
    if len(col) == 0 or where is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    offsets = np.frombuffer(where, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def slices(data: np.ndarray, offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole documents with at most ``limit`` bytes, or one longer document: (from, to, bytes, offsets from 0)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, i + 65536)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray, seed: int = 0) -> Words:
    inside = ~IS_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(inside & np.concatenate(([True], ~inside[:-1])) | inside & edge[:-1]) if len(data) else np.zeros(0, np.int64)
    end = np.flatnonzero(inside & (np.concatenate((~inside[1:], [True])) | edge[1:])) + 1 if len(data) else np.zeros(0, np.int64)
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(data, offsets, start, end, span_hashes(data, start, end, seed), doc, first)


def words_of(batch: pa.RecordBatch, name: str, seed: int = 0) -> Words:
    """The words of a text column."""
    data, offsets = column(batch, name)
    return words(data[offsets[0] : offsets[-1]], offsets - offsets[0], seed)


def release() -> None:
    """Give freed memory back to the system: workers stay between tasks, and what they hold counts for their executor."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def gram_hashes(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of k neighbours of h (positions are those of the first)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.full(n, (seed * 0x9E3779B97F4A7C15 + k) & MASK, U64)
    for j in range(k):
        out = out * U64(BASE) + h[j : n + j]
    return mix(out)


def join_words(w: Words, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The kept words of each document joined by one space: bytes and offsets of the new texts."""
    n_docs = len(w.offsets) - 1
    keep = np.ones(len(w.start), bool) if keep is None else keep
    start, end, doc = w.start[keep], w.end[keep], w.doc[keep]
    if not len(start):
        return np.zeros(0, np.uint8), np.zeros(n_docs + 1, np.int64)
    lead = np.concatenate(([False], doc[1:] == doc[:-1]))  # a space goes before all but a document's first
    flips = np.zeros(len(w.data) + 1, np.int8)
    flips[start - lead] += 1
    np.add.at(flips, end, -1)
    mask = np.cumsum(flips[:-1], dtype=np.int8).astype(bool)
    data = w.data.copy()
    data[(start - 1)[lead]] = 0x20
    sizes = np.bincount(doc, end - start + lead, n_docs).astype(np.int64)
    return data[mask], np.concatenate(([0], np.cumsum(sizes)))
