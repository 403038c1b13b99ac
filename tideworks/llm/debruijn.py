"""Substring dedup by compaction of repeated token k-mers.

Documents are sorted by doc_id and cut into slices, which are written once as Arrow batches.  The k-mers (windows of k
words) of a slice are edges of a de Bruijn graph; each distinct one is sent once, with its place, to the bucket that
its hash falls in, so no edge, however common, sends more than one record a slice, and buckets are even.  A bucket
joins equal edges: their source is the first in order of slices and places, which is that of the least document.  The
sources go back to the slices, where neighbouring edges with neighbouring sources are joined end to start into paths
without a branch.  At last a slice meets its paths, and as a source the spans that others take from it: both sides
digest the same words, and where digests differ, all is done again under another hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideworks.llm import textbytes as tb
from tideworks.llm.shared import batch_of, cuts_of, pack, pieces, read_rows, sliced, stored, unpack

SLICE = 3 << 20
BUCKET_BYTES = 6 << 20
PIECE = 32  # words of a source that one digest covers at most
EDGES = "bucket bigint, slice bigint, gaps binary, hashes binary, first_id bigint, last_id bigint, first_end bigint, last_begin bigint, source binary, sizes binary"
SOURCES = "slice bigint, places binary, sizes binary, src_slice binary, source binary"
PATHS = "slice bigint, start bigint, n bigint, src_slice bigint, src_start bigint"
PROOFS = "src_slice bigint, src_at bigint, words bigint, digest binary"


def _runs(follows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of maximal runs; follows[i] says that item i+1 continues item i."""
    start = np.flatnonzero(np.concatenate(([True], ~follows)))
    return start, np.diff(np.concatenate((start, [len(follows) + 1])))


def _columns(docs: DataFrame) -> list[Column]:
    """doc_id as a number, then every column of docs by its place, so that no name clashes."""
    return [F.col("doc_id").cast("long").alias("id"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]]


def ordered_slices(docs: DataFrame, limit: int = SLICE) -> DataFrame:
    """Slices by ascending doc_id, so that their numbers ascend with it; null ids come first."""
    ordered = docs.select(*_columns(docs)).repartitionByRange("id").sortWithinPartitions("id")
    return sliced(ordered, f"c{docs.columns.index('text')}", limit)


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """doc_ids, and which are not null."""
    return pc.fill_null(batch.column(0), 0).to_numpy(zero_copy_only=False), pc.is_valid(batch.column(0)).to_numpy(zero_copy_only=False)


def _edges(number: int, batch: pa.RecordBatch, text: str, k: int, seed: int, bits: int) -> list[tuple]:
    """Rows of EDGES of a slice: by bucket the places of its edges, of each in the least document that has it; and, as one row without hashes, paths of edges that a smaller document of the slice has."""
    w = tb.words_of(batch, text, seed)
    if len(w.start) < k:
        return []
    ids, named = _ids(batch)
    n = len(w.start) - k + 1
    at = np.flatnonzero((w.doc[:n] == w.doc[k - 1 :]) & named[w.doc[:n]])
    if not len(at):
        return []
    edge = tb.gram_hashes(w.hash, k, seed)
    order = at[np.argsort(edge[at], kind="stable")]
    new = np.concatenate(([True], edge[order][1:] != edge[order][:-1]))
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    later = ids[w.doc[order]] > ids[w.doc[head]]
    rows = []
    own = w.doc[at]
    first_end = int(at[ids[own] == ids[own[0]]][-1]) + 1
    last_begin = int(at[ids[own] == ids[own[-1]]][0])
    bounds = int(ids[own[0]]), int(ids[own[-1]]), first_end, last_begin
    if later.any():
        by = np.argsort(order[later])
        place, source = order[later][by], head[later][by]
        first, size = _runs((np.diff(place) == 1) & (np.diff(source) == 1))
        rows.append((number % (1 << bits), number, pack(np.diff(place[first], prepend=0)), None, *bounds, pack(source[first]), pack(size)))
    place = np.sort(order[~later])
    one, two = edge[place], tb.gram_hashes(w.hash, k, ~seed)[place]
    bucket = (one >> tb.U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(one), np.int64)
    sent = (one << tb.U64(bits)) | (two & tb.U64((1 << bits) - 1))
    by = np.argsort(bucket, kind="stable")
    for lo, hi in cuts_of(bucket[by]):
        own = by[lo:hi]
        rows.append((int(bucket[own[0]]), number, pack(np.diff(place[own], prepend=0)), sent[own].tobytes(), *bounds, None, None))
    return rows


def _emit(text: str, k: int, seed: int, bits: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if rows := _edges(number, read_rows(raw.as_py()), text, k, seed, bits):
                    yield batch_of(EDGES, rows)
                tb.release()

    return emit


def _sources(table: pa.Table) -> pa.Table:
    """Of one bucket: for each slice the places of edges that an earlier document has, and where it has them."""
    rows = sorted(table.to_pylist(), key=lambda r: r["slice"])
    out = [(r["slice"], pack(np.cumsum(unpack(r["gaps"]))), r["sizes"], pack(np.array([r["slice"]])), r["source"]) for r in rows if r["hashes"] is None]
    rows = [r for r in rows if r["hashes"] is not None]
    if rows:
        edge = np.concatenate([np.frombuffer(r["hashes"], np.uint64) for r in rows])
        place = [np.cumsum(unpack(r["gaps"])) for r in rows]
        row = np.repeat(np.arange(len(rows)), [len(x) for x in place])
        place = np.concatenate(place)
        by = np.argsort(edge, kind="stable")  # within an edge by slice
        new = np.concatenate(([True], edge[by][1:] != edge[by][:-1]))
        head = np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))[~new]
        mine, theirs = by[~new], by[head]
        if len(mine):
            first_id, last_id, first_end, last_begin = (np.array([r[c] for r in rows], np.int64) for c in ("first_id", "last_id", "first_end", "last_begin"))
            # Of one slice only one doc_id sends an edge, and slices can share a doc_id only as the last of one and the first of the other.
            ends = place[theirs] >= last_begin[row[theirs]]
            same = ends & (place[mine] < first_end[row[mine]]) & (last_id[row[theirs]] == first_id[row[mine]])
            same |= row[mine] == row[theirs]
            mine, theirs = mine[~same], theirs[~same]
        inner = np.lexsort((place[mine], row[mine]))
        mine, theirs = mine[inner], theirs[inner]
        numbers = np.array([r["slice"] for r in rows], np.int64)
        for lo, hi in cuts_of(row[mine]):
            s = theirs[lo:hi]
            out.append((rows[int(row[mine[lo]])]["slice"], pack(place[mine[lo:hi]]), None, pack(numbers[row[s]]), pack(place[s])))
    return pa.Table.from_batches([batch_of(SOURCES, out)])


def _paths(table: pa.Table) -> pa.Table:
    """Of one slice: edges joined to the next where their sources are neighbours as well."""
    rows = table.to_pylist()
    whole = [r for r in rows if r["sizes"] is not None]
    rows = [r for r in rows if r["sizes"] is None]
    empty = np.zeros(0, np.int64)
    parts = [tuple(unpack(r[c]) for c in ("places", "src_slice", "source")) for r in rows] or [(empty,) * 3]
    place, src, source = map(np.concatenate, zip(*parts, strict=True))
    by = np.argsort(place)
    place, src, source = place[by], src[by], source[by]
    start = size = empty
    if len(place):
        start, size = _runs((np.diff(place) == 1) & (np.diff(src) == 0) & (np.diff(source) == 1))
    columns = [place[start], size, src[start], source[start]]
    for r in whole:
        own = [unpack(r["places"]), unpack(r["sizes"]), unpack(r["src_slice"]), unpack(r["source"])]
        own[2] = np.full(len(own[0]), own[2][0])
        columns = [np.concatenate(x) for x in zip(columns, own, strict=True)]
    number = table.column("slice")[0].as_py()
    return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in (np.full(len(columns[0]), number), *columns)], names=[x.split()[0] for x in PATHS.split(", ")])


def covered_paths(slices: DataFrame, text: str, buckets: int, k: int = 13, seed: int = 1) -> DataFrame:
    """Compacted paths of windows that also start in a document with a smaller doc_id.

    Columns: slice, start and n (windows start .. start+n-1, in words of the slice), and src_slice and src_start of the
    same words in a smaller document.
    """
    bits = max(0, (buckets - 1).bit_length())
    edges = slices.mapInArrow(_emit(text, k, seed, bits), EDGES)
    return stored(edges.groupBy("bucket").applyInArrow(_sources, SOURCES).groupBy("slice").applyInArrow(_paths, PATHS), "paths")


class _Joined:
    """The words of a slice joined by spaces, to digest spans of words of one document."""

    def __init__(self, w: tb.Words):
        data, _ = tb.join_words(w)
        size = w.end - w.start
        step = size + 1
        begin = np.cumsum(step) - step - np.repeat(np.cumsum(w.counts > 0) - (w.counts > 0), w.counts)
        self.bytes, self.begin, self.end = memoryview(np.ascontiguousarray(data)), begin, begin + size

    def digests(self, at: np.ndarray, words: np.ndarray) -> list[bytes]:
        made = hashlib.blake2b
        return [made(self.bytes[a:b], digest_size=16).digest() for a, b in zip(self.begin[at].tolist(), self.end[at + words - 1].tolist(), strict=True)]


def _cut_pieces(start: np.ndarray, words: np.ndarray, source: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Spans of words cut where the source's places are multiples of PIECE: (span, start, words, source start)."""
    first, last = source // PIECE, (source + words - 1) // PIECE
    several = last - first + 1
    span = np.repeat(np.arange(len(start)), several)
    block = np.arange(len(span)) - np.repeat(np.cumsum(several) - several, several) + first[span]
    low = np.maximum(block * PIECE, source[span])
    high = np.minimum((block + 1) * PIECE, (source + words)[span])
    return span, start[span] + low - source[span], high - low, low


def _asked(k: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, start, n, src, source = (batch.column(i).to_numpy() for i in range(5))
            span, _, words, low = _cut_pieces(start, n + k - 1, source)
            kinds = np.unique(np.stack([src[span], low, words]), axis=1) if len(span) else np.zeros((3, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in kinds], names=["slice", "start", "n"])

    return ask


def _remove(text: int, n_chars: int | None, k: int, whole_rows: bool, names: list[str]):
    """Of one slice: its rows after removal, and the digests of the spans that it takes from others and that others take from it."""

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            raise ValueError("paths of no slice")
        batch = read_rows(left.column("rows")[0].as_py())
        w = tb.words_of(batch, f"c{text}")
        start, n, src, source = (right.column(c).to_numpy() for c in ("start", "n", "src_slice", "src_start"))
        own = right.column("own").to_numpy(zero_copy_only=False).astype(bool)
        change = np.zeros(len(w.start) + 1, np.int64)
        np.add.at(change, start[own], 1)
        np.add.at(change, start[own] + n[own] + k - 1, -1)
        keep = np.cumsum(change[:-1]) == 0
        joined = _Joined(w)
        span, at, words, low = _cut_pieces(start[own], n[own] + k - 1, source[own])
        number = left.column("slice")[0].as_py()
        proofs = [np.concatenate(x) for x in ((src[own][span], np.full((~own).sum(), number)), (low, start[~own]), (words, n[~own]))]
        digests = joined.digests(at, words) + joined.digests(start[~own], n[~own])
        data, where = tb.join_words(w, keep)
        view, where = memoryview(np.ascontiguousarray(data)), where.tolist()
        lost = np.bincount(w.doc[~keep], minlength=batch.num_rows).astype(np.int64)
        if whole_rows:
            texts = pa.array([bytes(view[a:b]).decode() if x else None for a, b, x in zip(where, where[1:], lost.tolist(), strict=False)], pa.string())
            columns = list(batch.columns[1:])
            columns[text] = pc.coalesce(texts, columns[text].cast(pa.string()))
            if n_chars is not None:
                columns[n_chars] = pc.if_else(pc.is_valid(texts), pc.utf8_length(texts).cast(columns[n_chars].type), columns[n_chars])
        else:
            hexes = [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(where, where[1:], strict=False)]
            columns = [batch.column(1), pa.array(w.counts.astype(np.int64)), pa.array(lost), pa.array(hexes, pa.string())]
        columns = [x.cast(pa.int64()) if pa.types.is_null(x.type) else x for x in columns]
        rows = pa.Table.from_arrays([pa.StructArray.from_arrays(columns, names=names), *[pa.nulls(batch.num_rows, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary())]], names=out)
        found = pa.Table.from_arrays([pa.nulls(len(digests), rows.schema.field(0).type), *map(pa.array, proofs), pa.array(digests, pa.binary())], names=out)
        tb.release()
        return pa.concat_tables([rows, found])

    out = ["row", *[x.split()[0] for x in PROOFS.split(", ")]]
    return remove


def _removed(docs: DataFrame, k: int, seeds: int, whole_rows: bool, n_chars: str | None = None) -> DataFrame:
    text = docs.columns.index("text")
    number = docs.columns.index(n_chars) if n_chars in docs.columns else None
    if whole_rows:
        names, types = [f"c{i}" for i in range(len(docs.columns))], [f.dataType.simpleString() for f in docs.schema.fields]
    else:
        names, types = ["doc_id", "n_words", "n_removed", "kept_sha256"], [docs.schema["doc_id"].dataType.simpleString(), "bigint", "bigint", "string"]
    row = ", ".join(f"{n}: {t}" for n, t in zip(names, types, strict=True))
    _, buckets = pieces(docs, "text", BUCKET_BYTES)
    slices = ordered_slices(docs)
    for seed in range(1, seeds + 1):
        paths = covered_paths(slices, f"c{text}", buckets, k, seed)
        asked = paths.mapInArrow(_asked(k), "slice bigint, start bigint, n bigint").distinct()
        spans = paths.withColumn("own", F.lit(True)).unionByName(asked.withColumn("own", F.lit(False)), allowMissingColumns=True).fillna(0)
        out = slices.groupBy("slice").cogroup(spans.groupBy("slice")).applyInArrow(_remove(text, number, k, whole_rows, names), f"row struct<{row}>, {PROOFS}")
        out = stored(out, "kept")
        proofs = out.where("src_slice is not null").groupBy("src_slice", "src_at", "words").agg(F.min("digest").alias("one"), F.max("digest").alias("two"))
        if proofs.where("one != two").isEmpty():
            return out.where("src_slice is null").select("row.*")
    raise RuntimeError(f"windows of different words shared a hash under {seeds} seeds")


def remove_repeats(docs: DataFrame, k: int = 13, *, seeds: int = 4) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each row of docs.

    Each word covered by a window of k words that also starts in a document with a smaller doc_id is removed; windows
    are judged on the input.  Null and empty texts have no words; texts of any length stay in one slice.  Rows with a
    null doc_id are kept whole and are no one's source.  Rows that share a doc_id do not affect each other, and repeated
    rows get the same result.  Columns other than doc_id and text are not read.  Hashes only propose: the words of every
    path are compared with those at its source, and should two windows ever share a hash (some 64 bits and those that
    choose the bucket), all is done again with another.
    """
    return _removed(docs.select("doc_id", "text"), k, seeds, False)


def without_repeats(docs: DataFrame, k: int = 13, *, n_chars: str = "n_chars", seeds: int = 4) -> DataFrame:
    """docs with the words that remove_repeats removes taken out of ``text``, and n_chars (if there is one) made to fit.

    A text that loses words becomes its other words joined by one space; one left without words becomes empty.  Texts
    that lose none, null ones included, stay as they are, and every row stays, with all its columns, whatever their names.
    """
    out = _removed(docs, k, seeds, True, n_chars)
    return out.select(*[F.col(f"c{i}").cast(f.dataType).alias(f.name) for i, f in enumerate(docs.schema.fields)])
