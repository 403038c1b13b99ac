"""N-gram Jaccard join with Bayesian candidate pruning.

Equal texts are one class.  MinHash bands propose candidates; what they connect is cut into blocks, and each pair of
blocks is compared in one place: MinHash values a few at a time, dropping pairs whose posterior probability of
reaching the threshold is below a tolerance, and the shingle sets of the rest exactly.  Links are counted where they
are found, and only one row per document and block leaves, never one per pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideworks.llm import textbytes as tb
from tideworks.llm.components import components, narrowed
from tideworks.llm.shared import stored


@dataclass(frozen=True)
class JaccardJoin:
    """28 bands of 5 values leave out a pair of similarity 0.8 with a probability of 1.5e-5, and more similar ones less often."""

    shingle_words: int = 5
    threshold_percent: int = 80
    bands: int = 28
    rows: int = 5
    tolerance: float = 1e-6
    step: int = 20
    block: int = 256

    @property
    def values(self) -> int:
        return self.bands * self.rows


@lru_cache
def least_matches(values: int, step: int, percent: int, tolerance: float) -> tuple[tuple[int, int], ...]:
    """(values compared, fewest matches to go on) after each step.

    With a uniform prior, m matches of n give the similarity a Beta(m+1, n-m+1) posterior; its chance of being t or
    more is that of at most m successes in n+1 trials of chance t.
    """
    out, t = [], percent / 100
    for n in [*range(step, values, step), values]:
        chance, m = 0.0, -1
        while chance < tolerance:
            m += 1
            chance += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append((n, m))
    return tuple(out)


@lru_cache
def _functions(values: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.arange(1, values + 1, dtype=np.uint64)
    return tb.mix(i) | tb.U64(1), tb.mix(i + tb.U64(1 << 32))


def shingles(w: tb.Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each document's runs of k words (a shorter document is one run), and where each document's begin."""
    counts = w.counts
    sizes = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    first = np.concatenate(([0], np.cumsum(sizes)))
    out = np.empty(first[-1], np.uint64)
    grams = tb.gram_hashes(w.hash, k)
    full = np.flatnonzero(w.doc[: len(grams)] == w.doc[k - 1 :]) if len(grams) else np.zeros(0, np.int64)
    long = np.repeat(counts >= k, sizes)
    out[long] = grams[full]
    for d in np.flatnonzero((counts > 0) & (counts < k)):
        out[first[d]] = tb.gram_hashes(w.hash[w.first[d] : w.first[d + 1]], int(counts[d]))[0]
    return out, first


def signatures(hashes: np.ndarray, first: np.ndarray, values: int) -> np.ndarray:
    """MinHash values (documents x values, uint32) of documents that all have shingles."""
    a, b = _functions(values)
    out = np.empty((len(first) - 1, values), np.uint32)
    for i in range(values):
        out[:, i] = np.minimum.reduceat((hashes * a[i] + b[i]) >> tb.U64(32), first[:-1])
    return out


def _band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    n, values = sig.shape
    keys = np.empty((n, values // rows), np.uint64)
    for band in range(values // rows):
        h = np.full(n, band + 1, np.uint64)
        for i in range(band * rows, band * rows + rows):
            h = tb.mix(h * tb.U64(tb.BASE) + sig[:, i])
        keys[:, band] = h
    return keys.view(np.int64)


def _link_counts(sig: list[np.ndarray], sets: list[list[np.ndarray]], within: bool, p: JaccardJoin) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (i, j) of the rows of two blocks, or of one with itself."""
    left, right = sig
    checks = least_matches(p.values, p.step, p.threshold_percent, p.tolerance)
    n, m = checks[0]
    same = np.zeros((len(left), len(right)), np.int16)
    for c in range(n):
        same += left[:, c, None] == right[None, :, c]
    alive = same >= m
    if within:
        alive &= np.triu(np.ones_like(alive), 1)
    i, j = np.nonzero(alive)
    found = same[i, j]
    for n2, m2 in checks[1:]:
        if not len(i):
            return i, j
        for c in range(n, n2):
            found += left[i, c] == right[j, c]
        n = n2
        go = found >= m2
        i, j, found = i[go], j[go], found[go]
    sizes = [np.array([len(x) for x in s], np.int64) for s in sets]
    fits = 100 * np.minimum(sizes[0][i], sizes[1][j]) >= p.threshold_percent * np.maximum(sizes[0][i], sizes[1][j])
    i, j = i[fits], j[fits]
    if len(i) <= 4 * (len(left) + len(right)):
        common = np.array([len(np.intersect1d(sets[0][x], sets[1][y], assume_unique=True)) for x, y in zip(i, j, strict=True)], np.int64)
    else:
        common = _products(sets, within)[i, j]
    linked = 100 * common >= p.threshold_percent * (sizes[0][i] + sizes[1][j] - common)
    return i[linked], j[linked]


def _products(sets: list[list[np.ndarray]], within: bool, width: int = 4096) -> np.ndarray:
    """Sizes of all intersections, as products of 0/1 matrices over the shingles that two documents have, some columns at a time."""
    every = sets[0] if within else sets[0] + sets[1]
    flat, owner = np.concatenate(every), np.repeat(np.arange(len(every)), [len(x) for x in every])
    _, column, df = np.unique(flat, return_inverse=True, return_counts=True)
    shared = df[column] > 1
    owner, column = owner[shared], np.cumsum(df > 1)[column[shared]] - 1
    by = np.argsort(column, kind="stable")
    owner, column = owner[by], column[by]
    out = np.zeros((len(sets[0]), len(sets[1])), np.float64)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [lo, lo + width])
        x = np.zeros((len(every), width), np.float32)
        x[owner[a:b], column[a:b] - lo] = 1
        out += x[: len(sets[0])] @ (x if within else x[len(sets[0]) :]).T
    return out.astype(np.int64)


def _verify(p: JaccardJoin):
    names = ["digest", "n_docs", "block", "i", "j", "sig", "shingles"]

    def verify(table: pa.Table) -> pa.Table:
        table = table.select(names)
        by_digest = {d: k for k, d in enumerate(table.column("digest").to_pylist())}  # repeated rows of one class count once
        table = table.take(pa.array(sorted(by_digest.values())))
        digest, n_docs, block = table.column("digest").to_pylist(), table.column("n_docs").to_numpy(), table.column("block").to_numpy()
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        sig = np.stack([np.frombuffer(x, np.uint32) for x in table.column("sig").to_pylist()])
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        one, two = np.flatnonzero(block == i), np.flatnonzero(block == j)
        a, b = _link_counts([sig[one], sig[two]], [[sets[x] for x in one], [sets[x] for x in two]], i == j, p)
        a, b = one[a], two[b]
        n = len(digest)
        links, docs = np.bincount(a, minlength=n) + np.bincount(b, minlength=n), np.bincount(a, n_docs[b], n) + np.bincount(b, n_docs[a], n)
        label = np.arange(n)
        while len(a):
            least = np.minimum(label[a], label[b])
            if (label[a] == least).all() and (label[b] == least).all():
                break
            np.minimum.at(label, a, least)
            np.minimum.at(label, b, least)
        at = np.flatnonzero(links)
        return pa.table({"digest": pa.array([digest[x] for x in at], pa.binary()), "leader": pa.array([digest[x] for x in label[at]], pa.binary()), "class_links": pa.array(links[at].astype(np.int64)), "links": pa.array(docs[at].astype(np.int64))})

    return verify


def near_duplicates(docs: DataFrame, p: JaccardJoin | None = None) -> DataFrame:
    """doc_id, class_id, n_links and n_class_links of each row of docs.

    Two texts are linked if the Jaccard similarity of their sets of shingle_words-word shingles reaches the threshold;
    a class is what links connect, named by its least doc_id.  n_links counts the other rows a row is linked to, copies
    included, n_class_links the other different texts.  Null, empty and blank texts have no words and link to nothing,
    not even each other: class_id is then the row's own doc_id.  A null doc_id names no class unless all are null.
    Copies of a text are counted by a map-side aggregate and compared once; a large group of different texts is cut
    into blocks, whose pairs are spread over tasks.
    """
    p = p or JaccardJoin()
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.unhex(F.md5(text)).alias("digest"), F.xxhash64(text).alias("cid"))
    classes = stored(rows.where(F.col("text").rlike("[^\\x20\\x09-\\x0D]")).groupBy("digest", "cid").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_docs")), "classes")

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for i, _, data, offsets in tb.slices(*tb.column(batch), 1 << 18):
                w = tb.words(data, offsets)
                hashes, first = shingles(w, p.shingle_words)
                at = np.flatnonzero(np.diff(first))
                if len(at):
                    keys = _band_keys(signatures(hashes, np.append(first[at], first[-1]), p.values), p.rows)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i + at].repeat(p.bands)), pa.array(keys.ravel())], names=["cid", "band"])
            tb.release()

    banded = stored(rows.select("cid", "text").mapInArrow(bands, "cid bigint, band bigint"), "bands")
    leaders = banded.groupBy("band").agg(F.min("cid").alias("leader"), F.max("cid").alias("last")).where("leader != last")
    stars = banded.join(leaders, "band").where("cid != leader").select(F.col("cid").alias("node"), "leader")
    spread = components(narrowed(stars))
    blocks = F.ceil(F.col("size") / p.block).cast("int")
    sizes = spread.groupBy("label").agg(F.count("*").alias("size"))
    placed = spread.join(sizes, "label").select(F.col("node").alias("cid"), "label", blocks.alias("blocks"))
    asked = classes.join(placed, "cid").select("digest", F.col("rep").alias("doc_id"), "n_docs", "label", "blocks", F.pmod(F.xxhash64(F.lit(7), "cid"), F.col("blocks")).cast("int").alias("block"))
    asked = stored(asked, "candidates")
    mine = rows.select("doc_id", "digest", "text")
    same = mine["digest"].eqNullSafe(asked["digest"]) & mine["doc_id"].eqNullSafe(asked["doc_id"])
    full = mine.join(asked.hint("shuffle_hash"), same).select(asked["digest"], "n_docs", "label", "blocks", "block", "text")

    def payload(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in tb.slices(*tb.column(batch), 1 << 18):
                hashes, first = shingles(tb.words(data, offsets), p.shingle_words)
                sig = signatures(hashes, first, p.values)
                sets = [np.unique(hashes[a:b]).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
                own = [c.slice(i, j - i) for c in batch.columns[:5]]
                yield pa.RecordBatch.from_arrays([*own, pa.array([s.tobytes() for s in sig], pa.binary()), pa.array(sets, pa.binary())], names=["digest", "n_docs", "label", "blocks", "block", "sig", "shingles"])
            tb.release()

    loaded = full.mapInArrow(payload, "digest binary, n_docs bigint, label bigint, blocks int, block int, sig binary, shingles binary")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least("block", x).alias("i"), F.greatest("block", x).alias("j")))
    spreadout = loaded.select("*", F.inline(pairs)).drop("blocks")
    found = stored(spreadout.groupBy("label", "i", "j").applyInArrow(_verify(p), "digest binary, leader binary, class_links bigint, links bigint"), "links")
    links = found.groupBy("digest").agg(F.sum("class_links").alias("class_links"), F.sum("links").alias("links"))
    named = components(narrowed(found.where("digest != leader").select(F.col("digest").alias("node"), "leader")))
    named = named.join(classes.select(F.col("digest").alias("node"), "rep"), "node")
    least = named.groupBy("label").agg(F.min("rep").alias("class_id"))
    ends = links.join(named.join(least, "label").select(F.col("node").alias("digest"), "class_id"), "digest")
    known = classes.join(ends, "digest", "left").select("digest", F.coalesce("class_id", "rep").alias("class_id"), (F.col("n_docs") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("class_links", F.lit(0)).alias("n_class_links"))
    out = rows.select("doc_id", "digest").join(known, "digest", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_class_links", F.lit(0)).alias("n_class_links"))


def without_near_duplicates(docs: DataFrame, p: JaccardJoin | None = None) -> DataFrame:
    """The rows of docs that stay when of each class the row with the least doc_id does.

    Of repeated rows with that doc_id one stays.  Rows with a null doc_id stay if their class has no other name.
    """
    kept = near_duplicates(docs, p).where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("doc_id").agg(F.count("*").alias("rows"))
    kept = stored(kept, "kept-ids")
    repeats = not kept.where("rows > 1 and doc_id is not null").isEmpty()
    out = docs.join(kept.where("doc_id is not null").select("doc_id").hint("shuffle_hash"), "doc_id", "left_semi").select(*docs.columns)
    out = out.dropDuplicates(["doc_id"]) if repeats else out
    return out if kept.where("doc_id is null").isEmpty() else out.unionByName(docs.where("doc_id is null"))
