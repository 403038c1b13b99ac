"""Quality rules: repeated substrings inside one document, found with a suffix array.

The suffixes of all documents of a slice are sorted together by prefix doubling.  A word's symbol includes its
document, so suffixes of different documents share no prefix.  Neighbours' longest common prefixes give the LCP
intervals; an interval whose members are preceded by different words is a maximal repeat.  The repeats' spans are
united, and a document fails when they cover too large a part of it or when one of them is too long.  Repeats of a few
words have limits of their own, since words said over and over have no repeats as long as the base rule's windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tideworks.llm import textbytes as tb

WINDOW = 8
SLICE = 1 << 20
IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


@dataclass(frozen=True)
class RepetitionRules:
    """Limits on the repeats of at least min_repeat_words words; short_limits: on those of at least so many words, by percent covered."""

    min_repeat_words: int = 8
    max_covered_percent: int = 30
    short_limits: tuple[tuple[int, int], ...] = ((3, 50), (4, 30))
    max_longest_words: int = 100
    min_words: int = 20
    max_window_percent: int = 30


def suffix_array(symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of ``symbol`` (int64 ids, where equal prefixes never run over a document's end) and the LCP of each entry with the one before."""
    n = len(symbol)
    order = np.argsort(symbol, kind="stable")
    fresh = np.concatenate(([True], symbol[order][1:] != symbol[order][:-1]))
    rank = np.empty(n, np.int64)
    heads = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))  # a group's rank is its first place in the array
    rank[order] = heads
    levels = [rank.astype(np.int32)]
    k = 1
    while True:
        size = np.bincount(rank, minlength=n)
        active = np.flatnonzero(size[rank] > 1)
        if not len(active):
            break
        after = active + k
        second = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
        by = np.lexsort((second, rank[active]))
        group, second, place = rank[active][by], second[by], active[by]
        new_group = np.concatenate(([True], group[1:] != group[:-1]))
        fresh = new_group | np.concatenate(([True], second[1:] != second[:-1]))
        at = np.arange(len(by))
        head = np.maximum.accumulate(np.where(fresh, at, 0)) - np.maximum.accumulate(np.where(new_group, at, 0))
        rank = rank.copy()
        rank[place] = group + head
        k *= 2
        levels.append(rank.astype(np.int32))
    sa = np.empty(n, np.int64)
    sa[rank] = np.arange(n)
    lcp = np.zeros(n, np.int64)
    a, b, open_ = sa[:-1].copy(), sa[1:].copy(), np.arange(1, n)
    for level in range(len(levels) - 2, -1, -1):  # in the last all differ
        ranks = levels[level]
        same = (a < n) & (b < n)
        same[same] = ranks[a[same]] == ranks[b[same]]
        step = 1 << level
        lcp[open_[same]] += step
        a[same] += step
        b[same] += step
    return sa, lcp


def maximal_repeats(sa: np.ndarray, lcp: np.ndarray, before: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(length, first and last place in sa) of the LCP intervals of length >= least whose members differ in the word before.

    before[i] is the symbol before suffix i, or a negative number of its own at a document's start.
    """
    found: list[tuple[int, int, int]] = []
    stack: list[list[int]] = []  # length, first place, symbol before (None once two differ)
    mixed = object()
    at = np.flatnonzero(lcp >= least)
    places = at.tolist()
    lengths, left, right = lcp[at].tolist(), before[sa[at - 1]].tolist(), before[sa[at]].tolist()

    def close(down_to: int, last: int):
        while stack and stack[-1][0] > down_to:
            length, first, symbol = stack.pop()
            if symbol is mixed:
                found.append((length, first, last))
            if stack and stack[-1][0] >= down_to and stack[-1][2] != symbol:
                stack[-1][2] = mixed
            elif not stack or stack[-1][0] < down_to:
                return first, symbol
        return None

    previous = -2
    for place, length, x, y in zip(places, lengths, left, right, strict=True):
        if place != previous + 1:
            close(0, previous)
            stack.clear()
        carried = close(length, place - 1)
        if not stack or stack[-1][0] < length:
            first, symbol = carried if carried else (place - 1, x)
            stack.append([length, first, symbol])
        top = stack[-1]
        if top[2] is not mixed and top[2] != y:
            top[2] = mixed
        previous = place
    close(0, previous)
    return found


def _cover(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n places the spans cover."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + lengths, -1)
    return np.cumsum(change[:-1]) > 0


def _dup_lines(w: tb.Words) -> np.ndarray:
    """Lines with a word that equal an earlier line of their document, by document."""
    n_docs, data, offsets = len(w.offsets) - 1, w.data, w.offsets
    if not len(w.start):
        return np.zeros(n_docs, np.int64)
    breaks = np.flatnonzero(data == 0x0A)
    filled = np.flatnonzero(np.diff(offsets) > 0)
    start = np.sort(np.concatenate((offsets[filled], breaks + 1)))
    end = np.sort(np.concatenate((breaks, offsets[filled + 1])))
    real = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    start, end = start[real], end[real]
    doc = np.searchsorted(offsets, start, "right") - 1
    key = tb.span_hashes(data, start, end)
    order = np.lexsort((key, doc))
    same = (key[order][1:] == key[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    return np.bincount(doc[order][1:][same], minlength=n_docs)


def measure(data: np.ndarray, offsets: np.ndarray, rules: RepetitionRules) -> dict[str, np.ndarray]:
    """All figures of a slice of documents."""
    w = tb.words(data, offsets)
    n_docs, n = len(offsets) - 1, len(w.start)
    per_doc = lambda flags: np.bincount(w.doc[flags], minlength=n_docs).astype(np.int64)
    out = {"n_words": w.counts.astype(np.int64)}
    heads = np.concatenate(([0], np.cumsum(~tb.IS_SPACE[data] & ((data & 0xC0) != 0x80))))
    out["word_chars"] = heads[offsets[1:]] - heads[offsets[:-1]]
    symbols = np.concatenate(([0], np.cumsum(IS_SYMBOL[data])))
    out["n_symbols"] = symbols[offsets[1:]] - symbols[offsets[:-1]]
    out["n_dup_lines"] = _dup_lines(w)
    out["short_failed"] = np.zeros(n_docs, bool)
    if n:
        symbol = tb.mix(w.hash + w.doc.astype(np.uint64) * tb.U64(0x9E3779B97F4A7C15)).view(np.int64)
        sa, lcp = suffix_array(symbol)
        deepest = np.zeros(n, np.int64)  # the longest repeat that starts at a word
        deepest[sa] = np.maximum(lcp, np.concatenate((lcp[1:], [0])))
        at = np.flatnonzero(deepest >= WINDOW)
        out["n_repeat_words"] = per_doc(_cover(at, np.full(len(at), WINDOW), n))
        before = np.concatenate(([0], symbol[:-1]))
        starts = w.first[:-1][w.counts > 0]
        before[starts] = -1 - starts
        repeats = maximal_repeats(sa, lcp, before, rules.min_repeat_words)
        where = w.doc[sa[[first for _, first, _ in repeats]]] if repeats else np.zeros(0, np.int64)
        out["n_repeats"] = np.bincount(where, minlength=n_docs).astype(np.int64)
        longest = np.zeros(n_docs, np.int64)
        np.maximum.at(longest, where, np.array([length for length, _, _ in repeats], np.int64))
        out["longest_repeat"] = longest
        # A suffix's deepest interval that is not maximal lies in a longer repeat one word to the left, so these
        # spans have the same union as those of the maximal repeats.
        at = np.flatnonzero(deepest >= rules.min_repeat_words)
        out["covered_words"] = per_doc(_cover(at, deepest[at], n))
        for least, percent in rules.short_limits:
            at = np.flatnonzero(deepest >= least)
            out["short_failed"] |= 100 * per_doc(_cover(at, deepest[at], n)) > percent * out["n_words"]
    else:
        out |= {k: np.zeros(n_docs, np.int64) for k in ("n_repeat_words", "n_repeats", "longest_repeat", "covered_words")}
    few, n_words = out["n_words"] < rules.min_words, out["n_words"]
    out["base_failed"] = few | (100 * out["n_repeat_words"] > rules.max_window_percent * n_words)
    out["kept"] = ~(out["base_failed"] | out["short_failed"] | (100 * out["covered_words"] > rules.max_covered_percent * n_words) | (out["longest_repeat"] > rules.max_longest_words))
    return out


FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_repeats", "longest_repeat", "covered_words", "short_failed"]


def repetition_figures(docs: DataFrame, rules: RepetitionRules | None = None, *, passed_only: bool = False) -> DataFrame:
    """docs with a column ``text``, and the figures and verdict beside its other columns (a column of docs by the name of a figure gives way).

    Null and empty texts have no words, so they fail.  Each row is judged alone: repeated rows, ties and empty tables
    need nothing special.  No shuffle.  passed_only: return the rows of docs that are kept, unchanged.
    """
    rules = rules or RepetitionRules()
    carried = [f for f in docs.schema.fields if passed_only or f.name not in {"text", *FIGURES}]
    names = [f.name for f in carried]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in carried] + ([] if passed_only else [f"{c} {'boolean' if c in ('base_failed', 'kept', 'short_failed') else 'bigint'}" for c in FIGURES]))

    def figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [measure(d, o, rules) for _, _, d, o in tb.slices(*tb.column(batch), SLICE)]
            if not parts:
                continue
            if passed_only:
                yield batch.filter(pa.array(np.concatenate([p["kept"] for p in parts])))
            else:
                own = [pa.array(np.concatenate([p[c] for p in parts])) for c in FIGURES]
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in names] + own, names=names + FIGURES)
            tb.release()

    read = docs if passed_only else docs.select(*[f"`{c}`" for c in names], "text")
    return read.mapInArrow(figures, schema)
