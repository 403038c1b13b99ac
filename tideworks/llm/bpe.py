"""BPE encoding and decoding with a contiguous rank array per word.

A word is an array of parts with, for each, the rank of its merge with the next.  The least rank is found by a scan,
the boundary after it is deleted, and the two ranks beside it are looked up again; the arrays of many words of one
length lie in one matrix and take each step together.  Words over SHORT parts, for which scans would be quadratic, take
a heap over linked parts to the same result.  Texts are cut at white space first, and each distinct piece of a slice
is encoded once; pieces met before come from a table of bounded size.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tideworks.llm import textbytes as tb

SHORT = 64
NO_MERGE = np.int32(1 << 30)
SLICE = 1 << 20
CELLS = 1 << 18  # of a matrix of words


def spans(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[start:start+size] of each, one after another."""
    total = int(size.sum())
    return flat[np.repeat(start - np.cumsum(size) + size, size) + np.arange(total)]


class WordBpe:
    """A tokenizer of kind BPE with an end-of-word suffix, from the text of its JSON file.

    The file's normalizer, and for pieces beyond ASCII its splitting, are run by its library; merging and decoding are
    done here.
    """

    def __init__(self, source: str, known_pieces: int = 300_000):
        from tokenizers import Tokenizer

        spec = json.loads(source)
        model = spec["model"]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if model["type"] != "BPE" or split["type"] != "Split" or not split["invert"] or spec["decoder"] is not None:
            raise ValueError("not a word-end BPE file")
        library = Tokenizer.from_str(source)
        self.normalize, self.cut = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        # Of ASCII text, letters and digits are these.
        self.split = re.compile(split["pattern"]["Regex"].replace(r"[^\s\p{L}\p{N}]", r"[^\sA-Za-z0-9]").replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9"), re.A).findall
        self.suffix, vocab = model["end_of_word_suffix"], model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        every = [*vocab.items(), *self.special.items()]
        self.token = np.full(max(i for _, i in every) + 1, None, object)
        for t, i in every:
            self.token[i] = t
        self.decimal = np.array([str(i) for i in range(len(self.token))], object)
        ranks: dict[int, int] = {}
        made = [vocab[a + b] for a, b in model["merges"]]
        for rank, (a, b) in enumerate(model["merges"]):
            ranks.setdefault(vocab[a] << 32 | vocab[b], rank)
        self.pairs = np.array(sorted(ranks), np.int64)
        self.ranks = np.array([ranks[int(x)] for x in self.pairs], np.int32)
        self.made = np.array(made, np.int32)
        self.rank_of = ranks
        # The printable stand-ins of bytes in byte-level vocabularies: themselves where printable, else from 256 on.
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in plain)}
        self.inner = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[letters[b] + self.suffix] for b in range(256)], np.int32)
        # Pieces known, in order of their hashes under a key that no text can have been made for; a full table starts anew.
        self.seed, self.known_pieces = int.from_bytes(os.urandom(7), "little"), known_pieces
        self._forget()

    def _forget(self) -> None:
        self.key, self.start, self.size, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of merges of neighbours; NO_MERGE where there is none."""
        pair = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pair, self.ranks[at], NO_MERGE)

    def merge_short(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of words of equally many parts (words x parts): their parts after all merges, at the left, and how many."""
        parts = parts.copy()
        count = np.full(len(parts), parts.shape[1])
        if parts.shape[1] < 2:
            return parts, count
        ranks = self.rank(parts[:, :-1], parts[:, 1:])
        on = np.arange(len(parts))
        now = parts  # the words that still merge
        while True:
            best = ranks.argmin(1)
            least = ranks[np.arange(len(on)), best]
            go = least < NO_MERGE
            if not go.all():
                parts[on[~go], : now.shape[1]] = now[~go]
                on, now, ranks, best, least = on[go], now[go], ranks[go], best[go], least[go]
            if not len(on):
                return parts, count
            row, width = np.arange(len(on)), now.shape[1]
            now[row, best] = self.made[least]
            keep = np.arange(width) != (best + 1)[:, None]  # the boundary goes, and all after it move up
            now = now[keep].reshape(len(on), width - 1)
            ranks = ranks[keep[:, 1:]].reshape(len(on), width - 2)
            count[on] -= 1
            if width == 2:
                parts[on, :1] = now
                return parts, count
            at = np.flatnonzero(best > 0)
            ranks[at, best[at] - 1] = self.rank(now[at, best[at] - 1], now[at, best[at]])
            at = np.flatnonzero(best < width - 2)
            ranks[at, best[at]] = self.rank(now[at, best[at]], now[at, best[at] + 1])

    def merge_long(self, parts: list[int]) -> list[int]:
        n, find, made = len(parts), self.rank_of.get, self.made
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := find(parts[i] << 32 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if j < 0 or parts[i] != left or parts[j] != right:
                continue
            parts[i], parts[j], after[i] = int(made[rank]), -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            after[j] = -1
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := find(parts[a] << 32 | parts[b])) is not None:
                    heapq.heappush(heap, (r, a, parts[a], parts[b]))
        return [p for p in parts if p >= 0]

    def _merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words: where each one's start, how many they are, and all."""
        data = np.frombuffer(b"".join(words), np.uint8)
        size = np.fromiter(map(len, words), np.int64, len(words))
        start = np.cumsum(size) - size
        first = self.inner[data]
        first[start + size - 1] = self.last[data[start + size - 1]]
        counts, by = np.zeros(len(words), np.int64), np.argsort(size, kind="stable")
        lo = 0
        while lo < len(by):
            width = int(size[by[lo]])
            if width > SHORT:
                for i in by[lo:].tolist():
                    ids = self.merge_long(first[start[i] : start[i] + size[i]].tolist())
                    first[start[i] : start[i] + len(ids)], counts[i] = ids, len(ids)
                break
            hi = min(int(np.searchsorted(size[by], width, "right")), lo + max(1, CELLS // width))
            own = by[lo:hi]
            places = start[own][:, None] + np.arange(width)
            first[places], counts[own] = self.merge_short(first[places])
            lo = hi
        return start, counts, first

    def _split(self, piece: bytes, into: list[bytes | int]) -> None:
        """The words of a piece without white space, in UTF-8; special tokens as their ids."""
        text = piece.decode()
        for k, part in enumerate(self.at_special.split(text) if self.at_special and "<" in text else [text]):
            if k % 2:
                into.append(self.special[part])
            elif part.isascii():
                into += [x.encode() for x in self.split(part.lower())]
            elif part:
                plain = self.normalize(part)
                into += [plain[a:b].encode() for _, (a, b) in self.cut(plain)]

    def _learn(self, key: np.ndarray, pieces: list[bytes]) -> None:
        """Add pieces to those known."""
        words: list[bytes | int] = []
        several = np.zeros(len(pieces) + 1, np.int64)
        for i, piece in enumerate(pieces):
            self._split(piece, words)
            several[i + 1] = len(words)
        number: dict[bytes | int, int] = {}
        word = np.fromiter((number.setdefault(x, len(number)) for x in words), np.int64, len(words))
        distinct = list(number)
        at = [i for i, x in enumerate(distinct) if isinstance(x, bytes)]
        start, size, flat = self._merged([distinct[i] for i in at])
        starts, sizes = np.zeros(len(distinct), np.int64), np.ones(len(distinct), np.int64)
        starts[at], sizes[at] = start, size
        special = np.array([i for i, x in enumerate(distinct) if not isinstance(x, bytes)], np.int64)
        starts[special] = len(flat) + np.arange(len(special))
        flat = np.concatenate((flat, np.array([distinct[i] for i in special], np.int32)))
        length = np.concatenate(([0], np.cumsum(sizes[word])))[several]
        if len(self.key) + len(key) > self.known_pieces:
            self._forget()
        begin = np.concatenate((self.start, length[:-1] + len(self.flat)))
        self.flat = np.concatenate((self.flat, spans(flat, starts[word], sizes[word])))
        every, size = np.concatenate((self.key, key)), np.concatenate((self.size, np.diff(length)))
        by = np.argsort(every)
        self.key, self.start, self.size = every[by], begin[by], size[by]

    def encode_texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts of a slice one after another, and where each text's begin."""
        w = tb.words(data, offsets, self.seed)
        if not len(w.start):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        key, one, piece = np.unique(w.hash, return_index=True, return_inverse=True)
        at = np.searchsorted(self.key, key)
        known = self.key[np.minimum(at, len(self.key) - 1)] == key if len(self.key) else np.zeros(len(key), bool)
        if not known.all():
            if len(self.key) + int((~known).sum()) > self.known_pieces:  # a full table starts anew, with all of this slice
                self._forget()
                known[:] = False
            raw = data.tobytes()
            fresh = one[~known]
            self._learn(key[~known], [raw[a:b] for a, b in zip(w.start[fresh].tolist(), w.end[fresh].tolist(), strict=True)])
            at = np.searchsorted(self.key, key)
        each = at[piece]
        size = self.size[each]
        return spans(self.flat, self.start[each], size), np.concatenate(([0], np.cumsum(size)))[w.first]

    def encode(self, text: str) -> list[int]:
        raw = np.frombuffer(text.encode(), np.uint8)
        return self.encode_texts(raw, np.array([0, len(raw)]))[0].tolist()

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """As the file's library decodes without a decoder: the tokens joined by one space; ids of no token are left out."""
        ids = np.asarray(ids, np.int64)
        tokens = self.token[ids[(ids >= 0) & (ids < len(self.token))]].tolist()
        return " ".join(tokens if None not in tokens else [t for t in tokens if t is not None])


_loaded: dict[str, WordBpe] = {}  # of this worker process, with the pieces it knows


def loaded(source: str) -> WordBpe:
    key = hashlib.sha256(source.encode()).hexdigest()
    if key not in _loaded:
        _loaded[key] = WordBpe(source)
    return _loaded[key]


def encode_decode(docs: DataFrame, path: str, *, ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row of docs, and with ``ids`` the ids and decoded text too.

    Null counts as the empty text, which has no tokens and decodes to the empty text.  Rows are encoded alone, so
    repeated rows and empty tables need nothing special, and no other column of docs is read, whatever its name.  What
    is decoded are the ids.  No shuffle; memory is the vocabulary, a table of pieces of bounded size, one batch, and a
    slice of it or one longer text.
    """
    source = docs.sparkSession.sparkContext.broadcast(Path(path).read_text())  # a vocabulary file of fixed size
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(source.value)
        hexed = lambda x: hashlib.sha256(x.encode()).hexdigest()
        for batch in batches:
            for i, j, data, offsets in tb.slices(*tb.column(batch), SLICE):
                every, first = bpe.encode_texts(data, offsets)
                rows = [every[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                texts = [bpe.decode(r) for r in rows]
                out = [batch.column(0).slice(i, j - i), pa.array(np.diff(first)), pa.array([hexed(" ".join(bpe.decimal[r].tolist())) for r in rows], pa.string()), pa.array([hexed(t) for t in texts], pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    out += [pa.array(rows, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(out, names=names)
            tb.release()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if ids else ""))
