import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tests.llm.cases import ROWS, clashing, empty, odd
from tideworks.llm import bpe, tokencounts
from tideworks.llm import textbytes as tb
from tideworks.llm.queries import tokenizer_path

ALPHABET = "abcdeAZ éß'İΣσς́​\xa0　字漢が1٣½²-_!<|endoftext|>\t\n\x85\x1c\U0001f600éﬁǅK"


def texts(n):
    r = random.Random(3)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 60))) for _ in range(n)] + ["", "<|endoftext|>", "a<|startoftext|><|endoftext|>b  ", "x" * 5000, "it's WE'LL 'S", "ΑΣ ΑΣ. ΑΣΑ"] + [r[1] or "" for r in ROWS]


def test_word_bpe_equals_the_library():
    path = tokenizer_path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), bpe.WordBpe(open(path).read(), known_pieces=50)
    some = texts(1500) + [f"a{c}b {c}x" for c in "\u0558\u088f\u0c5c\U00010940"]
    want = [library.encode(t, add_special_tokens=False).ids for t in some]
    for t, ids in zip(some, want, strict=True):
        assert own.encode(t) == ids and own.decode(ids) == library.decode(ids, skip_special_tokens=False)
    every, first = bpe.WordBpe(open(path).read()).encode_texts(*tb.column(pa.record_batch([pa.array(some)], ["text"])))
    assert [every[a:b].tolist() for a, b in zip(first, first[1:], strict=False)] == want
    assert own.decode([5, 10**9, -1]) == library.decode([5], skip_special_tokens=False)


def test_short_and_long_words_merge_alike():
    own, r = bpe.WordBpe(open(tokenizer_path("word_bpe_49k.json")).read()), random.Random(1)
    for width in (1, 2, 3, 5, 9, 17, 64):
        parts = np.array([[own.inner[ord(r.choice("theandiosr"))] for _ in range(width)] for _ in range(40)], np.int32)
        merged, count = own.merge_short(parts)
        assert [x[:n].tolist() for x, n in zip(merged, count, strict=True)] == [own.merge_long(x.tolist()) for x in parts]


def test_encode_decode_rows(spark):
    out = bpe.encode_decode(clashing(spark, ["ids", "n_tokens"]), tokenizer_path("word_bpe_49k.json"), ids=True).collect()
    assert len(out) == len(ROWS) and {r.n_tokens for r in out if r.doc_id in (4, 5, 6)} == {0}
    assert all(len(r.ids) == r.n_tokens for r in out)
    assert bpe.encode_decode(empty(spark), tokenizer_path("word_bpe_49k.json")).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_equal_the_library(name):
    path = tokenizer_path(name)
    count = tokencounts._counter(path, open(path, "rb").read())
    some = texts(800)
    if name.endswith(".model"):
        import sentencepiece

        want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(some)]
    else:
        want = [len(x.ids) for x in Tokenizer.from_file(path).encode_batch(some, add_special_tokens=False)]
    assert count(some) == want


def test_cache_encodes_each_content_once(spark, tmp_path):
    path, cache = tokenizer_path("byte_bpe_50k.json"), str(tmp_path / "cache")
    library = Tokenizer.from_file(path)
    want = sorted((str(i), len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in ROWS)
    for _ in range(2):  # the second time all are hits
        out = tokencounts.token_counts(clashing(spark, ["digest", "n_tokens"]), path, cache)
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in out.collect()) == want
        assert {r.digest for r in out.collect()} == {"kept"} and all(r.over_limit == (r.n_tokens > 1024) for r in out.collect())
        assert spark.read.parquet(cache).count() == len({t or "" for _, t, *_ in ROWS})
    other = tokencounts.token_counts(odd(spark), tokenizer_path("word_bpe_49k.json"), cache)  # a new version, the same cache
    assert other.count() == len(ROWS) and spark.read.parquet(cache).select("tokenizer").distinct().count() == 2
    assert tokencounts.token_counts(empty(spark), path).count() == 0
