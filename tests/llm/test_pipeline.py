"""The whole pipeline against plain Python, on odd rows and on the smallest tables."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.cases import ROWS, SCHEMA, clashing, prose
from tests.llm.test_jaccard import plain as near
from tests.llm.test_mixing import plain_targets
from tests.llm.test_passages import plain as passages
from tests.llm.test_quality import plain as quality
from tests.llm.cases import words
from tideworks.llm.queries import tokenizer_path

import corpus_pipeline


def kept_words(rows, k=13):
    first = {}
    for i, text, *_ in rows:
        w = words(text)
        for p in range(len(w) - k + 1):
            g = tuple(w[p : p + k])
            first[g] = min(first.get(g, i), i)
    out = []
    for i, text, *rest in rows:
        w = words(text)
        keep = [True] * len(w)
        for p in range(len(w) - k + 1):
            if first[tuple(w[p : p + k])] < i:
                keep[p : p + k] = [False] * k
        out.append((i, text if all(keep) else " ".join(x for x, y in zip(w, keep, strict=True) if y), *rest))
    return out


def copies(i, rate):
    draw = int(hashlib.md5(f"20260101/{i}".encode()).hexdigest()[:13], 16) / 2**52
    return int(rate) + (draw < rate - int(rate))


def whole(rows):
    def good(text):
        q, n = quality(text, 8), len(words(text))
        return n >= 20 and 100 * q["n_repeat_words"] <= 30 * n and 100 * q["covered_words"] <= 30 * n and q["longest_repeat"] <= 200

    rows = [r for r in rows if good(r[1])]
    class_of = {i: c for i, c, _ in near(rows)}
    seen, one = set(), []
    for r in rows:
        if class_of[str(r[0])] == str(r[0]) and r[0] not in seen:
            seen.add(r[0])
            one.append(r)
    rows = kept_words(one)
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(words(r[1]))
    targets = plain_targets(sizes)
    library, out = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")), []
    hexed = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for i, text, _, source, _ in rows:
        ids = library.encode(text, add_special_tokens=False).ids
        row = (i, len(ids), hexed(" ".join(map(str, ids))), hexed(library.decode(ids, skip_special_tokens=False)))
        out += [row] * copies(i, targets[source] / sizes[source] if sizes[source] else 0)
    return sorted(out)


def test_pipeline_equals_plain_python(spark, tmp_path):
    rows = [r for r in ROWS if r[0] is not None and r[0] != 11]  # the plain repeats are found by trying all substrings
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == whole(rows)


def test_all_odd_rows_and_none(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(str(tmp_path / "a/documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "a")).count() > 0
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "b/documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "b")).count() == 0


def test_stages_keep_columns_of_clashing_names_and_long_texts(spark, tmp_path):
    names = ["kept", "digest", "slice", "id", "c0", "row", "size", "copies"]
    long = spark.createDataFrame([(500, prose(77, 150_000, 90_000), "en", "a", 1)], SCHEMA).withColumns({n: F.lit("kept") for n in names})
    docs = clashing(spark, names).unionByName(long)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        stage(spark, docs, "").write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns and docs.where("doc_id = 500").count() > 0 and {r[0] for r in docs.select(*names).distinct().collect()} == {"kept"}


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "shared_passages", "mix", "encode"]
    assert passages([]) == []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_registered_queries_run(spark):
    from tideworks.llm import queries

    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
