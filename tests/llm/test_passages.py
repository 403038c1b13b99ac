import hashlib

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.cases import ROWS, clashing, empty, odd, prose, words
from tideworks.llm import debruijn
from tideworks.llm import textbytes as tb


def plain(rows, k=13):
    first = {}
    for i, text, *_ in rows:
        if i is not None:
            w = words(text)
            for p in range(len(w) - k + 1):
                g = tuple(w[p : p + k])
                first[g] = min(first.get(g, i), i)
    out = []
    for i, text, *_ in rows:
        w = words(text)
        keep = [True] * len(w)
        for p in range(len(w) - k + 1):
            if i is not None and first[tuple(w[p : p + k])] < i:
                keep[p : p + k] = [False] * k
        kept = " ".join(x for x, y in zip(w, keep, strict=True) if y)
        out.append((str(i), len(w), keep.count(False), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def got(df):
    return sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


def test_equals_brute_force(spark):
    assert got(debruijn.remove_repeats(odd(spark))) == plain(ROWS)


def test_scattered_rows(spark):
    base = prose(1, 120)
    rows = [(i, " ".join([prose(i, 10 + i), *base.split()[i : i + 40], prose(100 + i, 15)])) for i in range(40)] + [(50, base), (51, base)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    assert got(debruijn.remove_repeats(df)) == plain(rows)


def morse(n):
    """Two words over a and b that hashes linear in their bytes, modulo a power of two, cannot tell apart."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return one, one.translate(str.maketrans("ab", "ba"))


def test_words_that_weak_hashes_confuse(spark):
    x, y = morse(4096)
    c = prose(5, 12)
    rows = [(1, f"{c} {x} {c}"), (2, f"{c} {y} {c}"), (3, f"{c} {y} {c}")]
    assert got(debruijn.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1))) == plain(rows)


def test_digests_tell_windows_of_one_hash_apart(spark, monkeypatch):
    """Without hashes all windows are one edge: the digests of some path differ from those of its source."""
    rows = [(i, i, prose(i, 20)) for i in range(3)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["id", "c0", "c1"])
    for weak in (False, True):
        if weak:
            monkeypatch.setattr(tb, "gram_hashes", lambda h, k, seed=0: np.zeros(max(0, len(h) - k + 1), np.uint64))
        edges = debruijn._edges(7, batch, "c1", 13, 1, 0)
        sources = debruijn._sources(pa.Table.from_batches([debruijn.batch_of(debruijn.EDGES, edges)]))
        assert (sources.num_rows > 0) == weak
    paths = debruijn._paths(sources)
    asked = pa.Table.from_batches(debruijn._asked(13)(paths.to_batches()))
    spans = pa.concat_tables([paths.append_column("own", pa.array([True] * paths.num_rows)), pa.table({"slice": asked["slice"], "start": asked["start"], "n": asked["n"], "src_slice": pa.array([0] * len(asked)), "src_start": pa.array([0] * len(asked)), "own": [False] * len(asked)})])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    slices = pa.table({"slice": [7], "rows": pa.array([sink.getvalue().to_pybytes()], pa.binary())})
    got_ = debruijn._remove(1, None, 13, False, ["doc_id", "n_words", "n_removed", "kept_sha256"])(slices, spans).to_pylist()
    digests = {}
    for r in got_:
        digests.setdefault((r["src_at"], r["words"]), set()).add(r["digest"])
    del digests[None, None]
    assert any(len(d) > 1 for d in digests.values())
    with pytest.raises(RuntimeError):
        debruijn.remove_repeats(odd(spark), seeds=0)


def test_a_doc_id_over_several_slices(spark, monkeypatch):
    base = prose(3, 30)
    rows = [(5, f"{prose(i, 15)} {base} {prose(20 + i, 15)}") for i in range(12)] + [(6, f"{base} {prose(60, 9)} {base}"), (7, base), (4, prose(0, 15) + " z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    monkeypatch.setattr(debruijn, "ordered_slices", lambda d, f=debruijn.ordered_slices: f(d, 300))
    assert got(debruijn.remove_repeats(df)) == plain(rows)


def test_whole_rows_stay(spark):
    df = clashing(spark, ["mark", "_kept", "spans"])
    out = debruijn.without_repeats(df).collect()
    assert len(out) == len(ROWS) and {r.mark for r in out} == {"kept"} and out[0].asDict().keys() == df.first().asDict().keys()
    texts = {r.doc_id: r for r in out if r.doc_id}
    assert texts[1].text == ROWS[0][1] and texts[2].text == "" and texts[2].n_chars == 0 and texts[4].text is None and texts[6].text == " \n\t "
    assert debruijn.without_repeats(empty(spark)).count() == 0
