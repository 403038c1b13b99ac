import random

import pyarrow as pa

from tests.llm.cases import ROWS, clashing, empty, odd, prose, words
from tideworks.llm import repetition as rp
from tideworks.llm import textbytes as tb


def plain(text, least):
    w = words(text)
    n = len(w)
    covered, longest, repeats, eight = set(), 0, set(), set()
    places = {}
    for i in range(n):
        for j in range(i + 1, min(n, i + 60) + 1):
            places.setdefault(tuple(w[i:j]), []).append(i)
    for s, at in places.items():
        if len(at) < 2:
            continue
        if len(s) == 8:
            eight.update(p + k for p in at for k in range(8))
        if len(s) >= least:
            longest = max(longest, len(s))
            covered.update(p + k for p in at for k in range(len(s)))
            if len({w[p - 1] if p else None for p in at}) > 1 and len({w[p + len(s)] if p + len(s) < n else None for p in at}) > 1:
                repeats.add(s)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return {"n_words": n, "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text or ""), "n_dup_lines": dup, "n_repeat_words": len(eight), "covered_words": len(covered), "longest_repeat": longest, "n_repeats": len(repeats)}


def test_equals_brute_force_on_repetitive_texts():
    r = random.Random(5)
    texts = [None, "", "a", "a a a a a a a a a a"] + ["".join(r.choice("abcé#") + r.choice(["", "b", "d"]) + r.choice(" \n") for _ in range(r.choice([3, 25, 50]))) for _ in range(60)]
    got = rp.measure(*tb.column(pa.record_batch([pa.array(texts)], ["text"])), rp.RepetitionRules(min_repeat_words=3))
    for i, t in enumerate(texts):
        want = plain(t, 3)
        assert {k: got[k][i] for k in want} == want, t


def test_verdicts_and_rows(spark):
    got = rp.repetition_figures(odd(spark)).collect()
    assert len(got) == len(ROWS)
    kept = {r.doc_id: r.kept for r in got if r.doc_id is not None}
    assert kept[1] and kept[7] and kept[11] and not kept[5] and not kept[4] and not kept[9] and not kept[12] and not kept[13]
    assert all(r.base_failed is not None and r.n_words is not None for r in got)


def test_limits_of_the_method():
    block = prose(3, 250, 5000)
    long = f"{block} {prose(4, 2000, 5000)} {block}"
    m = rp.measure(*tb.column(pa.record_batch([pa.array([long])], ["text"])), rp.RepetitionRules())
    assert m["longest_repeat"][0] == 250 and not m["base_failed"][0] and not m["kept"][0]


def test_passed_only_empty_and_clashing(spark):
    out = rp.repetition_figures(clashing(spark, ["kept", "n_words"]), passed_only=True)
    assert out.columns[-1] == "n_words" and {r.n_words for r in out.collect()} == {"kept"}
    assert rp.repetition_figures(clashing(spark, ["kept"])).select("kept").dtypes == [("kept", "boolean")]
    assert rp.repetition_figures(empty(spark)).count() == 0


def test_words_said_over_and_over_fail_and_prose_passes():
    said = [" ".join(f"v{i} " * times for i in range(10)) for times in (4, 5, 7)] + ["a b c d " + " ".join(f"u{k} a b c d" for k in range(15))]
    clean = [prose(21, 300, 400), prose(22, 9000, 3000), f"{prose(23, 60)} no no no no {prose(24, 60)}"]
    m = rp.measure(*tb.column(pa.record_batch([pa.array(said + clean)], ["text"])), rp.RepetitionRules())
    assert not m["base_failed"].any()
    assert m["short_failed"].tolist() == [True] * 4 + [False] * 3 and m["kept"].tolist() == [False] * 4 + [True] * 3
