import hashlib
import random
import re

from pyspark.sql import functions as F

from tests.llm.cases import ROWS, clashing, empty, odd
from tideworks.llm import paragraphsketch as ps


def pieces(text):
    return {p for p in re.split(r"\n|(?<=[.!?])[ \t]+", text) if p}


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_differences_equal_sets_at_every_size(spark):
    r = random.Random(4)
    rows = []
    for n in (0, 1, 3, 10, 40, 200, 900):
        for share in (0, 0.5, 0.95, 1):
            a = [r.getrandbits(64) - 2**63 for _ in range(n)]
            b = a[: int(n * share)] + [r.getrandbits(64) - 2**63 for _ in range(n - int(n * share))]
            rows.append((a, b))
    df = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>")
    for (a, b), got in zip(rows, df.coalesce(1).select(ps.differing(F.col("a"), F.col("b"), ps.table(F.col("a"), ps.Sketch()), ps.table(F.col("b"), ps.Sketch()), ps.Sketch()).alias("d")).collect(), strict=True):
        assert tuple(got.d) == (len(set(a) - set(b)), len(set(b) - set(a)))


def test_a_table_that_is_too_small_fails_to_peel(spark):
    keys = F.transform(F.sequence(F.lit(1), F.lit(60)), lambda x: F.xxhash64(x))
    assert spark.range(1).select(ps.peel(ps.table(keys, ps.Sketch()), ps.Sketch()).alias("d")).first().d is None


def test_versions(spark):
    out = {str(r.doc_id): r for r in ps.version_fingerprints(odd(spark)).where("doc_id > 2").collect()}
    rows = [(i, t or "") for i, t, *_ in ROWS if i is not None and i > 2]
    for k, (i, text) in enumerate(rows[:-1]):
        after, q = rows[k + 1][1], len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        got = out[str(i)]
        assert got.n_chars == len(text) and got.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(got.near_edited - alike(pieces(text), pieces(edited))) < 1e-9 and abs(got.near_next - alike(pieces(text), pieces(after))) < 1e-9
    every = ps.version_fingerprints(odd(spark)).collect()
    assert len(every) == len(ROWS)
    prints = {}
    for r in every:
        prints.setdefault(r.doc_id, set()).add(r.fingerprint)
    assert prints[9] == prints[10] and prints[1] == prints[2] and prints[9] != prints[7]


def test_the_last_is_followed_by_the_first(spark):
    one = spark.createDataFrame([(1, "abcdefgh")], "doc_id bigint, text string")
    assert ps.version_fingerprints(one).first().edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()
    df = spark.createDataFrame([(i, f"{i:04d}" * 2) for i in range(100)], "doc_id bigint, text string").repartition(5)
    got = {r.doc_id: r["next"]["text"] for r in ps.with_next(df, ["text"], 9).collect()}
    assert got == {i: f"{(i + 1) % 100:04d}" * 2 for i in range(100)}
    assert ps.version_fingerprints(empty(spark)).count() == 0


def test_a_small_difference_of_large_texts_peels_from_the_fingerprints(spark):
    a = F.transform(F.sequence(F.lit(1), F.lit(1000)), lambda x: F.xxhash64(x))
    b = F.transform(F.sequence(F.lit(3), F.lit(1001)), lambda x: F.xxhash64(x))
    s = ps.Sketch()
    d = spark.range(1).select(ps.peel(ps.subtract(ps.table(a, s), ps.table(b, s)), s).alias("d")).first().d
    assert tuple(d) == (2, 1)


def test_fingerprints_equal_a_plain_table(spark):
    """Cells by hand: three parts of eight, each digest in one cell of each."""
    keys = [5, -7, 123456789012345, 2**62 + 11]
    df = spark.createDataFrame([(keys,)], "keys array<bigint>")
    got = df.select(ps.fingerprint(F.col("keys"), ps.table(F.col("keys"), ps.Sketch())).alias("f"), F.transform("keys", lambda k: F.xxhash64(k, F.lit(1))).alias("c")).first()
    cells = [[0, 0, 0] for _ in range(24)]
    for k, c in zip(keys, got.c, strict=True):
        for part in range(3):
            cell = cells[8 * part + ((k % 2**64) >> 16 * part) % 8]
            cell[0], cell[1], cell[2] = cell[0] + 1, cell[1] ^ k % 2**64, cell[2] ^ c % 2**64
    assert got.f == ",".join([str(len(keys))] + ["0" if not n else f"{n}.{k:X}.{c % 2**32:X}" for n, k, c in cells])


def test_clashing_columns_and_a_long_text(spark):
    assert ps.version_fingerprints(clashing(spark, ["keys", "cells", "next", "range", "ghost"])).count() == len(ROWS)
    long = spark.createDataFrame([(1, "One sentence. " * 50_000 + "\n".join(str(i) for i in range(20_000)))], "doc_id bigint, text string")
    assert ps.version_fingerprints(long).first().near_next == 1.0
