import random

import numpy as np

from tests.llm.cases import ROWS, clashing, empty, odd, prose, words
from tests.llm.test_passages import morse
from tideworks.llm import jaccard
from tideworks.llm.components import components, narrowed


def plain(rows, k=5):
    sets = []
    for i, text, *_ in rows:
        w = words(text)
        sets.append((i, frozenset(tuple(w[p : p + k]) for p in range(max(1, len(w) - k + 1))) if w else frozenset()))
    n = len(sets)
    linked = [[a for a in range(n) if a != b and sets[a][1] and 100 * len(sets[a][1] & sets[b][1]) >= 80 * len(sets[a][1] | sets[b][1])] for b in range(n)]
    out = []
    for b in range(n):
        seen, todo = {b}, [b]
        while todo:
            for a in linked[todo.pop()]:
                if a not in seen:
                    seen.add(a)
                    todo.append(a)
        ids = [sets[a][0] for a in seen if sets[a][0] is not None]
        out.append((str(sets[b][0]), str(min(ids) if ids else None), len(linked[b])))
    return sorted(out)


def got(df):
    return sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in df.collect())


def test_equals_brute_force(spark):
    assert got(jaccard.near_duplicates(odd(spark))) == plain(ROWS)
    assert jaccard.near_duplicates(empty(spark)).count() == 0


def test_group_of_near_copies_over_several_blocks(spark):
    r, base = random.Random(2), prose(1, 150).split()
    rows = []
    for i in range(40):
        w = base[:]
        for _ in range(r.randrange(6)):
            w[r.randrange(len(w))] = f"x{r.randrange(1000)}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, prose(100 + i, 80)) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert got(jaccard.near_duplicates(df, jaccard.JaccardJoin(block=7))) == plain(rows)


def test_products_equal_single_intersections():
    r = np.random.default_rng(1)
    sets = [[np.unique(r.integers(0, 60, 40).astype(np.uint64)) for _ in range(9)] for _ in range(2)]
    both = jaccard._products(sets, False, width=16)
    assert all(both[i, j] == len(np.intersect1d(sets[0][i], sets[1][j])) for i in range(9) for j in range(9))


def test_posterior_bounds():
    checks = dict(jaccard.least_matches(140, 20, 80, 1e-6))
    assert list(checks) == [20, 40, 60, 80, 100, 120, 140]
    draws = np.random.default_rng(0).binomial(140, 0.8, 200_000)
    assert (draws >= checks[140]).all() and 60 < checks[140] < 112  # true pairs pass; those of similarity 0.4 do not
    assert checks[140] > 140 * 0.4


def test_one_row_of_each_class_stays(spark):
    df = clashing(spark, ["digest", "cid", "rep"])
    out = jaccard.without_near_duplicates(df)
    assert out.columns == df.columns
    ids = sorted((r.doc_id for r in out.collect()), key=lambda x: (x is None, x))
    assert ids == [1, 4, 5, 6, 7, 8, 9, 11, 12, 13] + [None] * ids.count(None)


def test_words_that_weak_hashes_confuse(spark):
    x, y = morse(4096)
    rows = [(1, f"{prose(1, 6)} {x}"), (2, f"{prose(1, 6)} {y}"), (3, f"{prose(1, 6)} {y}")]
    assert got(jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))) == plain(rows)


def test_components_of_chains_stars_and_apart(spark):
    r = random.Random(3)
    names = r.sample(range(1000), 300)
    edges = [(names[i], names[i + 1]) for i in range(120)] + [(names[150], names[i]) for i in range(151, 220)] + [(names[i], names[i + 1]) for i in range(230, 300 - 1, 2)] + [(5000, 5000)]
    got_ = {x.node: x.label for x in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = {n: min(g) for g in (names[:121], names[150:220], *[names[i : i + 2] for i in range(230, 299, 2)]) for n in g}
    assert got_ == want


def test_edges_of_a_large_group_are_few(spark):
    """5,000 texts that meet in 28 places each: an edge a text and some between leaders, not 28."""
    stars = spark.range(1, 5000).selectExpr("id node", "explode(transform(sequence(0, 27), b -> CASE WHEN pmod(xxhash64(id, b), 4) > 0 THEN 0 ELSE b END)) leader").where("leader < node")
    few = narrowed(stars)
    assert few.count() < 5100 and {x.label for x in components(few).select("label").distinct().collect()} == {0}
