from collections import defaultdict

import pytest

from tests.llm.cases import ROWS, clashing, empty, odd, words
from tideworks.llm import mixing


def plain_targets(sizes, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, full, target = 1.5 * sum(sizes.values()), set(), {}
    while True:
        rest = total - sum(2 * sizes[s] for s in full)
        free = [s for s in names if s not in full]
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            return share | {s: 2.0 * sizes[s] for s in full}
        full |= over


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 100, "c": 5, None: 70}, {"a": 3}, {f"s{i:02d}": (i * 37) % 91 + 1 for i in range(40)}, {"a": 0, "b": 5}])
def test_targets_equal_repeated_resharing(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r.source: r.target for r in mixing.source_targets(df, (5, 2, 1), 150, 2).collect()}
    want = plain_targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_plan_and_mix(spark):
    plan = mixing.mix_plan(clashing(spark, ["rate", "key", "row", "_size"])).collect()
    assert len(plan) == len(ROWS) and {r.rate for r in plan} == {"kept"}
    sums = defaultdict(int)
    for i, t, _, s, _ in ROWS:
        sums[s] += len(words(t))
    assert all(r["size"] == len(words(r.text)) and r.source_size == sums[r.source] and 0 <= r.copies <= 2 for r in plan)
    shuffled = mixing.mix_plan(odd(spark).repartition(5), max_sources_to_broadcast=0).collect()
    key = lambda rows: sorted((str(r.doc_id), r.copies, r.target) for r in rows)
    assert key(plan) == key(shuffled)
    mix = mixing.mixed(clashing(spark, ["rate", "whole", "copies"]))
    assert mix.columns == [*odd(spark).columns, "rate", "whole", "copies"] and mix.count() == sum(r.copies for r in plan)
    assert mixing.mix_plan(empty(spark)).count() == 0 and mixing.mixed(empty(spark)).count() == 0


def test_sources_come_near_their_targets(spark):
    rows = [(i, "w " * 20, f"s{i % 3}") for i in range(6000)]
    plan = mixing.mix_plan(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    taken, target = defaultdict(int), {}
    for r in plan:
        taken[r.source] += r["size"] * r.copies
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) < 0.05 * target[s] for s in target)
