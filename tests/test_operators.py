import json

import pytest
from pyspark.sql import functions as F

from tideworks import session
from tideworks.operators import iterate as fix
from tideworks.operators import multiset as ms
from tideworks.operators import relational as rel
from tideworks.operators import windows as win
from tideworks.plans import auctions as nex
from tideworks.plans import workloads as wl
from tideworks.sources import files


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_route_takes_the_first_that_holds(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (None,)], "x int")
    a, b = rel.route(df, F.col("x") >= 3, F.col("x") >= 2)
    assert rows(a) == [(3,)] and rows(b) == [(2,)]


def test_joins_and_sets(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, "b")], "x int, y string")
    b = spark.createDataFrame([(2, "b")], "x int, y string")
    assert rows(rel.except_rows(a, b)) == [(1, None), (1, None)] and rows(rel.union_distinct(a, b)) == [(1, None), (2, "b")]
    assert rows(rel.left_join_default(a.select("x").distinct(), b, ["x"], y=F.lit("-"))) == [(1, "-"), (2, "b")]
    assert rows(rel.with_max(spark.createDataFrame([(1, 5), (1, 5), (1, 4), (2, 0)], "k int, v int"), ["k"], "v")) == [(1, 5), (1, 5), (2, 0)]
    assert rows(rel.unordered_pairs(spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "k int, v int"), "k", "v")) == [(1, 1, 2), (1, 1, 3), (1, 2, 3)]
    assert rows(rel.argmin(spark.createDataFrame([(1, 5, "a"), (1, 4, "b")], "k int, v int, z string"), ["k"], [F.col("v")], ["z"])) == [(1, "b")]


def test_nearest_ties_go_to_the_least_id(spark):
    p = spark.createDataFrame([(1.0, 0.0)], "x double, y double")
    assert rel.nearest(p, [(0, [0.0, 0.0]), (1, [2.0, 0.0])], ["x", "y"]).first().centre == 0


def test_multisets(spark):
    a = ms.weighted(spark.createDataFrame([("a",), ("a",), ("b",)], "x string"))
    assert rows(ms.consolidate(ms.concat(a, ms.negate(a.where("x = 'b'"))))) == [("a", 2)]
    keys = spark.createDataFrame([("a", 3), ("b", 0)], "x string, weight bigint")
    assert rows(ms.consolidate(ms.semijoin(a, keys, ["x"]))) == [("a", 6)]
    assert rows(ms.distinct(a)) == [("a", 1), ("b", 1)]
    assert rows(ms.weighted_explode(ms.consolidate(a), F.lit(2))) == [("a", 4), ("b", 2)]


def test_hopping_counts_equal_windows(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), F.timestamp_seconds(F.col("id") * 7).alias("t"))
    plain = df.groupBy(F.window("t", "10 minutes", "2 minutes").alias("w"), "k").agg(F.count("*").alias("n")).select(F.col("w.start").alias("s"), "k", "n")
    assert rows(win.hopping_counts(df, "t", "2 minutes", 5, ["k"]).select("window_start", "k", "num")) == rows(plain)


@pytest.mark.parametrize("partitions", ["1", "4", "16"])
def test_iteration_does_not_depend_on_partitions(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        chain = spark.range(20).select(F.col("id").alias("x"), (F.col("id") + 1).alias("y"))
        assert fix.closure(chain, 100).count() == 21 * 20 // 2
        state, items = fix.iterate(spark.range(4).toDF("n"), 0, lambda df, s: df.select((F.col("n") + 1).alias("n")), lambda s, df: df.agg(F.max("n")).first()[0], lambda s: s < 10, 50)
        assert state == 10 and sorted(r[0] for r in items.collect()) == [7, 8, 9, 10]
        assert fix.replay(spark.range(3), 0, lambda df, s: s + df.count(), lambda a, b: b < 9, 50) == 9
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_readers(spark, tmp_path):
    (tmp_path / "e.csv").write_text("1,2\n3,4\n")
    assert rows(files.edge_list(spark, str(tmp_path / "e.csv"))) == [(1, 2), (3, 4)]
    (tmp_path / "t.txt").write_text("a b\nc\n")
    assert rows(files.lines(spark, str(tmp_path / "t.txt"))) == [("a b",), ("c",)]
    head = ",".join(files.COLLISION_COLUMNS)
    (tmp_path / "c.csv").write_text(f'{head}\n01/07/2024,"A, B",1,x,,x,,\nbad,,,,,,,\n')
    got = files.collisions(spark, str(tmp_path / "c.csv")).collect()
    assert str(got[0].date) == "2024-01-07" and got[0].borough == "A, B" and got[0].factors == ["x", "", "x", "", ""] and got[1].date is None and got[1].killed == 0
    (tmp_path / "runs/a").mkdir(parents=True)
    (tmp_path / "runs/a/1.json").write_text(json.dumps({"hosts": ["h"], "result": {"time": 1.5, "stdout": ""}, "system": "s", "run": 1}, indent=1))
    assert rows(files.run_files(spark, str(tmp_path / "runs")).select("system", "run", "time")) == [("s", 1, 1.5)]
    (tmp_path / "log").write_text("Query3 took 2.50 s\nnothing\n")
    assert rows(files.log_times(spark, str(tmp_path / "log"))) == [(3, 2.5)]
    assert files.discard(spark.range(3)) is None


def test_reports(spark):
    runs = spark.createDataFrame([("a", 1, 8.0), ("a", 2, 4.0), ("a", 4, 2.0)], "system string, cores int, time double")
    assert [r.speedup for r in wl.speedup(runs, ["system"], "cores", "time").orderBy("cores").collect()] == [1.0, 2.0, 4.0]
    assert wl.spread(runs, ["system"], "time").first().half_range == 3.0
    assert rows(wl.layout(runs, "cores", "system", ["a"], "time")) == [(1, 8.0), (2, 4.0), (4, 2.0)]
    assert rows(wl.code_size(spark.createDataFrame([("b/w/s/x", 2), ("b/w/s/y", 3)], "p string, n int"), "p", "n")) == [("b", "w", "s", 5)]


def test_shared_folder_is_the_sessions(spark, monkeypatch):
    assert session.shared_folder(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir").rstrip("/")

    class Unset:
        conf = type("C", (), {"get": staticmethod(lambda key, default=None: default)})
        sparkContext = type("S", (), {"applicationId": "app-1", "getConf": staticmethod(dict)})

    Unset.sparkContext.master = "local[2]"
    assert session.shared_folder(Unset).endswith("/_scratch")
    Unset.sparkContext.master = "spark://host:7077"  # no folder of one machine stands in
    with pytest.raises(ValueError):
        session.shared_folder(Unset)


def test_stored_tables_can_be_discarded(spark):
    table = session.materialise(spark.range(1000).toDF("id"))
    assert table.count() == 1000
    session.discard(table)
    assert spark.read.parquet(table.stored_at).count() == 0


def test_components_and_triangles_equal_brute_force(spark):
    import random
    from itertools import combinations

    r = random.Random(4)
    pairs = {(r.randrange(60), r.randrange(60)) for _ in range(70)}
    edges, label = spark.createDataFrame(sorted(pairs), "src bigint, dst bigint"), list(range(60))
    while any(label[a] != label[b] for a, b in pairs):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert dict(rows(wl.connected_components(spark.range(60), edges))) == dict(enumerate(label))
    both = {frozenset(p) for p in pairs}
    assert wl.triangles(edges).first()[0] == sum({frozenset((a, b)), frozenset((a, c)), frozenset((b, c))} <= both for a, b, c in combinations(range(60), 3))


def test_sql_text_over_registered_views(spark):
    from tideworks.plans import sqltexts
    from tideworks.sources import auctions as source

    events = source.batch(spark, 2000)
    source.register_views(events)
    persons, auctions, bids = source.views(events)
    assert sqltexts.run(spark, "q2", divisor="7").count() == bids.where("auction % 7 = 0").count() > 0
    assert rows(sqltexts.run(spark, "q3", category="11")) == rows(nex.q3(persons, auctions, category=11))
    assert rows(sqltexts.run(spark, "q7")) == rows(nex.q7(bids))


def test_fixpoints_end_whole_or_fail(spark):
    chain = spark.range(8).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    vertices = spark.range(9)
    assert rows(wl.connected_components(vertices, chain)) == [(i, 0) for i in range(9)]
    with pytest.raises(RuntimeError):
        wl.connected_components(vertices, chain, 3)
    with pytest.raises(RuntimeError):
        wl.transitive_closure(chain, 2)
