"""Streams over hand-made tables, in one micro-batch and in several."""

from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from tideworks.plans import auctions as nex
from tideworks.plans import registry
from tideworks.session import scratch_path
from tideworks.streaming import processors, runs, tables

T0 = datetime(2024, 1, 1)
AUCTION = "id bigint, seller bigint, category bigint, reserve bigint, dateTime timestamp, expires timestamp"
BID = "auction bigint, bidder bigint, price bigint, dateTime timestamp"


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture
def odd_tables(spark, tmp_path):
    """Orders and lines with nulls in each column, ties, repeated lines and times before 1970."""
    old = datetime(1960, 5, 1)
    orders = [(k, None if k == 2 else 7, None if k == 3 else 100.0, None if k == 4 else old if k == 5 else T0) for k in range(1, 12)] + [(None, 7, 100.0, T0)]
    lines = [(k, None if k == 6 else s, None if (k, s) == (7, 1) else 500.0 + s // 2, None if (k, s) == (8, 3) else (old if k == 5 else T0) + timedelta(days=s if k != 9 else 400)) for k in range(1, 11) for s in (1, 2, 3, 3)]
    lines += [(10, None, 501.0, T0 + timedelta(days=2)), (99, 1, 500.0, T0), (None, 1, 500.0, T0)]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderdate timestamp_ntz").repartition(3).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey bigint, l_suppkey bigint, l_extendedprice double, l_shipdate timestamp_ntz").withColumn("l_linestatus", F.lit("O")).repartition(3).write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["stream_winning_bids", "stream_q4", "stream_q6"])
def test_streams_of_odd_rows_equal_sql(spark, odd_tables, name):
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.execute(f"create view {t} as select * from '{odd_tables}/{t}.parquet/*.parquet'")
    want = con.execute(registry.SQL[name])
    columns = [c[0] for c in want.description]
    expected = sorted(map(str, want.fetchall()))
    assert expected and sorted(str(tuple(r)) for r in registry.QUERIES[name](spark, odd_tables).select(*columns).collect()) == expected


def test_winning_bids_read_each_row_once(spark, odd_tables, monkeypatch):
    """What a micro-batch does with its rows shares one reading and one shuffle of them."""
    read, plans, streamed, write = spark.sparkContext.accumulator(0), {}, runs.streamed, tables.Tables.write

    def counted(_):
        read.add(1)
        return True

    def planned(self, df, name, number):
        plans[name, number] = df._jdf.queryExecution().executedPlan().toString()
        return write(self, df, name, number)

    count = F.udf(counted, "boolean").asNondeterministic()
    monkeypatch.setattr(runs, "streamed", lambda *args: streamed(*args).where(count(F.lit(0))))
    monkeypatch.setattr(tables.Tables, "write", planned)
    monkeypatch.setattr(runs, "ROWS", 20)
    found = runs.winning(spark, odd_tables).count()
    assert found and read.value == sum(spark.read.parquet(f"{odd_tables}/{t}.parquet").count() + 1 for t in ("orders", "lineitem"))
    assert "Exchange hashpartitioning" not in plans["bids", 0] and "ExistingRDD" not in plans["open", 0]
    assert (spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.shuffle.partitions")) == ("true", "4")


def test_stream_of_several_micro_batches(spark, tmp_path, monkeypatch):
    """Auctions stay open over micro-batches with and without bids; bids are not dealt out again beside those that were kept."""
    write, plans = tables.Tables.write, {}

    def planned(self, df, name, number):
        plans[name, number] = df._jdf.queryExecution().executedPlan().toString()
        return write(self, df, name, number)

    monkeypatch.setattr(tables.Tables, "write", planned)
    auctions = [[(k, 1, 10, 1, at(100 * n), at(100 * n + 250)) for k in range(10 * n, 10 * n + 10)] for n in range(4)] + [[(99, 1, 10, 1, at(9000), at(9001))]]
    bids = [[(99, 1, 1, at(0))], *[[(k, n, n, at(100 * n + k)) for k in range(40)] for n in (1, 2, 3)], [(98, 1, 1, at(9000))]]
    for n, (a, b) in enumerate(zip(auctions, bids, strict=True)):
        spark.createDataFrame(a, AUCTION).coalesce(1).write.parquet(f"{tmp_path}/a/{n}")
        spark.createDataFrame(b, BID).coalesce(1).write.parquet(f"{tmp_path}/b/{n}")
    stream = lambda name, kind: spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}/*")
    both = processors.auctions_and_bids(stream("a", AUCTION), stream("b", BID)).repartition("id")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = runs.finished(both, each=tables.WinningBids(scratch_path(spark, "w")), spark_sql_adaptive_enabled="false")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    want = nex.winning_bids(spark.createDataFrame([x for a in auctions[:4] for x in a], AUCTION), spark.createDataFrame([x for b in bids for x in b], BID))
    assert rows(found) == rows(want) and found.count() == 40
    assert [plans["bids", n].count("ENSURE_REQUIREMENTS") for n in range(5)] == [0, 1, 1, 1, 1]


@pytest.fixture
def parts():
    """What comes in each of five micro-batches: auctions and bids, and the auctions that are closed after it."""
    auctions = [(i, i % 2, 10, 5, at(begin), at(100 * i)) for i, begin in enumerate((0, 60, 60, 200), 1)]
    return [
        ([auctions[0]], [(1, 1, 9, at(1)), (2, 1, 7, at(61)), (2, 2, 7, at(61))], []),  # bids before their auctions
        ([auctions[1], auctions[2]], [(1, 2, 9, at(99)), (1, 3, 10, at(100)), (3, 1, 6, at(104))], [1]),
        ([], [(1, 4, 50, at(50)), (2, 3, 8, at(150)), (3, 1, 4, at(160))], [1]),  # the first is late
        ([auctions[3]], [(2, 4, 8, at(157)), (4, 8, 5, at(210)), (9, 1, 99, at(290))], [1, 2]),
        ([], [(3, 2, 6, at(299)), (4, 9, 5, at(399)), (9, 1, 99, at(900))], [1, 2, 3, 4]),
    ]


def test_windows_close_over_several_batches(spark, parts):
    """Each auction comes out once, in the batch whose watermark passes its end; a batch that is run again gives the same."""
    rule, means = tables.WinningBids(scratch_path(spark, "w")), tables.LastMeans(scratch_path(spark, "m"), 2)
    frames = [processors.auctions_and_bids(spark.createDataFrame(a, AUCTION), spark.createDataFrame(b, BID)) for a, b, _ in parts]
    on_time = [b for n, (_, bids, _) in enumerate(parts) for b in bids if (n, b[1]) != (2, 4)]
    auctions = [a for x, _, _ in parts for a in x]
    want = nex.winning_bids(spark.createDataFrame(auctions, AUCTION), spark.createDataFrame(on_time, BID))
    found, averages = [], []
    for number, batch in enumerate(frames):
        won = rule(batch, number).collect()
        if number in (0, 2):
            assert rule(batch, number).collect() == won
        found += won
        assert sorted(r.id for r in found) == parts[number][2]
        averages += means(spark.createDataFrame(won, tables.BEST), number).collect()
    assert sorted(map(str, found)) == rows(want)
    assert {r.id: r.avg_price for r in averages} == {1: 9.0, 2: 8.0, 3: 7.5, 4: 6.5}
    assert {r.id: r.bidder for r in found} == {1: 1, 2: 3, 3: 1, 4: 8}


def test_bids_without_auctions_leave(spark):
    rule = tables.WinningBids(scratch_path(spark, "w"), orphan_days=1)
    bid = lambda *b: processors.auctions_and_bids(spark.createDataFrame([], AUCTION), spark.createDataFrame(list(b), BID))
    kept = lambda n: {r.id for r in rule.tables.read(spark, "bids", n, tables.BEST).collect()}
    for number, batch in enumerate([bid((1, 1, 5, at(0)), (2, 1, 5, at(90_000))), bid((3, 1, 5, at(90_001))), bid((4, 1, 5, at(90_002)))]):
        assert rule(batch, number).count() == 0
    assert kept(2) == {2, 3, 4}


def test_timers_and_tables_agree(spark, parts):
    """The operator by key and timer over the same rows."""
    folder = scratch_path(spark, "in")
    every = [(spark.createDataFrame(a, AUCTION), spark.createDataFrame(b, BID)) for a, b, _ in (([x for p in parts for x in p[0]], [x for p in parts for x in p[1]], []),)]
    every[0][0].write.parquet(f"{folder}/a")
    every[0][1].write.parquet(f"{folder}/b")
    stream = lambda name, kind: spark.readStream.schema(kind).parquet(f"{folder}/{name}")
    timers = runs.finished(processors.winning_bids(stream("a", AUCTION), stream("b", BID)))
    both = runs.finished(processors.auctions_and_bids(stream("a", AUCTION), stream("b", BID)), each=tables.WinningBids(scratch_path(spark, "w")))
    assert rows(timers) == rows(both.select(*timers.columns)) and both.count() == 4
    follow = both.withColumns({c: F.col(c).cast("timestamp") for c in ("dateTime", "expires", "bidTime")})
    follow.write.parquet(f"{folder}/won")
    won = lambda: spark.readStream.schema(follow.schema).parquet(f"{folder}/won")
    assert rows(runs.finished(processors.last_means(won(), 2))) == rows(runs.finished(won(), each=tables.LastMeans(scratch_path(spark, "m"), 2)))
