"""Hand-made rows for each rule of the auction queries and workloads."""

from datetime import datetime, timedelta

import pytest

from tideworks.functions import scalars
from tideworks.plans import auctions as nex
from tideworks.plans import workloads as wl
from tideworks.sources import auctions as source
from pyspark.sql import functions as F

T0 = datetime(2024, 1, 1)
AUCTION = "id bigint, seller bigint, category bigint, reserve bigint, dateTime timestamp, expires timestamp"
BID = "auction bigint, bidder bigint, price bigint, dateTime timestamp, extra string"


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def auction(spark):
    return spark.createDataFrame([(1, 7, 10, 10, at(0), at(10)), (2, 7, 10, 0, at(0), at(10)), (3, 8, 11, 0, at(0), at(10))], AUCTION)


def test_winning_bid_needs_reserve_and_half_open_time(spark, auction):
    bid = spark.createDataFrame([(1, 1, 99, at(-1), ""), (1, 2, 10, at(0), ""), (1, 3, 98, at(10), ""), (1, 4, 9, at(5), ""), (9, 1, 5, at(1), "")], BID)
    assert rows(nex.winning_bids(auction, bid).select("id", "bidder", "price")) == [(1, 2, 10)]
    assert rows(nex.q4(auction, bid)) == [(10, 10.0)]
    assert rows(nex.q4_sql(auction, bid)) == [(10, 98.0)]


def test_ties_go_to_the_earliest_then_the_lowest_bidder(spark, auction):
    bid = spark.createDataFrame([(2, 5, 50, at(3), ""), (2, 9, 50, at(2), ""), (2, 8, 50, at(2), "")], BID)
    assert rows(nex.winning_bids(auction, bid).select("id", "bidder")) == [(2, 8)]


def test_q6_frames_hold_ten_or_eleven_rows(spark):
    n = 12
    auction = spark.createDataFrame([(i, 1, 10, 0, at(0), at(100 + i)) for i in range(n)], AUCTION)
    bid = spark.createDataFrame([(i, 1, i, at(1), "") for i in range(n)], BID)
    ten, eleven = dict((r.id, r.avg_price) for r in nex.q6(auction, bid).collect()), dict((r.id, r.avg_price) for r in nex.q6_sql(auction, bid).collect())
    assert ten[0] == 0 and ten[11] == sum(range(2, 12)) / 10 and eleven[11] == sum(range(1, 12)) / 11


def test_q5_q7_keep_ties(spark):
    bid = spark.createDataFrame([(1, 1, 5, at(1), ""), (2, 2, 5, at(2), ""), (3, 3, 4, at(3), "")], BID)
    assert sorted(r.auction for r in nex.q7(bid).collect()) == [1, 2]
    assert rows(nex.q7_top1(bid).select("auction", "bidder")) == [(1, 1)]
    assert {r.auction for r in nex.q5(bid).where(F.col("window_start") == F.lit(at(0))).collect()} == {1, 2, 3}
    assert {r.auction for r in nex.q5_top1(bid).collect()} <= {1, 3, 2}


def test_q8_same_window_only(spark):
    person = spark.createDataFrame([(1, "a", at(1)), (1, "a", at(2)), (2, "b", at(9))], "id bigint, name string, dateTime timestamp")
    sold = spark.createDataFrame([(1, 5, at(3)), (1, 6, at(4)), (2, 7, at(11))], "seller bigint, reserve bigint, dateTime timestamp")
    assert rows(nex.q8(person, sold).select("id", "name")) == [(1, "a")]
    assert len(rows(nex.q8_pairs(person, sold))) == 4


def test_q1_prices(spark):
    bid = spark.createDataFrame([(1, 1, 1000, at(0), "")], BID)
    assert str(nex.q1(bid).first().price) == "908.000" and nex.q1(bid, exact=False).first().price == 908
    assert nex.q1(bid).schema["price"].dataType.simpleString() == "decimal(23,3)"


def test_week_numbers(spark):
    days = [("2024-01-06", 0), ("2024-01-07", 1), ("2024-02-29", 8), ("2024-12-31", 52), ("2023-12-31", 52)]
    df = spark.createDataFrame(days, "d string, w int")
    assert df.where(scalars.week_of_year(F.to_date("d")) != F.col("w")).isEmpty()


def test_factors_count_once_per_accident_and_blanks_not(spark):
    df = spark.sql("select date'2024-01-01' date, 'x' borough, 1 killed, array('a','a','','b','') factors")
    assert rows(wl.by_factor(df)) == [("a", 1, 1, 100.0), ("b", 1, 1, 100.0)]
    assert rows(wl.lethal_by_week(df)) == [(2024, 0, 1)]


def test_words(spark):
    df = spark.createDataFrame([("Ab c3D x-é end",), ("ab END",), (None,), ("",)], "line string")
    want = [("ab", 2), ("c", 1), ("d", 1), ("end", 2), ("x", 1)]
    assert rows(wl.word_count(df, "line")) == want and rows(wl.word_count(df, "line", by_split=True)) == want


def test_graphs(spark):
    v = spark.createDataFrame([(i,) for i in range(6)], "id bigint")
    e = spark.createDataFrame([(0, 1), (1, 2), (3, 4)], "src bigint, dst bigint")
    assert rows(wl.connected_components(v, e)) == [(0, 0), (1, 0), (2, 0), (3, 3), (4, 3), (5, 5)]
    assert rows(wl.transitive_closure(e)) == [(0, 1), (0, 2), (1, 2), (3, 4)]
    noisy = spark.createDataFrame([(0, 1), (1, 0), (1, 2), (2, 0), (2, 2), (1, 2), (3, 4)], "src bigint, dst bigint")
    assert rows(wl.triangles(noisy)) == [(1,)] and rows(wl.triangles(e)) == [(0,)]


def test_pagerank_of_dangling_pages(spark):
    v = spark.createDataFrame([(0,), (1,), (2,)], "id bigint")
    e = spark.createDataFrame([(0, 1)], "src bigint, dst bigint")
    assert [(p, round(r, 6)) for p, r in rows(wl.pagerank(v, e, 1))] == [(0, 0.05), (1, round(0.05 + 0.85 / 3, 6)), (2, 0.05)]
    assert [p for p, _ in rows(wl.pagerank_inlinks(v, e, 1))] == [1]
    assert rows(wl.pagerank_integer(v, e, 1)) == [(0, 1_000_000), (1, 6_000_000), (2, 1_000_000)]


def test_kmeans_and_collatz(spark):
    p = spark.createDataFrame([(0, 0.0, 0.0), (1, 10.0, 0.0), (2, 1.0, 0.0), (3, 11.0, 0.0)], "id bigint, x double, y double")
    centres, placed = wl.kmeans(p, 2, 10, tolerance=0.1)
    assert centres == [(0, [0.5, 0.0]), (1, [10.5, 0.0])] and rows(placed.select("id", "centre")) == [(0, 0), (1, 1), (2, 0), (3, 1)]
    assert rows(wl.collatz(spark.range(1, 10).toDF("n"))) == [(19, 9)]


def test_source_is_the_same_for_any_partitions(spark):
    one, many = (sorted(map(str, source.batch(spark, 500, partitions=n).collect())) for n in (1, 7))
    assert one == many
    person, auction, bid = source.views(source.batch(spark, 500))
    assert (person.count(), auction.count(), bid.count()) == (10, 30, 460)
    assert bid.join(auction, F.col("auction") == F.col("id"), "left_anti").isEmpty()
