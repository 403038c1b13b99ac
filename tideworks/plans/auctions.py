"""The auction queries q0 to q8, as functions of DataFrames of persons, auctions and bids.

Those without a window frame or an order take batch and streaming input alike.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideworks.functions.scalars import euros, euros_float
from tideworks.operators.relational import with_max
from tideworks.operators.windows import closing, hopping_counts, last_rows, tumbling


def q0(bid: DataFrame) -> DataFrame:
    return bid.select("auction", "bidder", "price", "dateTime", "extra")


def q1(bid: DataFrame, exact: bool = True) -> DataFrame:
    return bid.select("auction", "bidder", (euros if exact else euros_float)(F.col("price")).alias("price"), "dateTime", "extra")


def q2(bid: DataFrame, divisor: int = 123) -> DataFrame:
    return bid.where(F.col("auction") % divisor == 0).select("auction", "price")


def q3(person: DataFrame, auction: DataFrame, states: Sequence[str] = ("OR", "ID", "CA"), category: int = 10) -> DataFrame:
    sellers = person.where(F.upper("state").isin(*states)).select("name", "city", "state", F.col("id").alias("seller"))
    return auction.where(F.col("category") == category).select("id", "seller").join(sellers, "seller").select("name", "city", "state", "id")


def winning_bids(auction: DataFrame, bid: DataFrame) -> DataFrame:
    """Each auction's best bid of at least its reserve, made from its start up to before its end.

    The highest price wins, then the earliest, then the lowest bidder.  Auctions without such a bid have no row.
    Join and aggregate share the auction's key, so the bids move once.
    """
    offers = bid.select("auction", "bidder", "price", F.col("dateTime").alias("bidTime"))
    held = closing(auction, offers, "id", "auction", "dateTime", "expires", "bidTime", F.col("price") >= F.col("reserve"))
    best = F.min_by(F.struct("bidder", "price", "bidTime"), F.struct(-F.col("price"), F.col("bidTime"), F.col("bidder")))
    return held.groupBy("id", "seller", "category", "reserve", "dateTime", "expires").agg(best.alias("_b")).select("id", "seller", "category", "reserve", "dateTime", "expires", "_b.*")


def q4(auction: DataFrame, bid: DataFrame) -> DataFrame:
    return winning_bids(auction, bid).groupBy("category").agg(F.avg("price").alias("avg_price"))


def _final_prices(auction: DataFrame, bid: DataFrame, *keys: str) -> DataFrame:
    """Highest price of each auction by the looser rule: no reserve, and both ends of its time count."""
    offers = bid.select("auction", "price", F.col("dateTime").alias("bidTime"))
    held = auction.join(offers, F.col("id") == F.col("auction")).where(F.col("bidTime").between(F.col("dateTime"), F.col("expires")))
    return held.groupBy("id", *keys).agg(F.max("price").alias("final"))


def q4_sql(auction: DataFrame, bid: DataFrame) -> DataFrame:
    return _final_prices(auction, bid, "category").groupBy("category").agg(F.avg("final").alias("avg_price"))


def q5(bid: DataFrame, slide: str = "2 seconds", slides: int = 5) -> DataFrame:
    """Of each hopping window the auctions with the most bids, all of them if they tie."""
    return with_max(hopping_counts(bid, "dateTime", slide, slides, ["auction"]), ["window_start"], "num").select("window_start", "auction", "num")


def q5_top1(bid: DataFrame, slide: str = "2 seconds", slides: int = 5) -> DataFrame:
    """One auction per window: of those that tie, the least."""
    return q5(bid, slide, slides).groupBy("window_start", "num").agg(F.min("auction").alias("auction"))


def q6(auction: DataFrame, bid: DataFrame, last: int = 10) -> DataFrame:
    """Mean price of a seller's last auctions, at each of them."""
    frame = last_rows(["seller"], ["expires", "id"], last)
    return winning_bids(auction, bid).select("id", "seller", F.avg("price").over(frame).alias("avg_price"))


def q6_sql(auction: DataFrame, bid: DataFrame) -> DataFrame:
    """The looser rule with eleven rows."""
    frame = last_rows(["seller"], ["expires", "id"], 11)
    return _final_prices(auction, bid, "seller", "expires").select("id", "seller", F.avg("final").over(frame).alias("avg_price"))


def q7(bid: DataFrame, size: str = "10 seconds") -> DataFrame:
    """Of each window the bids with the highest price."""
    return with_max(tumbling(bid.select("auction", "bidder", "price", "dateTime"), "dateTime", size), ["window_start"], "price").select("window_start", "auction", "price", "bidder")


def q7_top1(bid: DataFrame, size: str = "10 seconds") -> DataFrame:
    best = F.min(F.struct(F.col("auction"), F.col("bidder")))
    return q7(bid, size).groupBy("window_start", "price").agg(best.alias("_b")).select("window_start", "price", "_b.*")


def q8(person: DataFrame, auction: DataFrame, size: str = "10 seconds") -> DataFrame:
    """Persons who joined and sold within one window, each once."""
    people = person.groupBy("id", "name", F.window("dateTime", size).alias("w")).agg(F.lit(1).alias("_p"))
    sellers = auction.groupBy("seller", F.window("dateTime", size).alias("w")).agg(F.lit(1).alias("_a"))
    return people.join(sellers.withColumnRenamed("seller", "id"), ["id", "w"]).select("id", "name", F.col("w.start").alias("starttime"))


def q8_pairs(person: DataFrame, auction: DataFrame, size: str = "10 seconds") -> DataFrame:
    """Every pair of a person and one of their auctions in one window, with the reserve."""
    people = person.select("id", "name", F.window("dateTime", size).alias("w"))
    sold = auction.select(F.col("seller").alias("id"), "reserve", F.window("dateTime", size).alias("w"))
    return people.join(sold, ["id", "w"]).select("id", "name", "reserve")


def running_average(auction: DataFrame, bid: DataFrame, part: str = "day") -> DataFrame:
    """Mean winning price of a category as each of its auctions closes.

    Auctions are ordered within parts of time; what came before a part is added up from one row a part, so no task sorts
    a whole category.
    """
    won = winning_bids(auction, bid).select("id", "category", "price", "expires", F.date_trunc(part, "expires").alias("_part"))
    keys = ["category", "_part"]
    earlier = Window.partitionBy("category").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = won.groupBy(*keys).agg(F.sum("price").alias("_sum"), F.count("*").alias("_count"))
    before = sums.select(*keys, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_sum"), F.coalesce(F.sum("_count").over(earlier), F.lit(0)).alias("_count"))
    frame = Window.partitionBy(*keys).orderBy("expires", "id").rowsBetween(Window.unboundedPreceding, 0)
    mean = (F.col("_sum") + F.sum("price").over(frame)).cast("double") / (F.col("_count") + F.count("*").over(frame))
    return won.join(before, keys).select("id", "category", mean.alias("avg_price"))
