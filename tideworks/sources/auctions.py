"""A deterministic source of auction events.

Every field is a hash of the event's number, so any partitioning of the numbers gives the same events, in batch
(``spark.range``) and in streams (Spark's micro-batch rate source) alike, inside generated code.  Of every 50 events
one is a person, three are auctions and the rest bids, unless other proportions are asked for.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STATES = ("AZ", "CA", "ID", "OR", "WA", "WY")
CITIES = ("Phoenix", "Los Angeles", "San Francisco", "Boise", "Portland", "Bend", "Redmond", "Seattle", "Kent", "Cheyenne")


@dataclass(frozen=True)
class AuctionSource:
    persons: int = 1
    auctions: int = 3
    bids: int = 46
    events_per_second: int = 10_000
    start: str = "2024-01-01 00:00:00"
    categories: int = 5
    auction_seconds: int = 60
    seed: int = 1


def _draw(number: Column, field: int, below: int | Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(number, F.lit(seed), F.lit(field)), F.lit(below) if isinstance(below, int) else below)


def from_numbers(numbers: DataFrame, number: str, s: AuctionSource) -> DataFrame:
    """Events (event_type, person, auction, bid, dateTime) of the numbers; event_type is 0, 1 or 2."""
    n, every = F.col(number), s.persons + s.auctions + s.bids
    turn, epoch = F.pmod(n, F.lit(every)), F.floor(n / every)
    kind = F.when(turn < s.persons, 0).when(turn < s.persons + s.auctions, 1).otherwise(2)
    time = F.timestamp_micros(F.unix_micros(F.lit(s.start).cast("timestamp")) + F.floor(n * 1_000_000 / s.events_per_second))
    person_id = epoch * s.persons + turn
    auction_id = epoch * s.auctions + turn - s.persons
    some_person, some_auction = _draw(n, 1, (epoch + 1) * s.persons, s.seed), _draw(n, 2, (epoch + 1) * s.auctions, s.seed)
    pick = lambda field, values: F.element_at(F.array(*[F.lit(v) for v in values]), (_draw(n, field, len(values), s.seed) + 1).cast("int"))
    price = _draw(n, 3, 10_000_000, s.seed) + 100
    person = F.struct(person_id.alias("id"), F.concat(F.lit("person "), person_id).alias("name"), F.concat(F.lit("p"), person_id, F.lit("@example.com")).alias("emailAddress"), F.lpad(_draw(n, 4, 10**16, s.seed).cast("string"), 16, "0").alias("creditCard"), pick(5, CITIES).alias("city"), pick(6, STATES).alias("state"), time.alias("dateTime"), F.lit("").alias("extra"))
    auction = F.struct(auction_id.alias("id"), F.concat(F.lit("item "), auction_id).alias("itemName"), F.lit("").alias("description"), price.alias("initialBid"), (price + _draw(n, 7, 100_000, s.seed)).alias("reserve"), time.alias("dateTime"), (time + F.make_interval(secs=F.lit(s.auction_seconds))).alias("expires"), some_person.alias("seller"), (_draw(n, 8, s.categories, s.seed) + 10).alias("category"), F.lit("").alias("extra"))
    bid = F.struct(some_auction.alias("auction"), some_person.alias("bidder"), price.alias("price"), F.concat(F.lit("channel-"), _draw(n, 9, 100, s.seed)).alias("channel"), F.concat(F.lit("https://example.com/item/"), some_auction).alias("url"), time.alias("dateTime"), F.lit("").alias("extra"))
    return numbers.select(kind.alias("event_type"), F.when(kind == 0, person).alias("person"), F.when(kind == 1, auction).alias("auction"), F.when(kind == 2, bid).alias("bid"), time.alias("dateTime"))


def batch(spark: SparkSession, events: int, s: AuctionSource | None = None, partitions: int | None = None) -> DataFrame:
    return from_numbers(spark.range(0, events, 1, partitions), "id", s or AuctionSource())


def stream(spark: SparkSession, s: AuctionSource | None = None, *, rows_per_batch: int = 100_000, partitions: int = 8, delay: str = "4 seconds") -> DataFrame:
    """The events as a stream that a watermark of ``delay`` follows."""
    numbers = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", rows_per_batch).option("numPartitions", partitions).load()
    return from_numbers(numbers, "value", s or AuctionSource()).withWatermark("dateTime", delay)


def views(events: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Persons, auctions and bids of a stream or table of events."""
    kind = lambda k, name: events.where(F.col("event_type") == k).select(f"{name}.*")
    return kind(0, "person"), kind(1, "auction"), kind(2, "bid")


def register_views(events: DataFrame) -> None:
    """Temporary views person, auction and bid, replacing older ones."""
    for name, view in zip(("person", "auction", "bid"), views(events), strict=True):
        view.createOrReplaceTempView(name)
