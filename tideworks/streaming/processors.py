"""Stateful operators that windows of fixed size cannot express, by key and timer: for streams of few rows at a time.

Each key and change of state is a call from the JVM into Python; ``tables`` does the same over micro-batches of many rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

WON = "id bigint, seller bigint, category bigint, reserve bigint, dateTime timestamp, expires timestamp, bidder bigint, price bigint, bidTime timestamp"
MEANS = "id bigint, seller bigint, avg_price double"


def _millis(t: datetime) -> int:
    return int((t if t.tzinfo else t.astimezone(timezone.utc)).timestamp() * 1000)


class WinningBid(StatefulProcessor):
    """A window per auction that its own ``expires`` closes.

    Bids may come before their auction, so all are kept until the watermark passes the end; then the best valid one is
    emitted and the state cleared.  Once the auction is known only the best bid so far is kept.  Bids whose auction
    does not come leave with a timer ``orphan_days`` after their own time.
    """

    def __init__(self, orphan_days: int = 4000):
        self.orphan_millis = orphan_days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.auction = handle.getValueState("auction", "seller bigint, category bigint, reserve bigint, begin timestamp, expires timestamp")
        self.bids = handle.getListState("bids", "bidder bigint, price bigint, time timestamp")

    @staticmethod
    def _best(auction: Any, bids: list) -> list:
        if None in auction:
            return []
        valid = [b for b in bids if None not in b and b[1] >= auction[2] and auction[3] <= b[2] < auction[4]]
        return [min(valid, key=lambda b: (-b[1], b[2], b[0]))] if valid else []

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        bids = list(self.bids.get()) if self.bids.exists() else []
        auction = self.auction.get() if self.auction.exists() else None
        latest = None
        for r in rows:
            if r.is_auction:
                auction = (r.seller, r.category, r.reserve, r.dateTime, r.expires)
                self.auction.update(auction)
                self.handle.registerTimer(_millis(r.expires))
            else:
                bids.append((r.bidder, r.price, r.dateTime))
                latest = r.dateTime if latest is None or r.dateTime > latest else latest
        if auction is not None:
            bids = self._best(auction, bids)
        elif latest is not None:
            self.handle.registerTimer(_millis(latest) + self.orphan_millis)
        self.bids.put([tuple(b) for b in bids]) if bids else self.bids.clear()
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        auction = self.auction.get() if self.auction.exists() else None
        if auction is None:
            self.bids.clear()
            return
        if _millis(auction[4]) > expiredTimerInfo.getExpiryTimeInMs():
            return
        bids = self._best(auction, list(self.bids.get()) if self.bids.exists() else [])
        self.auction.clear()
        self.bids.clear()
        for b in bids:
            yield Row(id=key[0], seller=auction[0], category=auction[1], reserve=auction[2], dateTime=auction[3], expires=auction[4], bidder=b[0], price=b[1], bidTime=b[2])

    def close(self) -> None:
        pass


class LastMeans(StatefulProcessor):
    """Per seller, the mean price of the last n auctions at each one, in order of end and id within a batch."""

    def __init__(self, n: int = 10):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.prices = handle.getListState("prices", "price bigint")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        last = [p[0] for p in self.prices.get()] if self.prices.exists() else []
        for r in sorted(rows, key=lambda r: (r.expires, r.id)):
            last = [*last, r.price][-self.n :]
            yield Row(id=r.id, seller=key[0], avg_price=sum(last) / len(last))
        self.prices.put([(p,) for p in last])

    def close(self) -> None:
        pass


def auctions_and_bids(auction: DataFrame, bid: DataFrame) -> DataFrame:
    """One stream of both."""
    none = lambda kind: F.lit(None).cast(kind)
    opened = auction.select("id", F.lit(True).alias("is_auction"), "seller", "category", "reserve", "dateTime", "expires", none("bigint").alias("bidder"), none("bigint").alias("price"))
    made = bid.select(F.col("auction").alias("id"), F.lit(False).alias("is_auction"), none("bigint").alias("seller"), none("bigint").alias("category"), none("bigint").alias("reserve"), "dateTime", none("timestamp").alias("expires"), "bidder", "price")
    return opened.unionByName(made)


def winning_bids(auction: DataFrame, bid: DataFrame, delay: str = "4 seconds") -> DataFrame:
    """The stream of winning bids, each when the watermark passes its auction's end."""
    both = auctions_and_bids(auction, bid).withWatermark("dateTime", delay)
    return both.groupBy("id").transformWithState(WinningBid(), WON, outputMode="append", timeMode="eventTime")


def last_means(won: DataFrame, n: int = 10) -> DataFrame:
    return won.groupBy("seller").transformWithState(LastMeans(n), MEANS, outputMode="append", timeMode="none")
