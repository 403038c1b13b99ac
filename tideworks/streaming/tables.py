"""State of streams in tables of the shared folder, which each micro-batch reads, joins with its rows and writes anew.

Rows cost what they cost in the batch queries, so this is for micro-batches of many rows; ``processors`` has the same
windows by key and timer, whose cost is a call from the JVM into Python per key and change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tideworks.session import freed_shuffles

AUCTION = "id bigint, seller bigint, category bigint, reserve bigint, dateTime timestamp, expires timestamp"
BEST = f"{AUCTION}, bidder bigint, price bigint, bidTime timestamp"
LAST = "id bigint, seller bigint, price bigint, expires timestamp, at bigint, avg_price double, last boolean"
BID = ["id", "bidder", "price", "bidTime"]
MARK = "mark bigint, end bigint"
OPENED = "is_auction and id is not null and reserve is not null and expires is not null"


def empty(spark: SparkSession, schema: str | StructType) -> DataFrame:
    fields = (StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    return spark.range(0).where("false").select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in fields])


class Tables:
    """A table of each micro-batch by name; a batch that is run again finds those of the batch before as they were."""

    def __init__(self, folder: str):
        self.folder = folder

    def write(self, df: DataFrame, name: str, number: int) -> DataFrame:
        with freed_shuffles(df.sparkSession):
            df.write.mode("overwrite").parquet(f"{self.folder}/{name}-{number}")
        if number > 1:  # no batch reads these again
            empty(df.sparkSession, df.schema).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/{name}-{number - 2}")
        return self.read(df.sparkSession, name, number, df.schema)

    def read(self, spark: SparkSession, name: str, number: int, schema: str | StructType) -> DataFrame:
        """number: -1 before the first batch."""
        return spark.read.schema(schema).parquet(f"{self.folder}/{name}-{number}") if number >= 0 else empty(spark, schema)


class WinningBids:
    """Per micro-batch the winning bids of auctions whose end the watermark has passed.

    The watermark is the greatest time seen less ``delay``; rows at or before that of the batch before are late and go.
    Open auctions are kept with the best valid bid so far, and bids without an auction until ``orphan_days`` after
    their own time.  Rows that cannot win or be won (null in id, time, price, reserve or end) are not kept.  The rows are
    not read for open auctions where the last end is passed.
    """

    def __init__(self, folder: str, delay: str = "4 seconds", orphan_days: int = 4000):
        self.tables, self.delay, self.orphan_days = Tables(folder), delay, orphan_days

    def _marks(self, batch: DataFrame, number: int) -> tuple[Column, Column, bool]:
        """The watermark before and after a batch, null while no time has been seen; whether an auction ends after it."""
        spark = batch.sparkSession
        before = self.tables.read(spark, "mark", number - 1, MARK).collect()
        seen = batch.agg(F.unix_micros(F.max("dateTime") - F.expr(f"interval {self.delay}")), F.unix_micros(F.max(F.when(F.expr(OPENED), F.col("expires"))))).collect()
        after, end = (max((m for m in found if m is not None), default=None) for found in zip(*before, *seen, strict=True))
        self.tables.write(spark.range(1).coalesce(1).select(F.lit(after).cast("bigint").alias("mark"), F.lit(end).cast("bigint").alias("end")), "mark", number)
        late, mark = (F.timestamp_micros(F.lit(m).cast("bigint")) for m in (before[0].mark if before else None, after))
        return late, mark, None not in (after, end) and end > after

    def __call__(self, batch: DataFrame, number: int) -> DataFrame:
        spark = batch.sparkSession
        late, mark, stays = self._marks(batch, number)
        rows = batch.where((F.col("dateTime") > late) | (late.isNull() & F.col("dateTime").isNotNull()))
        opened = rows.where(OPENED).select("id", "seller", "category", "reserve", "dateTime", "expires")
        made = rows.where("not is_auction and id is not null and price is not null").select("id", "bidder", "price", F.col("dateTime").alias("bidTime"))
        auctions = self.tables.read(spark, "open", number - 1, AUCTION).unionByName(opened)
        # Dealt out as the rows of a stream that is dealt out by auction, so that the join takes both as they are.
        bids = self.tables.read(spark, "bids", number - 1, BEST).where(self._needed(late)).select(*BID).repartition("id").unionByName(made)
        orphan = F.col("expires").isNull()
        valid = (F.col("price") >= F.col("reserve")) & (F.col("bidTime") >= F.col("dateTime")) & (F.col("bidTime") < F.col("expires"))
        bid = F.struct("bidder", "price", "bidTime")
        best = F.min_by(bid, F.struct(-F.col("price"), F.col("bidTime"), F.col("bidder").isNull(), F.col("bidder")))
        keys = ["id", "seller", "category", "reserve", "dateTime", "expires"]
        # A bid without an auction is a group of its own, so one pass over the bids has both.
        held = bids.join(auctions, "id", "left").where(orphan | valid).groupBy(*keys, F.when(orphan, bid).alias("_own")).agg(best.alias("_b")).select(*keys, "_b.*")
        found = self.tables.write(held, "bids", number)
        self.tables.write(auctions.where(F.col("expires") > mark).distinct() if stays else empty(spark, AUCTION), "open", number)
        return found.where(F.col("expires") <= mark)

    def _needed(self, mark: Column) -> Column:
        """Bids of open auctions and of those that may still come."""
        leaves = F.coalesce(F.col("expires"), F.col("bidTime") + F.expr(f"interval {self.orphan_days} days"))
        return mark.isNull() | (leaves > mark)


class LastMeans:
    """Per seller, the mean price of the last n auctions at each one, in order of end and id within a batch."""

    def __init__(self, folder: str, n: int = 10):
        self.tables, self.n = Tables(folder), n

    def __call__(self, batch: DataFrame, number: int) -> DataFrame:
        columns = ["id", "seller", "price", "expires", "at"]
        rows = self.tables.read(batch.sparkSession, "means", number - 1, LAST).where("last").select(*columns)
        rows = rows.unionByName(batch.withColumn("at", F.lit(number).cast("bigint")).select(*columns))
        order = Window.partitionBy("seller").orderBy("at", "expires", "id")
        frame = order.rowsBetween(1 - self.n, 0)
        mean = F.sum("price").over(frame).cast("double") / F.count("*").over(frame)
        found = self.tables.write(rows.select(*columns, mean.alias("avg_price"), F.lead("at", self.n - 1).over(order).isNull().alias("last")), "means", number)
        return found.where(F.col("at") == number).select("id", "seller", "avg_price")
