"""The auction queries over streams of the shared tables, all that is there once (availableNow)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tideworks.operators.relational import with_max
from tideworks.plans import auctions as nex
from tideworks.plans import fixtures as fx
from tideworks.session import SETTINGS, scratch_path
from tideworks.streaming import processors, tables

FAR = "2100-01-01 00:00:00"
TIMES = {"orders": "o_orderdate", "lineitem": "l_shipdate", "events": "ts"}
STORE = "spark.sql.streaming.stateStore.providerClass"
ROWS = 100_000  # that a partition of a shuffle without adaptive execution has at least


def streamed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream, followed by rows far ahead that close the last windows; event types are each sent ahead."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    # A pattern, for the stream source takes a plain path for a folder, and a table may be one file.
    source = spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")
    if name not in TIMES:
        return source
    ahead = {TIMES[name]: F.lit(FAR).cast("timestamp_ntz")}
    kinds = ["click", "view", "signup"] if name == "events" else [None]
    row = spark.createDataFrame([(k,) for k in kinds], "kind string")
    key = {"orders": "o_orderkey", "lineitem": "l_orderkey", "events": "user_id"}[name]
    fields = [ahead[f.name].alias(f.name) if f.name in ahead else F.lit(-1).cast(f.dataType).alias(f.name) if f.name == key else (F.col("kind") if f.name == "event_type" else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields]
    flush = scratch_path(spark, f"ahead-{name}")
    row.select(*fields).write.parquet(flush)
    return source.unionByName(spark.readStream.schema(schema).parquet(flush))


def timed(df: DataFrame) -> DataFrame:
    """Times with a zone, as watermarks need."""
    return df.withColumns({c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})


def finished(df: DataFrame, mode: str = "append", each: Callable[[DataFrame, int], DataFrame] | None = None, **settings: str) -> DataFrame:
    """Run a stream over what is there and return what it put out; each: applied to every micro-batch and its number before it is kept.

    settings: of the session while the stream runs, by name as ``session`` takes them.
    """
    spark = df.sparkSession
    out, state = scratch_path(spark, "stream"), scratch_path(spark, "stream-state")
    settings = {STORE: SETTINGS[STORE]} | {k.replace("_", "."): v for k, v in settings.items()}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        writer = df.writeStream.option("checkpointLocation", state).outputMode(mode).trigger(availableNow=True)
        if each:
            def keep(batch: DataFrame, number: int) -> None:
                each(batch, number).write.mode("overwrite").parquet(f"{out}/batch={number}")

            writer.foreachBatch(keep).start().awaitTermination()
            kept = spark.read.parquet(out).drop("batch")
        else:
            writer.format("parquet").start(out).awaitTermination()
            kept = spark.read.schema(df.schema).parquet(out)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return kept.withColumns({c: F.col(c).cast("timestamp_ntz") for c, kind in kept.dtypes if kind == "timestamp"})


def progress(query: StreamingQuery) -> list[dict]:
    """Rows, seconds and watermark of a query's recent micro-batches: what a latency timeline is drawn from."""
    return [{"batch": p["batchId"], "rows": p["numInputRows"], "seconds": p["durationMs"].get("triggerExecution", 0) / 1000, "watermark": p.get("eventTime", {}).get("watermark")} for p in map(dict, query.recentProgress)]


def _real(df: DataFrame, column: str) -> DataFrame:
    """Without the rows sent ahead."""
    return df.where(F.col(column) != -1)


def _bid(spark: SparkSession, d: str) -> DataFrame:
    return timed(fx.bid(spark, d, streamed))


def winning(spark: SparkSession, d: str) -> DataFrame:
    """The stream itself deals its rows out by auction: each micro-batch reads its tables once, and all that it does shares that
    shuffle.  Without adaptive execution the join finds the rows in their places; else it would deal them out again.  As
    nothing joins small partitions then, there are no more than the rows fill."""
    both = processors.auctions_and_bids(timed(fx.auction(spark, d, streamed)), _bid(spark, d)).repartition("id")
    filled = sum(fx.table(spark, d, t).count() for t in ("orders", "lineitem")) // ROWS + 1
    parts = min(filled, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return finished(both, each=tables.WinningBids(scratch_path(spark, "winning")), spark_sql_adaptive_enabled="false", spark_sql_shuffle_partitions=str(parts))


def q5(spark: SparkSession, d: str, slide: str = "2 hours", size: str = "10 hours", delay: str = "1 day") -> DataFrame:
    """A window's counts come out together when it closes, so the greatest are found within the micro-batch."""
    bids = timed(fx.click_bid(spark, d, streamed)).withWatermark("dateTime", delay)
    counts = bids.groupBy(F.window("dateTime", size, slide).alias("w"), "auction").agg(F.count("*").alias("num")).select(F.col("w.start").alias("window_start"), "auction", "num")
    return finished(counts, each=lambda batch, _: with_max(batch, ["window_start"], "num"))


def q7(spark: SparkSession, d: str, size: str = "10 hours", delay: str = "1 day") -> DataFrame:
    bids = timed(fx.click_bid(spark, d, streamed)).withWatermark("dateTime", delay)
    kept = bids.groupBy(F.window("dateTime", size).alias("w"), "auction", "bidder", "price").agg(F.count("*").alias("n"))
    rows = kept.select(F.col("w.start").alias("window_start"), "auction", "price", "bidder", "n")
    return finished(rows, each=lambda batch, _: with_max(batch, ["window_start"], "price").select("window_start", "auction", "price", "bidder", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy")).drop("copy"))


def q8(spark: SparkSession, d: str, size: str = "1 day", delay: str = "1 day") -> DataFrame:
    people = timed(fx.signup(spark, d, streamed)).withWatermark("dateTime", delay)
    sold = timed(fx.listing(spark, d, streamed)).withWatermark("dateTime", delay)
    return finished(nex.q8(people, sold, size))


def q6(spark: SparkSession, d: str, n: int = 10) -> DataFrame:
    """The second query follows the first one's output as a stream of its own."""
    won = winning(spark, d)
    path = scratch_path(spark, "won")
    timed(won).write.parquet(path)
    follow = spark.readStream.schema(timed(won).schema).parquet(path)
    return finished(follow, each=tables.LastMeans(scratch_path(spark, "means"), n))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "nexmark_q0": lambda s, d: finished(_real(nex.q0(_bid(s, d)), "auction")),
    "nexmark_q1_float": lambda s, d: finished(_real(nex.q1(_bid(s, d), exact=False), "auction")),
    "nexmark_q2": lambda s, d: finished(_real(nex.q2(_bid(s, d)), "auction")),
    "nexmark_q3": lambda s, d: finished(_real(nex.q3(fx.person(s, d, streamed), timed(fx.auction(s, d, streamed)), ("BUILDING", "MACHINERY")), "id")),
    "nexmark_winning_bids": winning,
    "nexmark_q4": lambda s, d: winning(s, d).groupBy("category").agg(F.avg("price").alias("avg_price")),
    "nexmark_q5": q5,
    "nexmark_q6": q6,
    "nexmark_q7": q7,
    "nexmark_q8": q8,
}
