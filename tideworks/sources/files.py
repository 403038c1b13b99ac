"""Readers with declared schemas, and sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: The columns of the public traffic-collision CSV that the collision queries use, by their header names.
COLLISION_COLUMNS = {"DATE": "date", "BOROUGH": "borough", "NUMBER OF PERSONS KILLED": "killed", **{f"CONTRIBUTING FACTOR VEHICLE {i}": f"factor{i}" for i in range(1, 6)}}


def csv(spark: SparkSession, path: str, schema: str, *, header: bool = False, sep: str = ",", quote: str = '"', line_sep: str | None = None) -> DataFrame:
    """CSV with a declared schema; columns that are not selected later are not converted."""
    reader = spark.read.schema(schema).options(header=header, sep=sep, quote=quote)
    return (reader.option("lineSep", line_sep) if line_sep else reader).csv(path)


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "line")


def edge_list(spark: SparkSession, path: str, names: tuple[str, str] = ("src", "dst")) -> DataFrame:
    return csv(spark, path, f"{names[0]} bigint, {names[1]} bigint")


def collisions(spark: SparkSession, path: str) -> DataFrame:
    """(date, borough, killed, factors) of collision CSV files with their header; empty fields are empty strings."""
    wide = spark.read.option("header", True).option("quote", '"').csv(path)
    read = wide.select(*[F.col(f"`{k}`").alias(v) for k, v in COLLISION_COLUMNS.items()])
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    return read.select(F.to_date(F.try_to_timestamp("date", F.lit("MM/dd/yyyy"))).alias("date"), empty("borough").alias("borough"), F.coalesce(F.expr("try_cast(killed as int)"), F.lit(0)).alias("killed"), F.array(*[empty(f"factor{i}") for i in range(1, 6)]).alias("factors"))


def run_files(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark run files (JSON, in folders of any depth) as flat rows: hosts dropped, the result's time lifted."""
    raw = spark.read.option("recursiveFileLookup", True).option("multiLine", True).json(path)
    return raw.select(*[c for c in raw.columns if c not in ("hosts", "result")], F.col("result.time").alias("time"))


def log_times(spark: SparkSession, path: str, pattern: str = r"(?:Query|q)(\d+)\D+?([0-9.]+) ?s") -> DataFrame:
    """(query, seconds) from lines of a log; lines without them are left out."""
    found = lines(spark, path).select(F.regexp_extract("line", pattern, 1).alias("query"), F.regexp_extract("line", pattern, 2).alias("seconds"))
    return found.where("query != ''").select(F.col("query").cast("int").alias("query"), F.col("seconds").cast("double").alias("seconds"))


def discard(df: DataFrame) -> StreamingQuery | None:
    """Run everything and keep nothing."""
    if df.isStreaming:
        return df.writeStream.format("noop").start()
    df.write.format("noop").mode("overwrite").save()
    return None


def to_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """A stream's available rows into Parquet files."""
    return df.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start(path)


def fan_out(df: DataFrame, checkpoint: str, *sinks: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Each micro-batch once, to several consumers."""

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        for sink in sinks:
            sink(batch, number)
        batch.unpersist()

    return df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
