"""Stand-ins over the shared tables for the inputs of the queries, in Spark and as DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Read = Callable[[SparkSession, str, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def auction(spark: SparkSession, d: str, read: Read = table) -> DataFrame:
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("seller"), (10 + F.col("o_orderkey") % 5).alias("category"), F.round(F.col("o_totalprice") * 10).cast("long").alias("reserve"), F.col("o_orderdate").alias("dateTime"), (F.col("o_orderdate") + F.expr("interval 365 days")).alias("expires"))


def bid(spark: SparkSession, d: str, read: Read = table) -> DataFrame:
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("auction"), F.col("l_suppkey").alias("bidder"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("price"), F.col("l_shipdate").alias("dateTime"), F.col("l_linestatus").alias("extra"))


def person(spark: SparkSession, d: str, read: Read = table) -> DataFrame:
    nation = table(spark, d, "nation").select("n_nationkey", "n_name")
    customer = read(spark, d, "customer")
    return customer.join(nation, customer.c_nationkey == nation.n_nationkey).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("n_name").alias("city"), F.col("c_mktsegment").alias("state"))


def signup(spark: SparkSession, d: str, read: Read = table) -> DataFrame:
    return read(spark, d, "events").where("event_type = 'signup'").select(F.col("user_id").alias("id"), F.concat(F.lit("u"), "user_id").alias("name"), F.col("ts").alias("dateTime"))


def listing(spark: SparkSession, d: str, read: Read = table) -> DataFrame:
    return read(spark, d, "events").where("event_type = 'view'").select(F.col("user_id").alias("seller"), F.round(F.col("value") * 100).cast("long").alias("reserve"), F.col("ts").alias("dateTime"))


def click_bid(spark: SparkSession, d: str, read: Read = table) -> DataFrame:
    return read(spark, d, "events").where("event_type in ('purchase', 'click')").select(F.col("user_id").alias("auction"), F.col("event_id").alias("bidder"), F.round(F.col("value") * 100).cast("long").alias("price"), F.col("ts").alias("dateTime"))


def accident(spark: SparkSession, d: str) -> DataFrame:
    k = F.coalesce(F.get_json_object("props", "$.k"), F.lit(""))
    return table(spark, d, "events").select(F.to_date("ts").alias("date"), F.col("event_type").alias("borough"), (F.col("value") > 113).cast("int").alias("killed"), F.array("event_type", k, "event_type", F.lit(""), F.concat(F.lit("f"), k)).alias("factors"))


def vertices(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Of every line item an edge from its part to one that order and supplier choose; some thirty a part at any size."""
    n = table(spark, d, "part").count()
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), ((F.col("l_orderkey") * 7 + F.col("l_suppkey")) % n).alias("dst")).distinct()


def steps(spark: SparkSession, d: str) -> DataFrame:
    """Of every line item an edge to the next place of its order: chains, whose closure is no larger than a few times the table."""
    place = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return table(spark, d, "lineitem").select((place - 1).alias("src"), place.alias("dst")).distinct()


def points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))


#: The same as common table expressions.
SQL = {
    "auction": "SELECT o_orderkey AS id, o_custkey AS seller, 10 + o_orderkey % 5 AS category, CAST(round(o_totalprice * 10) AS BIGINT) AS reserve, o_orderdate AS dateTime, o_orderdate + INTERVAL 365 DAY AS expires FROM orders",
    "bid": "SELECT l_orderkey AS auction, l_suppkey AS bidder, CAST(round(l_extendedprice * 100) AS BIGINT) AS price, l_shipdate AS dateTime, l_linestatus AS extra FROM lineitem",
    "person": "SELECT c_custkey AS id, c_name AS name, n_name AS city, c_mktsegment AS state FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "signup": "SELECT user_id AS id, 'u' || user_id AS name, ts AS dateTime FROM events WHERE event_type = 'signup'",
    "listing": "SELECT user_id AS seller, CAST(round(value * 100) AS BIGINT) AS reserve, ts AS dateTime FROM events WHERE event_type = 'view'",
    "click_bid": "SELECT user_id AS auction, event_id AS bidder, CAST(round(value * 100) AS BIGINT) AS price, ts AS dateTime FROM events WHERE event_type IN ('purchase', 'click')",
    "accident": "SELECT CAST(ts AS DATE) AS date, event_type AS borough, CASE WHEN value > 113 THEN 1 ELSE 0 END AS killed, [event_type, coalesce(json_extract_string(props, '$.k'), ''), event_type, '', 'f' || coalesce(json_extract_string(props, '$.k'), '')] AS factors FROM events",
    "vertices": "SELECT p_partkey AS id FROM part",
    "edges": "SELECT DISTINCT l_partkey AS src, (l_orderkey * 7 + l_suppkey) % (SELECT count(*) FROM part) AS dst FROM lineitem",
    "steps": "SELECT DISTINCT l_orderkey * 10 + l_linenumber - 1 AS src, l_orderkey * 10 + l_linenumber AS dst FROM lineitem",
    "points": "SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings",
}


def sql(body: str, *names: str, recursive: bool = False, more: str = "") -> str:
    """A statement over stand-ins by name; more: further table expressions."""
    tables = ", ".join([f"{n} AS ({SQL[n]})" for n in names] + ([more] if more else []))
    return f"WITH {'RECURSIVE ' if recursive else ''}{tables} {body}" if tables else body
