"""Multisets: rows with a signed ``weight``, which says how often a row is there."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WEIGHT = "weight"


def weighted(df: DataFrame, weight: int = 1) -> DataFrame:
    return df.withColumn(WEIGHT, F.lit(weight).cast("long"))


def consolidate(df: DataFrame) -> DataFrame:
    """Equal rows added up; rows of weight 0 go."""
    return df.groupBy(*[c for c in df.columns if c != WEIGHT]).agg(F.sum(WEIGHT).alias(WEIGHT)).where(F.col(WEIGHT) != 0)


def concat(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def negate(df: DataFrame) -> DataFrame:
    return df.withColumn(WEIGHT, -F.col(WEIGHT))


def semijoin(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is in ``keys``, each with the product of both weights."""
    side = keys.groupBy(*on).agg(F.sum(WEIGHT).alias("_key_weight"))
    return df.join(side, list(on)).withColumn(WEIGHT, F.col(WEIGHT) * F.col("_key_weight")).drop("_key_weight").where(F.col(WEIGHT) != 0)


def threshold(df: DataFrame, change: Callable[[Column], Column]) -> DataFrame:
    """Each consolidated row with its weight rewritten; those that become 0 go."""
    return consolidate(df).withColumn(WEIGHT, change(F.col(WEIGHT)).cast("long")).where(F.col(WEIGHT) != 0)


def distinct(df: DataFrame) -> DataFrame:
    return threshold(consolidate(df).where(F.col(WEIGHT) > 0), lambda w: F.lit(1))


def weighted_explode(df: DataFrame, count: Column) -> DataFrame:
    """Weights multiplied by a count that a row gives itself."""
    return df.withColumn(WEIGHT, F.col(WEIGHT) * count).where(F.col(WEIGHT) != 0)
