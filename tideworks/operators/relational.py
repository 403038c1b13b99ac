"""Operators over DataFrames that say in one word what the built-in ones say in several."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def route(df: DataFrame, *conditions: Column) -> list[DataFrame]:
    """One DataFrame per condition, with the rows for which it is the first to hold; rows that meet none are dropped."""
    out, before = [], F.lit(False)
    for condition in conditions:
        holds = F.coalesce(condition, F.lit(False))
        out.append(df.where(holds & ~before))
        before = before | holds
    return out


def argmin(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Sequence[str]) -> DataFrame:
    """Per key, the columns ``value`` of the row with the least ``order``."""
    best = F.min_by(F.struct(*value), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]))
    return df.groupBy(*keys).agg(best.alias("_best")).select(*keys, "_best.*")


def with_max(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The rows whose value is the greatest of their key, ties included.

    A partial maximum per key is joined back, so no task sorts or holds a whole key; where there are few keys the
    maxima are small and the engine broadcasts them, and the rows are not shuffled at all.
    """
    top = df.groupBy(*keys).agg(F.max(value).alias(value))
    return df.join(top, [*keys, value], "left_semi")


def left_join_default(left: DataFrame, right: DataFrame, on: Sequence[str], **defaults: Column) -> DataFrame:
    """Left outer join in which missing columns of right take defaults."""
    return left.join(right, list(on), "left").withColumns({name: F.coalesce(F.col(name), value) for name, value in defaults.items()})


def unordered_pairs(df: DataFrame, key: str, item: str, order: Column | None = None) -> DataFrame:
    """(key, a, b) for each two different items of a key, with a before b."""
    a, b = df.select(key, F.col(item).alias("a")), df.select(key, F.col(item).alias("b"))
    return a.join(b, key).where(F.col("a") < F.col("b") if order is None else order)


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def except_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a that b lacks, repeats kept; null equals null."""
    other = b.distinct().toDF(*[f"_{c}" for c in b.columns])
    same = F.lit(True)
    for c in a.columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return a.join(other, same, "left_anti")


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows by ``order``, which must be total to give the same rows each time."""
    return df.orderBy(*order).limit(n)


def nearest(points: DataFrame, centres: Sequence[tuple[int, Sequence[float]]], coordinates: Sequence[str]) -> DataFrame:
    """points with ``centre``, the id of the nearest centre; ties go to the least id.

    centres is a list on the driver (a few rows), and becomes one array literal in the plan.
    """
    table = F.array(*[F.struct(F.lit(int(i)).alias("id"), *[F.lit(float(x)).alias(c) for c, x in zip(coordinates, at, strict=True)]) for i, at in centres])
    distance = lambda c: F.struct(sum(((F.col(x) - c[x]) * (F.col(x) - c[x]) for x in coordinates), F.lit(0.0)).alias("d"), c["id"].alias("id"))
    return points.withColumn("centre", F.array_min(F.transform(table, distance))["id"])
