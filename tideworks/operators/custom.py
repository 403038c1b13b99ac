"""Operators that take a function of rows: the escape from expressions, a batch or a group at a time through Arrow."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def flat_map(df: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Any number of rows out for each batch of rows in; no shuffle."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield f(batch)

    return df.mapInPandas(each, schema)


def group_reduce(df: DataFrame, keys: Sequence[str], f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Rows out for each whole group.  A group must fit a task: aggregates that can be merged belong in ``agg``."""
    return df.groupBy(*keys).applyInPandas(f, schema)


def cogroup(a: DataFrame, b: DataFrame, keys: Sequence[str], f: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Rows out for the rows that both sides have of a key, either of which may be none."""
    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(f, schema)


def fold(df: DataFrame, keys: Sequence[str], item: Column, start: Column, merge: Callable[[Column, Column], Column]) -> DataFrame:
    """Per key, merge over the items in ascending order from start, in expressions."""
    return df.groupBy(*keys).agg(F.aggregate(F.array_sort(F.collect_list(item)), start, merge).alias("value"))


def with_previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, default: Column | None = None) -> DataFrame:
    """df with ``previous``: the value of the row before in its key; what a map with state per key keeps."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("previous", before if default is None else F.coalesce(before, default))


def lookup(df: DataFrame, table: DataFrame, on: Sequence[str], how: str = "inner", most_rows: int = 1_000_000) -> DataFrame:
    """Join with a table that each task holds whole, if a count finds it small enough; otherwise by shuffle."""
    small = table.limit(most_rows + 1).count() <= most_rows
    return df.join(F.broadcast(table) if small else table, list(on), how)


def observed(df: DataFrame, name: str, **figures: Column) -> DataFrame:
    """df, which reports figures over the rows that pass as it runs (``QueryExecutionListener``, ``StreamingQueryListener``)."""
    return df.observe(name, *[c.alias(k) for k, c in figures.items()])
