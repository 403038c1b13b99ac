"""Event-time, count and data-driven windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tumbling(df: DataFrame, time: str, size: str) -> DataFrame:
    """df with window_start and window_end of its tumbling window."""
    w = F.window(time, size)
    return df.withColumn("_w", w).withColumns({"window_start": F.col("_w.start"), "window_end": F.col("_w.end")}).drop("_w")


def hopping_counts(df: DataFrame, time: str, slice_size: str, slices: int, keys: Sequence[str]) -> DataFrame:
    """(window_start, window_end, *keys, num) for windows of ``slices`` slices that start every slice.

    Rows are counted per slice first, so what is copied into overlapping windows is counts, not rows.
    """
    sliced = df.groupBy(F.window(time, slice_size).alias("_w"), *keys).agg(F.count("*").alias("_n"))
    step = F.expr(f"interval {slice_size}")
    back = F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))
    spread = sliced.select(*keys, "_n", F.col("_w.start").alias("_s"), back.alias("_k"))
    starts = spread.withColumn("window_start", F.col("_s") - step * F.col("_k"))
    return starts.groupBy("window_start", *keys).agg(F.sum("_n").alias("num")).withColumn("window_end", F.col("window_start") + step * slices)


def last_rows(keys: Sequence[str], order: Sequence[str | Column], n: int):
    """A window of a row and the n-1 before it in its key; keys with fewer rows get what there is."""
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(n - 1), 0)


def closing(opens: DataFrame, events: DataFrame, key: str, event_key: str, begin: str, end: str, time: str, condition: Column | None = None) -> DataFrame:
    """Data-driven windows: events joined to the row that opens their key's window, which lasts from begin up to before end."""
    inside = (F.col(time) >= F.col(begin)) & (F.col(time) < F.col(end))
    return opens.join(events, F.col(key) == F.col(event_key)).where(inside if condition is None else inside & condition)


def within(left: DataFrame, right: DataFrame, on: Sequence[str], left_time: str, right_time: str, span: str) -> DataFrame:
    """Interval join: rows of one key whose right time is before the left time plus span, however long before.

    Works on streams with watermarks as well, where the bound lets state go.
    """
    return left.join(right, list(on)).where(F.col(right_time) < F.col(left_time) + F.expr(f"interval {span}"))
