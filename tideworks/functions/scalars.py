"""Scalar functions of the workloads, as column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ascii_words(text: Column) -> Column:
    """Runs of ASCII letters in lower case; found before lowering, so letters that lower to ASCII stay out."""
    return F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z]+"), F.lit(0)), lambda w: F.lower(w))


def ascii_words_by_split(text: Column) -> Column:
    """The same by cutting at all other characters."""
    return F.filter(F.split(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[^a-z]+"), lambda w: w != "")


def week_of_year(date: Column) -> Column:
    """Day of the year over 7, so that days 1 to 6 are week 0."""
    return F.floor(F.dayofyear(date) / 7).cast("int")


def us_date(text: Column) -> Column:
    return F.to_date(F.try_to_timestamp(text, F.lit("MM/dd/yyyy")))


def percent(part: Column, whole: Column) -> Column:
    return 100.0 * part / whole


def relative_error(new: Column, old: Column) -> Column:
    return F.abs(new - old) / new


def euros(price: Column) -> Column:
    """Dollars to euros at the benchmark's fixed rate, exactly."""
    return (F.lit(0.908).cast("decimal(4,3)") * price).cast("decimal(23,3)")


def euros_float(price: Column) -> Column:
    """The same in single precision, cut to a whole number."""
    return (price.cast("float") * F.lit(0.908).cast("float")).cast("long")


def line_distance(x: Column, y: Column, x1: float, y1: float, x2: float, y2: float) -> Column:
    """Distance of a point from the line through two others."""
    return F.abs((y2 - y1) * x - (x2 - x1) * y + x2 * y1 - y2 * x1) / float(np.hypot(y2 - y1, x2 - x1))


def random_pair(number: Column, nodes: int, seed: int) -> tuple[Column, Column]:
    """Two node ids that depend on the number and seed alone."""
    return F.pmod(F.xxhash64(number, F.lit(seed)), F.lit(nodes)), F.pmod(F.xxhash64(number, F.lit(seed + 1)), F.lit(nodes))


def collatz_steps(numbers: DataFrame, column: str, cap: int = 1000) -> DataFrame:
    """numbers with ``steps``: halvings and triplings until 1, at most cap; a batch at a time, numbers that are done drop out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(0).to_numpy()
            steps, at, x = np.zeros(len(n), np.int64), np.arange(len(n)), n.copy()
            for _ in range(cap):
                on = x > 1
                at, x = at[on], x[on]
                if not len(at):
                    break
                x = np.where(x % 2 == 0, x // 2, 3 * x + 1)
                steps[at] += 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(steps)], names=[column, "steps"])

    return numbers.select(column).mapInArrow(run, f"{column} bigint, steps bigint")
