"""Fixpoints: what Catalyst has no operator for.

Each round's result is written to the shared folder and read back, which keeps plans short, survives lost executors
and gives every reference to it columns of its own.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideworks.session import materialise


def iterate(items: DataFrame, state: Any, body: Callable[[DataFrame, Any], DataFrame], fold: Callable[[Any, DataFrame], Any], go_on: Callable[[Any], bool], rounds: int) -> tuple[Any, DataFrame]:
    """Bulk iteration: a round's items are the next round's input, and are folded into a small state on the driver."""
    for _ in range(rounds):
        items = materialise(body(items, state))
        state = fold(state, items)
        if not go_on(state):
            break
    return state, items


def replay(items: DataFrame, state: Any, step: Callable[[DataFrame, Any], Any], go_on: Callable[[Any, Any], bool], rounds: int) -> Any:
    """The same items each round; only the state, small and on the driver, changes."""
    for _ in range(rounds):
        before, state = state, step(items, state)
        if not go_on(before, state):
            break
    return state


def delta_iterate(state: DataFrame, work: DataFrame, key: str, value: str, expand: Callable[[DataFrame], DataFrame], merge: Callable[[Column, Column], Column], rounds: int | None = None) -> DataFrame:
    """Keyed state that changes where work arrives.

    expand(work) proposes (key, value) rows from the keys that changed last; merge(old, proposed) is the new value.
    The round's changes are the next round's work; it ends when nothing changes, and fails if that takes more than rounds.
    """
    state, work = materialise(state.select(key, value)), materialise(work.select(key, value))
    for _ in count() if rounds is None else range(rounds):
        proposed = expand(work).select(key, F.col(value).alias("_new"))
        merged = materialise(state.join(proposed, key, "left").select(key, F.col(value).alias("_old"), F.when(F.col("_new").isNull(), F.col(value)).otherwise(merge(F.col(value), F.col("_new"))).alias(value)))
        state, work = merged.select(key, value), merged.where(~F.col(value).eqNullSafe(F.col("_old"))).select(key, value)
        if work.isEmpty():
            return state
    raise RuntimeError(f"still changing after {rounds} rounds")


def closure(pairs: DataFrame, rounds: int | None = None) -> DataFrame:
    """Semi-naive closure of (x, y): only pairs new in a round are extended in the next; x = y is left out.  Fails if it takes more than rounds."""
    base = materialise(pairs.where("x != y").distinct())
    known, fresh = base, base
    edges = base.toDF("from_", "to_")
    for _ in count() if rounds is None else range(rounds):
        longer = fresh.join(edges, F.col("y") == F.col("from_")).select("x", F.col("to_").alias("y")).where("x != y").distinct()
        fresh = materialise(longer.join(known, ["x", "y"], "left_anti"))
        if fresh.isEmpty():
            return known
        known = known.unionByName(fresh)
    raise RuntimeError(f"still growing after {rounds} rounds")
