"""Mixing sources to target weights.

Sizes are summed per source, the total is shared among the sources by weight under a cap per source, and each
document is emitted floor(rate) times plus one more time if its hash falls below the rest of the rate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text, 0 for null: what is left when all but the first character of each word goes."""
    return F.coalesce(F.size(F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda x: x != "")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], share_percent: int, cap: int) -> DataFrame:
    """(source, source_size) to (source, source_size, target, rate).

    Sources in order of code points, null last, take the weights in turn.  They share share_percent of all sizes by
    weight; none gets over ``cap`` times its own size, and what that leaves goes to the others by weight.  With
    sources in order of cap * size / weight, those that meet their cap come first, so one pass of running sums finds
    how far they go.  One row per source is sorted here, never one per document.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    ceiling = F.col("source_size") * cap
    everything = Window.partitionBy()
    ranked = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (turn + 1).cast("int")).cast("double"))
    before = Window.orderBy(ceiling / F.col("weight"), F.col("source").isNull(), F.col("source")).rowsBetween(Window.unboundedPreceding, -1)
    levels = ranked.select(
        "source", "source_size", "weight",
        ((F.sum("source_size").over(everything) * share_percent / 100 - F.coalesce(F.sum(ceiling).over(before), F.lit(0)))
         / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))).alias("level"),
    )
    # The level at which the rest is shared: that of the first source which stays within its cap.
    fits = F.col("level") * F.col("weight") <= ceiling
    level = F.min(F.when(fits, F.struct((ceiling / F.col("weight")).alias("at"), "level"))).over(everything)["level"]
    target = F.when(fits, level * F.col("weight")).otherwise(ceiling.cast("double"))
    return levels.select("source", "source_size", target.alias("target")).withColumn(
        "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    )


def draw(seed: int, *identity: Column) -> Column:
    """A number in [0, 1) from a hash of the identity: the same in every run, on every executor and in other engines."""
    key = F.concat_ws("/", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in identity])
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mix_plan(docs: DataFrame, *, size: Column | None = None, source: str = "source", identity: Sequence[str] = ("doc_id",), weights: Sequence[int] = (5, 2, 1), share_percent: int = 150, cap: int = 2, seed: int = 20260101, max_sources_to_broadcast: int = 100_000) -> DataFrame:
    """docs with ``size``, ``source_size``, ``target`` and ``copies`` (columns of docs with these names give way).

    A null text has size 0, a null source is a source of its own, and rows of the same identity draw the same number.
    An empty table gives an empty plan.  Sizes are summed on the map side before the only shuffle, whose rows are
    partial sums per source, so a hot source costs no more than another.  The targets are broadcast if there are at
    most max_sources_to_broadcast sources, and joined by shuffle otherwise.
    """
    own = {"size", "source_size", "target", "copies"}
    # Only what the plan needs goes through the join under names of its own; the row itself is one column.
    kept = [f"`{c}`" for c in docs.columns if c not in own]
    text_size = word_count(F.col("text")) if size is None else size
    ids = F.struct(*[F.col(f"`{c}`").alias(f"i{k}") for k, c in enumerate(identity)])
    sized = docs.select(F.struct(*kept).alias("row"), ids.alias("ids"), text_size.alias("size"), F.col(f"`{source}`").alias("key"))
    sums = sized.groupBy(F.col("key").alias("source")).agg(F.sum("size").alias("source_size"))
    targets = source_targets(sums, weights, share_percent, cap)
    few = targets.limit(max_sources_to_broadcast + 1).count() <= max_sources_to_broadcast
    joined = sized.join(F.broadcast(targets) if few else targets, F.col("key").eqNullSafe(F.col("source")), "left")
    rate = F.col("rate")
    extra = (draw(seed, *[F.col(f"ids.i{k}") for k in range(len(identity))]) < rate - F.floor(rate)).cast("int")
    return joined.select("row.*", "size", "source_size", "target", (F.floor(rate).cast("int") + extra).alias("copies"))


def mixed(docs: DataFrame, *, source: str = "source", identity: Sequence[str] = ("doc_id",), **options) -> DataFrame:
    """The mix itself: the rows of docs, each as often as mix_plan says, with the columns of docs."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    plan = mix_plan(docs.select(whole, F.col("text"), F.col(f"`{source}`").alias("source"), *[F.col(f"`{c}`").alias(f"i{k}") for k, c in enumerate(identity)]), identity=[f"i{k}" for k in range(len(identity))], **options)
    return plan.where("copies > 0").select("whole", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("whole.*")
