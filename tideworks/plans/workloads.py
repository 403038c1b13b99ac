"""The batch workloads: collisions, word count, k-means, graphs, Collatz, and reports on runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideworks.functions import scalars
from tideworks.operators import iterate as fix
from tideworks.operators.relational import nearest
from tideworks.session import materialise


# Collisions: date, borough, killed, factors (array of strings, '' where there is none).


def lethal_by_week(accidents: DataFrame) -> DataFrame:
    """Accidents with a death per week; weeks without any are kept."""
    lethal = F.sum((F.col("killed") > 0).cast("long")).alias("lethal")
    return accidents.groupBy(F.year("date").alias("year"), scalars.week_of_year(F.col("date")).alias("week")).agg(lethal)


def by_factor(accidents: DataFrame) -> DataFrame:
    """Accidents and lethal ones per contributing factor, each accident once per factor."""
    each = F.explode(F.filter(F.array_distinct("factors"), lambda f: f != "")).alias("factor")
    counted = accidents.select(each, (F.col("killed") > 0).cast("long").alias("l")).groupBy("factor").agg(F.count("*").alias("accidents"), F.sum("l").alias("lethal"))
    return counted.withColumn("pct", scalars.percent(F.col("lethal"), F.col("accidents")))


def by_borough_and_week(accidents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per borough, year and week; and per borough and week number with the lethal percentage, from the first."""
    where = accidents.where("borough != ''")
    weekly = where.groupBy("borough", F.year("date").alias("year"), scalars.week_of_year(F.col("date")).alias("week")).agg(F.count("*").alias("accidents"), F.sum((F.col("killed") > 0).cast("long")).alias("lethal"))
    numbers = weekly.groupBy("borough", "week").agg(F.sum("accidents").alias("accidents"), F.sum("lethal").alias("lethal"))
    return weekly, numbers.withColumn("pct", scalars.percent(F.col("lethal"), F.col("accidents")))


# Text.


def word_count(lines: DataFrame, column: str, by_split: bool = False) -> DataFrame:
    words = (scalars.ascii_words_by_split if by_split else scalars.ascii_words)(F.col(column))
    return lines.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("count"))


# k-means.


def kmeans(points: DataFrame, k: int, rounds: int, tolerance: float | None = None) -> tuple[list[tuple[int, list[float]]], DataFrame]:
    """Centres and points (id, x, y) with their centre.  The k points with the least ids are the seeds.

    Ties go to the least centre, a centre without points goes, and with a tolerance rounds end when no centre moved
    further than it on either axis.  Points are read from where they are each round; k rows come to the driver.
    """
    seeds = points.orderBy("id").limit(k).collect()
    start = [(i, [r["x"], r["y"]]) for i, r in enumerate(seeds)]

    def step(items: DataFrame, centres: list) -> list:
        means = nearest(items, centres, ["x", "y"]).groupBy("centre").agg(F.avg("x").alias("x"), F.avg("y").alias("y")).collect()
        return sorted((r["centre"], [r["x"], r["y"]]) for r in means)

    def moved(before: list, after: list) -> bool:
        old = dict(before)
        return tolerance is None or any(abs(a - b) > tolerance for i, at in after for a, b in zip(at, old[i], strict=True))

    centres = fix.replay(points, start, step, moved, rounds)
    return centres, nearest(points, centres, ["x", "y"])


# Graphs: edges (src, dst), vertices (id).


def pagerank(vertices: DataFrame, edges: DataFrame, rounds: int, damping: float = 0.85, eps: float = 1e-8) -> DataFrame:
    """(page, rank) of every page; rank that pages without links hold is not passed on."""
    n = vertices.count()
    out = edges.groupBy("src").agg(F.count("*").alias("degree"))
    links = materialise(edges.join(out, "src"))
    base = (1 - damping) / n

    def body(ranks: DataFrame, _: float) -> DataFrame:
        given = links.join(ranks.select(F.col("page").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("page")).agg(F.sum(F.col("rank") / F.col("degree")).alias("got"))
        return ranks.join(given, "page", "left").select("page", F.col("rank").alias("old"), (F.lit(base) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))

    change = lambda _, ranks: ranks.agg(F.max(scalars.relative_error(F.col("rank"), F.col("old")))).first()[0] or 0.0
    start = vertices.select(F.col("id").alias("page"), F.lit(1.0 / n).alias("old"), F.lit(1.0 / n).alias("rank"))
    return fix.iterate(start, 1.0, body, change, lambda c: c > eps, rounds)[1].select("page", "rank")


def pagerank_inlinks(vertices: DataFrame, edges: DataFrame, rounds: int, damping: float = 0.85, eps: float = 1e-8) -> DataFrame:
    """(page, rank) of pages with links from pages that have a rank; after the first round the others have none."""
    n = vertices.count()
    links = materialise(edges.join(edges.groupBy("src").agg(F.count("*").alias("degree")), "src"))

    def body(ranks: DataFrame, _: float) -> DataFrame:
        given = links.join(ranks.select(F.col("page").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("page")).agg(F.sum(F.col("rank") / F.col("degree")).alias("got"))
        new = given.select("page", (F.lit((1 - damping) / n) + damping * F.col("got")).alias("rank"))
        return new.join(ranks.select("page", F.col("rank").alias("old")), "page", "left")

    change = lambda _, ranks: ranks.agg(F.max(scalars.relative_error(F.col("rank"), F.coalesce("old", F.lit(0.0))))).first()[0] or 0.0
    start = vertices.select(F.col("id").alias("page"), F.lit(1.0 / n).alias("rank"), F.lit(None).cast("double").alias("old"))
    return fix.iterate(start, 1.0, body, change, lambda c: c > eps, rounds)[1].select("page", "rank")


def pagerank_integer(vertices: DataFrame, edges: DataFrame, rounds: int) -> DataFrame:
    """(node, rank) in whole numbers: 1,000,000 and five sixths of each in-neighbour's rank over its degree, cut, from 6,000,000."""
    links = materialise(edges.join(edges.groupBy("src").agg(F.count("*").alias("degree")), "src"))

    def body(ranks: DataFrame, _: None) -> DataFrame:
        given = links.join(ranks.select(F.col("node").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.expr("(rank * 5) div (6 * degree)")).alias("got"))
        return ranks.select("node").join(given, "node", "left").select("node", (F.lit(1_000_000) + F.coalesce("got", F.lit(0))).cast("long").alias("rank"))

    start = vertices.select(F.col("id").alias("node"), F.lit(6_000_000).cast("long").alias("rank"))
    return fix.iterate(start, None, body, lambda s, _: s, lambda _: True, rounds)[1]


def connected_components(vertices: DataFrame, edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(vertex, component): the least vertex that a vertex is connected with; only vertices that changed are followed."""
    both = materialise(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select("dst", "src")).distinct())
    start = vertices.select(F.col("id").alias("vertex"), F.col("id").alias("component"))

    def expand(work: DataFrame) -> DataFrame:
        return both.join(work, F.col("a") == F.col("vertex")).groupBy(F.col("b").alias("vertex")).agg(F.min("component").alias("component"))

    return fix.delta_iterate(start, start, "vertex", "component", expand, F.least, rounds)


def transitive_closure(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    return fix.closure(edges.select(F.col("src").alias("x"), F.col("dst").alias("y")), rounds)


def triangles(edges: DataFrame) -> DataFrame:
    """Number of triangles of the undirected simple graph of the edges, in one row.

    Edges point to the end of higher degree, so a hub starts few of the pairs that are looked up as edges.
    """
    simple = edges.where("src != dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    degree = simple.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count("*").alias("d"))
    ranked = simple.join(degree.toDF("a", "da"), "a").join(degree.toDF("b", "db"), "b")
    up = F.struct(F.col("da"), F.col("a")) < F.struct(F.col("db"), F.col("b"))
    one, two = F.struct(F.col("da").alias("d"), F.col("a").alias("v")), F.struct(F.col("db").alias("d"), F.col("b").alias("v"))
    directed = materialise(ranked.select(F.when(up, one).otherwise(two).alias("lo"), F.when(up, two).otherwise(one).alias("hi")))
    wedge = directed.select("lo", F.col("hi").alias("x")).join(directed.select("lo", F.col("hi").alias("y")), "lo").where("x < y")
    return wedge.join(directed.toDF("x", "y"), ["x", "y"], "left_semi").agg(F.count("*").alias("triangles"))


# Collatz.


def collatz(numbers: DataFrame, column: str = "n") -> DataFrame:
    """(steps, n) of the number with the most steps; of those that tie, the largest."""
    best = F.max(F.struct("steps", F.col(column).alias("n")))
    return scalars.collatz_steps(numbers, column).agg(best.alias("b")).select("b.*")


# Reports on runs: columns of keys and a time.


def spread(runs: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean, half the range, and sample deviation."""
    return runs.groupBy(*keys).agg(F.avg(value).alias("mean"), ((F.max(value) - F.min(value)) / 2).alias("half_range"), F.stddev_samp(value).alias("stdev"), F.count("*").alias("runs"))


def speedup(times: DataFrame, keys: Sequence[str], size: str, value: str) -> DataFrame:
    """Time at the key's least size over the time, one row per key and size."""
    least = F.min_by(value, size).over(Window.partitionBy(*keys))
    return times.withColumn("speedup", least / F.col(value))


def layout(runs: DataFrame, row: str, column: str, values: Sequence[str], value: str) -> DataFrame:
    """Rows by columns of sums; the column values are given, so one pass is enough."""
    return runs.groupBy(row).pivot(column, list(values)).agg(F.sum(value))


def latency(rows: DataFrame, time: str, value: str, seconds: int = 1) -> DataFrame:
    """Mean, least, greatest, variance and deviation per bucket of time."""
    bucket = (F.floor(F.unix_seconds(F.col(time).cast("timestamp")) / seconds) * seconds).cast("long").alias("bucket")
    return rows.groupBy(bucket).agg(F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("greatest"), F.var_samp(value).alias("variance"), F.stddev_samp(value).alias("stdev"))


def code_size(files: DataFrame, path: str, lines: str) -> DataFrame:
    """Lines of code per first three parts of a path."""
    part = F.split(path, "/")
    return files.groupBy(*[F.get(part, i).alias(n) for i, n in enumerate(("group", "workload", "system"))]).agg(F.sum(lines).alias("code"))
