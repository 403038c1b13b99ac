"""Generated graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideworks.functions.scalars import random_pair


def random_edges(spark: SparkSession, edges: int, nodes: int, seed: int = 0, partitions: int | None = None) -> DataFrame:
    """(src, dst) between nodes 0 to nodes-1, repeats kept; the same for any number of partitions."""
    src, dst = random_pair(F.col("id"), nodes, seed)
    return spark.range(0, edges, 1, partitions).select(src.alias("src"), dst.alias("dst"))
