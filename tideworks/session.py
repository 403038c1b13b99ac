"""Sessions, and the folder that driver and executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    """A session with this engine's settings; settings given by name win (``spark_sql_x`` for ``spark.sql.x``)."""
    builder = SparkSession.builder.appName("tideworks")
    if master:
        builder = builder.master(master)
    return builder.config(map=SETTINGS | {k.replace("_", "."): v for k, v in settings.items()}).getOrCreate()


FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; there is no stand-in on one machine's disk."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and spark.sparkContext.master.startswith("local["):  # one process: its own disk is shared by all
        found = f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
    if not found:
        raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
    return found.rstrip("/")


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it, a query's shuffle files go when it ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREED) if before is None else spark.conf.set(FREED, before)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "round", **options: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and no executor's loss can undo it."""
    path = scratch_path(df.sparkSession, name)
    with freed_shuffles(df.sparkSession):
        df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Take the rows of tables that materialise wrote off the disk, when all that was made of them is written."""
    for table in tables:
        table.sparkSession.createDataFrame([], table.schema).coalesce(1).write.mode("overwrite").parquet(table.stored_at)
