"""Tables in the folder that driver and executors share, and how finely to cut work."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideworks.llm import textbytes as tb
from tideworks.session import discard
from tideworks.session import materialise as stored
from tideworks.session import scratch_path as scratch

__all__ = ["BLOBS", "batch_of", "cuts_of", "discard", "pack", "partitions", "pieces", "read_rows", "scratch", "sliced", "stored", "unpack"]

SLICES = "slice bigint, rows binary"
# Rows of megabytes: a row group ends after some of them, not after the writer's usual hundreds.
BLOBS = {"parquet.block.size": str(16 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pieces(df: DataFrame, column: str, piece_bytes: int) -> tuple[int, int]:
    """Bytes of a text column over all rows, and how many pieces of about piece_bytes they make (at least the shuffle partitions)."""
    total = df.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return total, max(partitions(df.sparkSession), -(-total // piece_bytes))


def pack(x: np.ndarray) -> bytes:
    """Non-negative integers in the fewest bytes that hold them all."""
    top = int(x.max()) if len(x) else 0
    kind = next(c for c, m in (("B", 8), ("H", 16), ("I", 32), ("Q", 64)) if top < 1 << m)
    return kind.encode() + x.astype(kind).tobytes()


def unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, chr(raw[0]), offset=1).astype(np.int64)


def cuts_of(x: np.ndarray) -> list[tuple[int, int]]:
    """(from, to) of each run of equal values."""
    at = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)
    return list(zip(at.tolist(), [*at[1:].tolist(), len(x)], strict=len(x) > 0))


def batch_of(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    """Rows of numbers and bytes by a schema in words."""
    names, types = zip(*(x.split() for x in schema.split(", ")), strict=True)
    kinds = {"bigint": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[t]) for i, t in enumerate(types)], names=list(names))


def sliced(df: DataFrame, text: str, limit: int) -> DataFrame:
    """(slice, rows) in the shared folder: runs of whole rows with at most ``limit`` bytes of text, or one longer text.

    The rows of a slice are one Arrow batch, compressed; slices are numbered in the order of df's partitions and rows.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for i, j, *_ in tb.slices(*tb.column(batch, text), limit):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(batch.slice(i, j - i))
                yield batch_of(SLICES, [(number, sink.getvalue().to_pybytes())])
                number += 1
            tb.release()

    return stored(df.mapInArrow(cut, SLICES), "slices", compression="none", **BLOBS)


def read_rows(raw: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(raw).read_next_batch()
