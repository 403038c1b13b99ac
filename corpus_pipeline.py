"""A training-corpus pipeline over ``documents``: quality rules, near duplicates, shared passages, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor kept.  All but the last return the columns
of docs, whatever their names and number, and no stage needs a value in any but text: null and empty texts, ties and
repeated rows are told at each.  Texts may be of any length, and an empty table gives an empty table of the same columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tideworks.llm.bpe import encode_decode
from tideworks.llm.debruijn import without_repeats
from tideworks.llm.jaccard import without_near_duplicates
from tideworks.llm.mixing import mixed
from tideworks.llm.queries import tokenizer_path
from tideworks.llm.repetition import repetition_figures
from tideworks.llm.shared import scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the repetition limits reject go.

    Null and empty texts have too few words and go; each row is judged alone, so repeated rows stay or go together.
    """
    return repetition_figures(docs, passed_only=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the least doc_id stays.

    Of repeated rows with that doc_id one stays.  Texts without words are no one's duplicates and stay; a row without a
    doc_id stays if no row of its class has one.
    """
    return without_near_duplicates(docs)


def shared_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of 13-word windows that an earlier document has go; a text that loses none stays as it is.

    Every row stays.  Null texts stay null; rows without a doc_id stay whole and take nothing from others; rows that
    share a doc_id take nothing from each other.
    """
    return without_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for.

    A null source is a source of its own, the last.  The draw hangs on doc_id alone, so rows that share one (or have
    none) are copied alike; texts without words weigh nothing.
    """
    return mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded text digests of what is left, one row per copy; null and empty texts have no ids."""
    return encode_decode(docs, tokenizer_path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [("quality", quality), ("near_duplicates", near_duplicates), ("shared_passages", shared_passages), ("mix", mix), ("encode", encode)]

#: SQL has no suffix arrays or BPE; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
