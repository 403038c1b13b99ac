"""The registered queries of this subpackage: (spark, sf_dir) to a DataFrame, and DuckDB SQL where SQL can express one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_array_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideworks.llm.repetition import repetition_figures

    return repetition_figures(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_debruijn_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideworks.llm.debruijn import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_digest_cache_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideworks.llm.tokencounts import token_counts

    return token_counts(_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("byte_bpe_50k.json"))


def op4_tag_path_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideworks.llm.tagpaths import extract

    return extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op5_pitman_yor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideworks.llm.pitmanyor import scores

    return scores(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_rank_array_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideworks.llm.bpe import encode_decode

    return encode_decode(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op7_bayes_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideworks.llm.jaccard import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_licence_sentence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideworks.llm.licences import licence_rules

    return licence_rules(_table(spark, sf_dir, "documents"))


def op9_paragraph_iblt(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideworks.llm.paragraphsketch import version_fingerprints

    return version_fingerprints(_table(spark, sf_dir, "documents"))


def op10_target_weight_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideworks.llm.mixing import mix_plan

    plan = mix_plan(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


QUERIES = {f.__name__: f for f in (op1_suffix_array_quality, op2_debruijn_substring_dedup, op3_digest_cache_token_counts, op4_tag_path_ratios, op5_pitman_yor_scores, op6_rank_array_bpe, op7_bayes_jaccard_join, op8_licence_sentence_rules, op9_paragraph_iblt, op10_target_weight_mix)}


def _sql() -> dict[str, str]:
    from tideworks.llm import licences, oracles

    return {
        "op2_debruijn_substring_dedup": oracles.SUBSTRING_DEDUP,
        "op7_bayes_jaccard_join": oracles.JACCARD,
        "op8_licence_sentence_rules": licences.duckdb_sql(),
        "op10_target_weight_mix": oracles.MIXING,
    }


SQL: dict[str, str] = _sql()
