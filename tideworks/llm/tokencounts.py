"""Token counts through a digest cache.

A text's key is the digest of its normalised content together with the digest of the tokenizer file, so a new
tokenizer version never meets old counts.  Contents that the cache lacks are encoded once each and appended to it;
then every document takes its count from the cache.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideworks.llm.shared import scratch

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens bigint"


def content(text: Column) -> Column:
    """Normalised content.  The tokenizers counted here tell all other texts apart, so only null and empty are one."""
    return F.coalesce(text, F.lit(""))


def content_digest(text: Column) -> Column:
    return F.unhex(F.sha2(content(text), 256))


def tokenizer_version(path: str) -> str:
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


#: Characters that every Unicode version in use puts in the same classes; texts with others go to the library whole.
SETTLED = r"[^\x00-\u024f\u0370-\u0377\u0391-\u03a1\u03a3-\u03ff\u0400-\u0481\u048a-\u052f\u05d0-\u05ea\u2000-\u206f\u20a0-\u20ac\u2190-\u23ff\u3000-\u303f\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]"
#: The splitting pattern of byte-level BPE files with use_regex (a fixed value).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MEMO_WORDS = 1_000_000
_counters: dict[bytes, Counter] = {}  # of this worker process, with their word memos

Counter = Callable[[list[str]], list[int]]


def _by_words(tokenizer, specials: list[str]) -> Counter:
    """Counts by the library for each distinct word, summed: a byte-level tokenizer never merges across words."""
    import regex

    find, other = regex.compile(BYTE_LEVEL).findall, regex.compile(SETTLED).search
    special = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None
    whole = lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    memo: dict[str, int] = {}
    known = memo.__getitem__

    def count(text: str) -> int:
        if other(text):
            return whole([text])[0]
        n, parts = 0, [text]
        if special:
            parts = special.split(text)
            n = len(parts) - 1
        for part in parts:
            found = find(part)
            try:
                n += sum(map(known, found))
            except KeyError:
                if len(memo) > MEMO_WORDS:
                    memo.clear()
                missing = list({x for x in found if x not in memo})
                memo.update(zip(missing, whole(missing), strict=True))
                n += sum(map(known, found))
        return n

    return lambda texts: list(map(count, texts))


def _counter(path: str, raw: bytes) -> Counter:
    """A function from a list of texts to token counts, by the library the file is for; one per worker process."""
    key = hashlib.sha256(raw).digest()
    if key in _counters:
        return _counters[key]
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=raw)
        made: Counter = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    else:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        spec, tokenizer = json.loads(raw), Tokenizer.from_str(raw.decode())
        tokenizer.no_padding()
        tokenizer.no_truncation()
        added = spec.get("added_tokens") or []
        plain = not spec["normalizer"] and all(t["special"] and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in added)
        pre = spec["pre_tokenizer"] or {}
        if plain and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            made = _by_words(tokenizer, [t["content"] for t in added])
        else:
            made = lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    _counters[key] = made
    return made


def encode_misses(misses: DataFrame, path: str, *, texts_at_once: int = 64) -> DataFrame:
    """(digest, text), where equal digests may repeat within a partition only, to rows of the cache."""
    raw = misses.sparkSession.sparkContext.broadcast(Path(path).read_bytes())  # a vocabulary file of fixed size
    version = tokenizer_version(path)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, seen = _counter(path, raw.value), set()
        for batch in batches:
            digests, fresh = batch.column(0).to_pylist(), []
            for i, d in enumerate(digests):
                if d not in seen:
                    seen.add(d)
                    fresh.append(i)
            counts: list[int] = []
            for i in range(0, len(fresh), texts_at_once):
                counts += count(pc.take(batch.column(1), pa.array(fresh[i : i + texts_at_once])).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([version] * len(fresh), pa.string()), pa.array([digests[i] for i in fresh], pa.binary()), pa.array(counts, pa.int64())], names=["tokenizer", "digest", "n_tokens"])

    return misses.select("digest", "text").mapInArrow(encode, CACHE_SCHEMA)


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """The cache's rows for one tokenizer version; repeats, as left by a repeated append, count once."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "digest binary, n_tokens bigint")
    return spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, path: str, cache: str | None = None, *, limit: int = 1024) -> DataFrame:
    """docs without its text, with n_bytes, n_tokens and over_limit (columns of docs by these names give way).

    Null counts as the empty text, which has no tokens.  Repeated rows and texts are encoded once: each content is
    represented by the row with the least doc_id, found by a map-side aggregate over fixed-size keys, so copies of a hot
    text are never gathered.  The texts of the representatives alone are shuffled, by a key that is nearly unique.
    cache: a folder that all executors share; a new one in the session's shared folder if none is given.
    """
    spark = docs.sparkSession
    cache = cache or scratch(spark, "token-counts")
    version = tokenizer_version(path)
    own = {"n_bytes", "n_tokens", "over_limit", "text"}
    keyed = docs.select("doc_id", content(F.col("text")).alias("text"), content_digest(F.col("text")).alias("digest"))
    present = read_cache(spark, cache, version)
    wanted = keyed.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).join(present.select("digest"), "digest", "left_anti")
    same = keyed["digest"].eqNullSafe(wanted["digest"]) & keyed["doc_id"].eqNullSafe(wanted["doc_id"])
    misses = keyed.join(wanted.hint("shuffle_hash"), same, "left_semi")
    encode_misses(misses, path).write.mode("append").parquet(cache)
    counts = read_cache(spark, cache, version).withColumnRenamed("digest", "_digest")
    sized = docs.withColumns({"_digest": content_digest(F.col("text")), "_bytes": F.octet_length(content(F.col("text"))).cast("long")})
    return sized.drop(*own).join(counts, "_digest").withColumnRenamed("_bytes", "n_bytes").withColumn("over_limit", F.col("n_tokens") > limit).drop("_digest")
