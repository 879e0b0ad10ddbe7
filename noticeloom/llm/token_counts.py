"""Token counts through a digest cache.

A count is stored under the digest of the normalised content and the digest of the tokenizer's version
(its file and the normalisation). Contents are normalised only as far as the tokenizer can't tell them apart:
one that drops white space before it cuts sees a run of blanks as one; for others, contents stay as
they are. Documents are joined with the stored counts; only the distinct
contents that have none are encoded, and their counts are appended.
"""

from __future__ import annotations

import functools
import hashlib
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .common import join_skewed, map_columns, shared_folder, write_settings, written

#: Runs of ASCII blanks: one blank for tokenizers that drop white space.
BLANKS = r"[ \t\n\x0B\f\r]+"
#: Digests of repeated contents are broadcast up to this number.
BROADCAST = 200_000
#: Words whose lengths a worker remembers at most.
MEMORY = 400_000
CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"


def normalised(text: Column, by_word: bool) -> Column:
    whole = F.coalesce(text, F.lit(""))
    return F.regexp_replace(whole, BLANKS, " ") if by_word else whole


def tokenizer_version(path: str, by_word: bool) -> str:
    """The digest of the tokenizer's file and of the normalisation in front of it."""
    with open(path, "rb") as data:
        return hashlib.sha256(data.read() + (BLANKS if by_word else "").encode()).hexdigest()


@functools.lru_cache(2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@functools.lru_cache(2)
def _remembered(path: str) -> dict[str, int]:
    """Lengths of words, kept for as long as the worker lives."""
    return {}


def encode_lengths(contents: DataFrame, path: str, by_word: bool) -> DataFrame:
    """(digest, n_tokens) of contents (digest, content). by_word: the tokenizer drops white space before it
    cuts, so that a text's tokens are those of its blank-separated words, each encoded once and remembered. An empty table gives no rows,
    empty content no tokens, repeated rows each a row; other columns aren't read."""
    def make():
        t, memory = _tokenizer(path), _remembered(path)

        def lengths(texts: list[str]) -> list[int]:
            counts: list[int] = []
            for i in range(0, len(texts), 64):  # few at a time: an encoding is many times its text
                counts += map(len, t.encode_batch_fast(texts[i:i + 64], add_special_tokens=False))
            return counts

        def worded(texts: list[str]) -> list[int]:
            counts = []
            for text in texts:
                words = text.split(" ")
                fresh = set(words).difference(memory)
                if len(memory) + len(fresh) > MEMORY:
                    memory.clear()
                    fresh = set(words)
                fresh = list(fresh)
                memory.update(zip(fresh, lengths(fresh)))
                counts.append(sum(map(memory.__getitem__, words)))
            return counts

        return lambda digests, texts: (digests, (worded if by_word else lengths)(texts))

    return map_columns(contents.select("digest", "content"), "digest binary, n_tokens long", make)


def _stored(spark: SparkSession, cache: str, version: str) -> DataFrame | None:
    try:
        found = spark.read.schema(CACHE_SCHEMA).parquet(cache)
        found.take(1)
    except AnalysisException:  # no cache yet
        return None
    return found.where(F.col("tokenizer") == version)


def _once(docs: DataFrame, content: Column, digest: Column, sizes: DataFrame) -> DataFrame:
    """(digest, content) of docs, once for each digest of sizes (digest, n, keep): where it lies, since keep, the least
    doc_id with it, tells which row to take. Rows that share both are taken twice, which does no harm. Only where
    the repeated digests are too many to broadcast are contents shuffled."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest, content.alias("content"))
    repeated = sizes.where("n > 1").select(F.col("digest").alias("_digest"), "keep")
    if repeated.count() > BROADCAST:
        return rows.groupBy("digest").agg(F.first("content").alias("content"))
    marked = rows.join(F.broadcast(repeated), F.col("digest") == F.col("_digest"), "left")
    return marked.where(F.col("_digest").isNull() | F.col("doc_id").eqNullSafe(F.col("keep"))).select("digest", "content")


def count_tokens(docs: DataFrame, path: str, cache: str | None = None, limit: int = 2048, by_word: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of docs (doc_id, text).

    cache: the folder of the stored counts; by default a fresh one. by_word: see encode_lengths. Null texts
    count as empty and have no tokens; long texts are encoded whole; equal rows give equal rows; an empty
    table gives none; other columns are not read. Counts that two runs appended for one content are
    equal, so either serves.
    """
    spark = docs.sparkSession
    cache = cache or f"{shared_folder(spark)}/token_counts"
    version = tokenizer_version(path, by_word)
    text = F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(normalised(text, by_word).cast("binary"), 256)).alias("digest")
    content = normalised(text, by_word)
    keyed = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), digest), "digests")
    sizes = written(keyed.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("keep")), "sizes")
    contents = _once(docs, content, digest, sizes)
    stored = _stored(spark, cache, version)
    if stored is not None:
        known = sizes.join(stored.select("digest"), "digest", "left_semi").select("digest")
        contents = contents.join(F.broadcast(known) if known.count() <= BROADCAST else known, "digest", "left_anti")
    with write_settings(spark):
        encode_lengths(contents, path, by_word).select("digest", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    counts = _stored(spark, cache, version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    counts = written(sizes.select("digest", "n").join(counts, "digest"), "counts")
    return join_skewed(keyed, counts, "digest", "n").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
