"""Benchmark decontamination as a prefix-filtered containment join, in DataFrame operations only.

Each benchmark item is cut into windows of its words. A window is the set of its word shingles; a
document contains it only if it has all of them, so one necessary shingle, the rarest by count over
all documents, is the window's prefix. Documents' words are joined with the prefixes. A match gives
the one place where the window can lie; the length and positional bounds drop places that stick out of
the document, and the words there are compared with the window's.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, written

WINDOW = 13
#: Windows that are broadcast at once; larger benchmarks are joined in blocks of about so many.
BLOCK_WINDOWS = 100_000
#: Distinct benchmark words that are broadcast for counting; more are joined by shuffle.
COUNTED_WORDS = 500_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cased (A-Z) words: runs of digits, letters and anything beyond ASCII. Null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _GAP), "")


def item_windows(benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """(window array<string>, item string): the distinct windows of each item, once for each item that has them. An item of fewer than width words, but not none, is
    one window; a null item_id is named ''. Items without words, null or empty, have none; repeated items count once; other columns
    aren't read, and an empty table gives no rows."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))
    return items.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, width))).alias("window")).distinct()


def prefixes(windows: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, window, word, at) of windows (id, window): the rarest word over all documents and its first place,
    of equally rare words the least. Null and empty documents hold no word; without documents every word
    is as rare; no windows give no rows; other columns aren't read."""
    terms = written(windows.select(F.explode("window").alias("word")).distinct(), "benchmark_words")
    few = terms.count() <= COUNTED_WORDS
    tokens = docs.select(F.explode(words(F.col("text"))).alias("word"))
    counts = tokens.join(F.broadcast(terms) if few else terms, "word", "left_semi").groupBy("word").count()
    placed = windows.select("id", "window", F.posexplode("window").alias("at", "word"))
    placed = placed.join(F.broadcast(counts) if few else counts, "word", "left")
    ranked = placed.groupBy("id", "window").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "word", "at")).alias("p"))
    return ranked.select("id", "window", F.col("p.word").alias("word"), F.col("p.at").alias("at"))


def _row_key(docs: DataFrame) -> list[Column]:
    return [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")]


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """One row for each row of docs (doc_id, text): (doc_id, text_hash, n_words, n_hit, items,
    spans array<struct<start, stop>> of words, contaminated).

    A word inside any occurrence of a window is hit; a document is contaminated when at least one word
    and a twentieth of its words are. Null and empty texts have no words and aren't contaminated; long
    texts are read whole; without benchmark items nothing is hit; without documents there are no rows;
    equal rows give equal rows; other columns are not read.
    """
    cut = item_windows(benchmark, width)
    windows = written(cut.select("window").distinct().withColumn("id", F.monotonically_increasing_id()), "windows")
    owners = cut.join(windows, "window").select("id", "item")
    table = written(prefixes(windows, docs), "prefixes")
    blocks = max(1, -(-table.count() // BLOCK_WINDOWS))
    # an empty word after the last one matches in every document, and so brings its length along
    end = table.sparkSession.range(1).select(F.lit(-1).cast("long").alias("id"), F.array().cast("array<string>").alias("window"), F.lit("").alias("word"), F.lit(0).alias("at"))
    tokens = docs.select(*_row_key(docs), words(F.col("text")).alias("w"))
    tokens = tokens.select("doc_id", "text_hash", "w", F.posexplode(F.concat("w", F.array(F.lit("")))).alias("pos", "word"))

    def matches(block: DataFrame) -> DataFrame:
        start, length = F.col("pos") - F.col("at"), F.size("window")
        near = tokens.join(F.broadcast(block), "word").where((start >= 0) & (start + length <= F.size("w")))
        exact = near.where((F.col("word") == "") | (F.slice("w", start + 1, length) == F.col("window")))
        return exact.select("doc_id", "text_hash", "word", "pos", "id", F.struct(start.alias("start"), (start + length).alias("stop")).alias("span"))

    parts = [table if blocks == 1 else table.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == i) for i in range(blocks)]
    found = reduce(DataFrame.unionByName, [matches(part.unionByName(end) if i == 0 else part) for i, part in enumerate(parts)])
    hit = F.col("word") != ""
    each = found.groupBy("doc_id", "text_hash").agg(
        F.max(F.when(~hit, F.col("pos"))).cast("long").alias("n_words"), F.count_if(~hit).alias("copies"),
        F.collect_set(F.when(hit, F.col("span"))).alias("spans"), F.collect_set(F.when(hit, F.col("id"))).alias("ids"),
    )
    each = written(each, "hits")
    # the items come to the windows found, once for each document
    named = each.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.explode("ids").alias("id")).join(owners, "id")
    named = named.groupBy("_id", "_hash").agg(F.collect_set("item").alias("items"))
    each = each.join(named, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    zero = F.struct(F.lit(0).alias("covered"), F.lit(0).alias("upto"))
    covered = F.aggregate(F.array_sort("spans"), zero, lambda a, s: F.struct(
        (a["covered"] + F.greatest(s["stop"] - F.greatest(s["start"], a["upto"]), F.lit(0))).alias("covered"), F.greatest(a["upto"], s["stop"]).alias("upto")))
    each = each.select("*", covered["covered"].cast("long").alias("n_hit"), F.array_sort(F.coalesce("items", F.array().cast("array<string>"))).alias("item_ids"))
    each = each.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return each.select("doc_id", "text_hash", "n_words", "n_hit", F.col("item_ids").alias("items"), F.array_sort("spans").alias("spans"), ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that aren't contaminated, with all their columns. Null and empty texts stay; repeated
    rows stay or go together; without benchmark items, or of an empty table, nothing goes."""
    number, text_hash, own = fresh(docs, "_id", "_hash", "_own")
    bad = contamination(docs, benchmark).where("contaminated").select(F.col("doc_id").alias(number), F.col("text_hash").alias(text_hash))
    mine = docs.withColumn(own, F.xxhash64(F.coalesce("text", F.lit(""))))
    return mine.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col(number)) & (F.col(own) == F.col(text_hash)), "left_anti").drop(own)
