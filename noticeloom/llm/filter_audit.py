"""How text filters interact: what each filter removes at each step of every order in which they may run.

A document's failure flags don't depend on the order, so documents are counted once by part and flags. A CUBE
over the flags and the part adds these counts up for every subset of filters; its grouping-set rows whose selected
flags are all false are the documents that survive the subset. A step of an order is a pair of subsets, the one before
and the one after it, and everything reported follows from the survivors of such pairs.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations
from operator import and_, or_
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_skewed, written

#: The filters, each a letter, in the order in which they are listed.
FILTERS = "ABCDE"

_WHITE = r"[\x20\x09-\x0D]+"


def failure_flags(docs: DataFrame) -> DataFrame:
    """(doc_id, part, A, B, C, D, E) of each row of docs (doc_id, text, lang): whether it fails a filter.

    A: under 200 words. B: under half of the words are distinct. C: over 3 % of the code points are A-Z. D: holds one of
    #$%&*|. E: the text is also that of a smaller doc_id. Words are runs without white space; texts count whole. A null text
    counts as empty, a null lang is part ''. Rows that share doc_id and text don't make one another fail E, and a null
    doc_id neither fails it nor makes others fail. An empty table gives no rows; other columns are not read.
    """
    words = F.array_remove(F.split("text", _WHITE), "")
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    own = read.withColumn("words", words).select(
        "doc_id", "part", (F.size("words") < 200).alias("A"), (100 * F.size(F.array_distinct("words")) < 50 * F.size("words")).alias("B"),
        (100 * F.length(F.regexp_replace("text", "[^A-Z]+", "")) > 3 * F.length("text")).alias("C"), F.col("text").rlike(r"[#$%&*|]").alias("D"),
        F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"),
    )
    own = written(own, "flags")  # the only reading of the texts
    repeated = written(own.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL"), "repeated")
    fails = F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False))
    return join_skewed(own, repeated, "digest", "n", how="left").select("doc_id", "part", *FILTERS[:4], fails.alias("E"))


def with_labels(flagged: DataFrame, labels: DataFrame) -> DataFrame:
    """flagged with good and toxic, whether labels (doc_id, quality, toxic) has a 1 for the document; without
    a label, or with nulls, neither. Of repeated labels any 1 counts, and labels of no document don't."""
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    return flagged.join(marks, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})


def survivors(flagged: DataFrame, filters: Sequence[str]) -> DataFrame:
    """(part, subset, n, good, toxic) for each part of flagged (part, a flag for each of filters, good, toxic) and
    each subset of filters, as bits in their order: how many documents fail none of it; zeros included."""
    cells = flagged.groupBy("part", *filters).agg(F.count("*").alias("n"), F.sum(F.col("good").cast("long")).alias("good"), F.sum(F.col("toxic").cast("long")).alias("toxic"))
    cells = written(cells, "cells")  # at most two to the number of filters rows for each part
    cube = cells.cube("part", *filters).agg(
        F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"), F.grouping("part").alias("whole"), *[F.grouping(f).alias(f"all_{f}") for f in filters])
    none_fails = reduce(and_, [(F.col(f"all_{f}") == 1) | ~F.col(f) for f in filters])
    subset = sum((1 - F.col(f"all_{f}").cast("int")) * 2**i for i, f in enumerate(filters))
    counted = cube.where((F.col("whole") == 0) & none_fails).select("part", subset.cast("int").alias("subset"), "n", "good", "toxic")
    grid = cells.select("part").distinct().withColumn("subset", F.explode(F.sequence(F.lit(0), F.lit(2 ** len(filters) - 1))))
    return grid.join(counted, ["part", "subset"], "left").fillna(0, ["n", "good", "toxic"])


def audit(flagged: DataFrame, filters: Sequence[str] = FILTERS) -> DataFrame:
    """One row for each part, order of the filters and step of it: (part, filter_order, step, filter, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley); documents are counted within the part.

    flagged has a row for each document: part, good, toxic and a flag for each of filters (single letters), none of
    them null. shapley is what the step's filter removes, summed over all orders. Without documents there are no rows. Beyond
    the first count, work depends on the number of parts and of filters alone.
    """
    names = "".join(filters)
    counts = written(survivors(flagged, filters), "survivors")
    bit = lambda letters: reduce(or_, (1 << names.index(c) for c in letters), 0)
    whole = bit(names)
    steps = [
        ("".join(order), k + 1, order[k], bit(order[:k]), bit(order[: k + 1]), bit(order[k]), whole - bit(order[k]))
        for order in permutations(names) for k in range(len(order))
    ]
    steps = flagged.sparkSession.createDataFrame(steps, "filter_order string, step int, filter string, before int, after int, alone int, others int")
    of = lambda prefix: counts.select("part", *[F.col(c).alias(f"{prefix}_{c}" if c != "subset" else prefix) for c in counts.columns if c != "part"])
    pairs = steps.join(of("before"), "before").join(of("after"), ["part", "after"])
    pairs = pairs.join(of("alone").select("part", "alone", "alone_n"), ["part", "alone"]).join(of("others").select("part", "others", "others_n"), ["part", "others"])
    total = counts.where("subset = 0").select("part", F.col("n").alias("all_n"))
    none = counts.where(F.col("subset") == whole).select("part", F.col("n").alias("none_n"))
    removed = F.col("before_n") - F.col("after_n")
    out = pairs.join(total, "part").join(none, "part").select(
        "part", "filter_order", "step", "filter", F.col("after_n").alias("kept"), removed.alias("removed"), (F.col("all_n") - F.col("alone_n") - removed).alias("redundant"),
        (F.col("others_n") - F.col("none_n")).alias("unique_fails"), (F.col("before_good") - F.col("after_good")).alias("good_lost"), (F.col("before_toxic") - F.col("after_toxic")).alias("toxic_lost"),
    )
    shares = out.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return out.join(shares, ["part", "filter"])
