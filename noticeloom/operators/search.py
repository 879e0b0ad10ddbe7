"""Finding notices: keyword, synonym and vector search, with semi-joined facets and ranked results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeloom.functions import vectors

#: Results of a search: by default, and at most.
DEFAULT_LIMIT, MOST = 60, 100


def clamp(limit: int | None) -> int:
    return min(MOST, max(1, limit if limit is not None else DEFAULT_LIMIT))


def keyword(rows: DataFrame, query: str | None, columns: list[str]) -> DataFrame:
    """Rows that have the trimmed query in any of the columns, case aside; a blank query filters nothing.
    The pattern signs % and _ keep their meaning."""
    term = (query or "").strip()
    if not term:
        return rows
    return rows.where(reduce(Column.__or__, [F.coalesce(F.col(c).ilike(f"%{term}%"), F.lit(False)) for c in columns]))


def open_at(rows: DataFrame, end: str, now: Column, include_closed: bool = False, strict: bool = False) -> DataFrame:
    """Rows without an end, or whose end isn't before now (strict: is after now)."""
    if include_closed:
        return rows
    later = F.col(end) > now if strict else F.col(end) >= now
    return rows.where(F.col(end).isNull() | later)


def having(rows: DataFrame, bridge: DataFrame, key: str, column: str, values: list | None) -> DataFrame:
    """Rows with a bridge row of one of the values; None filters nothing."""
    return rows if values is None else rows.join(bridge.where(F.col(column).isin(*values)), key, "left_semi")


def synonyms_of(term: str, dictionary: DataFrame) -> DataFrame:
    """(term): the term, what it points to and what points to it; case aside, distinct."""
    t = F.lit(term.strip().lower())
    same = dictionary.sparkSession.range(1).select(t.alias("term"))
    forth = dictionary.where(F.lower("word") == t).select(F.lower("synonym").alias("term"))
    back = dictionary.where(F.lower("synonym") == t).select(F.lower("word").alias("term"))
    return same.union(forth).union(back).distinct()


def synonym_search(rows: DataFrame, term: str, dictionary: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that have any of the term's synonyms in any of the columns. The terms, a dictionary entry's
    few, become one array beside each row."""
    terms = synonyms_of(term, dictionary).agg(F.collect_list("term").alias("_terms"))
    text = F.lower(F.concat_ws("\n", *columns))
    return rows.crossJoin(F.broadcast(terms)).where(F.exists("_terms", lambda t: F.contains(text, t))).drop("_terms")


def nearest(rows: DataFrame, vector: str, query: Column, least: float, limit: int | None, tie: list) -> DataFrame:
    """Rows with similarity at least `least` to the query, the nearest first: an exact scan and a top-k."""
    scored = rows.where(F.col(vector).isNotNull()).withColumn("similarity", vectors.similarity(F.col(vector), query))
    return scored.where(F.col("similarity") >= least).orderBy(F.desc("similarity"), *tie).limit(clamp(limit))


def region_scope(regions: DataFrame, region_id: int) -> DataFrame:
    """(id) that a region covers for the server: all for the nation, itself and its children for a province,
    itself and its parent for a district."""
    own = regions.where(F.col("id") == region_id).select(F.col("level").alias("_level"), F.col("parent_id").alias("_parent"))
    r = regions.crossJoin(F.broadcast(own))
    me = F.col("id") == region_id
    return r.where((F.col("_level") == "nation") | me | ((F.col("_level") == "sido") & (F.col("parent_id") == region_id)) | ((F.col("_level") == "sigungu") & (F.col("id") == F.col("_parent")))).select("id")


def region_lineage(regions: DataFrame, region_id: int, depth: int = 4) -> DataFrame:
    """(id): a region, its children and all its ancestors; trees are at most `depth` levels high."""
    own = regions.where(F.col("id") == region_id).select("id", "parent_id")
    found, at = own.select("id"), own
    for _ in range(depth):
        at = regions.join(at.select(F.col("parent_id").alias("id")), "id").select("id", "parent_id")
        found = found.union(at.select("id"))
    return found.union(regions.where(F.col("parent_id") == region_id).select("id")).distinct()


def page(rows: DataFrame, order: list, offset: int, size: int) -> DataFrame:
    """One page and, in each of its rows, the number of all rows."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(offset).limit(size).crossJoin(F.broadcast(total))


def any_key(rows: DataFrame, columns: list[str], keys: DataFrame, key: str) -> DataFrame:
    """Rows with any of the columns among the keys, through one exploded equi-join."""
    flat = rows.withColumn("_key", F.explode(F.array_compact(F.array_distinct(F.array(*columns)))))
    found = flat.join(keys.select(F.col(key).alias("_key")).distinct(), "_key", "left_semi")
    return rows.join(found.select("id").distinct(), "id", "left_semi")
