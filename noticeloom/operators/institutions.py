"""Institutions and sources behind notices: which one a notice belongs to, and what there is to register."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeloom.functions.text import name_id
from noticeloom.functions.urls import directory, host, path


def name_key(name: Column) -> Column:
    return F.nullif(F.lower(F.trim(name)), F.lit(""))


def _prefixes(url: Column) -> Column:
    """array<string>: every directory above an address, so that a prefix match becomes an equi-join."""
    parts = F.split(F.lower(F.trim(url)), "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda n: F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/")))


def resolve(notices: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, institution): of notices (id, org, url) by sources (institution, slug, name, list_url, homepage_url, status).

    An exact name goes before a directory that the address lies in, the longest first, before a host that
    only one source has; then active sources, then by slug. Retired sources and those of no
    institution don't count. Only the best source of each name, directory, both and host is joined, so that a notice
    meets one row for each of these, however many sources share it.
    """
    s = sources.where(F.col("institution").isNotNull() & (F.col("status") != "retired")).select(
        "institution", "slug", name_key(F.col("name")).alias("name"), F.lower(directory(F.col("list_url"))).alias("dir"), host(F.col("list_url")).alias("h1"), host(F.col("homepage_url")).alias("h2"),
        F.greatest(F.coalesce(F.length(directory(F.col("list_url"))), F.lit(0)), F.coalesce(F.length(directory(F.col("homepage_url"))), F.lit(0))).alias("depth"), (F.col("status") == "active").alias("active"),
    )
    n = notices.select("id", name_key(F.col("org")).alias("name"), F.explode_outer(_prefixes(F.col("url"))).alias("dir"), host(F.col("url")).alias("host"))
    best = F.min(F.struct((-F.col("depth")).alias("depth"), (~F.col("active")).alias("idle"), "slug", "institution")).alias("b")
    hosts = s.select(F.explode(F.array_distinct(F.array_compact(F.array("h1", "h2")))).alias("host"), "depth", "active", "slug", "institution")
    single = hosts.groupBy("host").agg(F.count("*").alias("n"), best).where("n = 1")
    ways = [
        n.join(s.groupBy("name", "dir").agg(best), ["name", "dir"]), n.select("id", "name").distinct().join(s.groupBy("name").agg(best), "name"), n.join(s.groupBy("dir").agg(best), "dir"),
        n.select("id", "host").distinct().join(single, "host"),
    ]
    found = reduce(DataFrame.unionByName, [way.select("id", F.struct(F.lit(k).alias("way"), "b").alias("w")) for k, way in enumerate(ways)])
    return found.groupBy("id").agg(F.min("w").alias("w")).select("id", F.col("w.b.institution").alias("institution"))


def best_source(posts: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, source, score): of posts (id, site, site_name, url) the source with the most points: its slug 1000, its
    name 900, its list's host 700 and up to 200 for the list's path, its homepage's host 600; slug on ties. Only the least
    slug of each name, host and list path is joined, with each place (host, path) of posts once; list paths are met as the
    beginnings of a place's path, by equi-joins."""
    p = posts.select("id", "site", "site_name", host(F.col("url")).alias("h"), path(F.col("url")).alias("path"))
    s = sources.select(F.col("slug").alias("source"), "name", host(F.col("list_url")).alias("lh"), path(F.col("list_url")).alias("lp"), host(F.col("homepage_url")).alias("hh"))
    first = F.min("source").alias("source")
    lists = s.where("lh IS NOT NULL").groupBy(F.col("lh").alias("h"), F.col("lp").alias("start")).agg(first)
    points = lambda n: F.struct((-n).cast("int").alias("points"), "source").alias("b")
    places = p.where("h IS NOT NULL").select("h", "path").distinct()
    above = places.join(lists.select("h", F.length("start").alias("n")).distinct(), "h").where(F.length("path") >= F.col("n")).select("h", "path", F.left("path", F.col("n")).alias("start"))
    near = [
        above.join(lists, ["h", "start"]).select("h", "path", points(700 + F.least(F.length("start"), F.lit(200)))), places.join(lists.groupBy("h").agg(F.min("source").alias("source")), "h").select("h", "path", points(F.lit(700))),
        places.join(s.groupBy(F.col("hh").alias("h")).agg(first), "h").select("h", "path", points(F.lit(600))),
    ]
    best = reduce(DataFrame.unionByName, near).groupBy("h", "path").agg(F.min("b").alias("b"))
    rows = [
        p.join(s.select("source").distinct(), F.col("site") == F.col("source")).select("id", points(F.lit(1000))), p.join(s.groupBy("name").agg(first), F.col("site_name") == F.col("name")).select("id", points(F.lit(900))),
        p.join(best, ["h", "path"]).select("id", "b"),
    ]
    found = reduce(DataFrame.unionByName, rows).groupBy("id").agg(F.min("b").alias("b"))
    return found.select("id", "b.source", (-F.col("b.points")).alias("score"))


def registration_plan(names: DataFrame, institutions: DataFrame) -> DataFrame:
    """(name_key, id, name): institutions to create for names (name) that none of institutions (name) has."""
    new = names.select(name_key(F.col("name")).alias("name_key"), F.trim("name").alias("name")).where("name_key IS NOT NULL").groupBy("name_key").agg(F.min("name").alias("name"))
    known = institutions.select(name_key(F.col("name")).alias("name_key")).distinct()
    return new.join(known, "name_key", "left_anti").select("name_key", name_id("org-", F.col("name")).alias("id"), "name")


def coverage(boards: DataFrame, blogs: DataFrame, matches: DataFrame, least: float = 0.7) -> DataFrame:
    """(institution, board, blog, overlap, rate, grade): how much of the boards (institution, id) the blogs have too;
    matches (id) are the board notices that a blog notice was merged with."""
    count = lambda d, c: d.groupBy("institution").agg(F.count("*").alias(c))
    rows = count(boards, "board").join(count(blogs, "blog"), "institution", "full_outer").join(count(boards.join(matches, "id", "left_semi"), "overlap"), "institution", "left")
    filled = rows.select("institution", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("board", "blog", "overlap")])
    rate = F.col("overlap") / F.nullif(F.col("board"), F.lit(0))
    return filled.select("*", F.round(F.coalesce(rate, F.lit(0.0)), 4).alias("rate"), F.when(F.col("board") == 0, "none").when(rate >= least, "blog").otherwise("board").alias("grade"))
