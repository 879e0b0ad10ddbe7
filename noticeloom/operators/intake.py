"""Taking notices in and giving them out: interfaces, sightings, sites, lists, exports and logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeloom.functions.dates import kst_date
from noticeloom.functions.urls import host
from noticeloom.operators.institutions import _prefixes

# Where a sighting was made, the more official first; signs of a notice in plain text.
SURFACES = {"board": 1, "blog": 2, "social": 3}
#: Sources and sites of one place that are paired in one task, on either side.
BLOCK = 2048
TEXT_SIGNS, SHORT_TEXT = r"(?:신청|접수|모집)\s*(?:기간|방법|대상)|선착순|지원\s*대상", 80


def _or(tests: list[Column]) -> Column:
    return reduce(Column.__or__, tests) if tests else F.lit(False)


def policies(raw: DataFrame, regions: dict[str, str]) -> DataFrame:
    """(id, title, category, region, ages, start_day, end_day) of a policy interface's records, JSON in (value). Unknown
    regions, ages and periods are ''; a record that is no JSON has blank fields."""
    names = ("plcyNo", "plcyNm", "lclsfNm", "zipCd", "sprtTrgtMinAge", "sprtTrgtMaxAge", "aplyYmd")
    p = raw.select(F.from_json("value", ", ".join(f"{n} string" for n in names)).alias("p")).select(*[F.coalesce(F.trim(F.col(f"p.{n}")), F.lit("")).alias(n) for n in names])
    days = F.regexp_extract_all("aplyYmd", F.lit("([0-9]{8})"), F.lit(1))
    day = lambda i: F.coalesce(F.to_date(F.get(days, i), "yyyyMMdd").cast("string"), F.lit(""))
    known = F.create_map(*[F.lit(x) for kv in regions.items() for x in kv])
    ages = F.when((F.col("sprtTrgtMinAge") == "") & (F.col("sprtTrgtMaxAge") == ""), "").otherwise(F.trim(F.concat_ws(" ", "sprtTrgtMinAge", F.lit("~"), "sprtTrgtMaxAge")))
    return p.select(F.col("plcyNo").alias("id"), F.col("plcyNm").alias("title"), F.col("lclsfNm").alias("category"), F.coalesce(F.element_at(known, F.col("zipCd")), F.lit("")).alias("region"), ages.alias("ages"), day(0).alias("start_day"), day(1).alias("end_day"))


def open_data(raw: DataFrame, fields: dict[str, dict[str, str]], categories: dict[str, str]) -> DataFrame:
    """(api, id, title, category) of several interfaces' records (api, value): each by its own paths of fields, with the
    interface's category. Records of other interfaces are left out."""
    pick = lambda name: F.coalesce(*[F.when(F.col("api") == api, F.get_json_object("value", paths[name])) for api, paths in fields.items()])
    category = F.element_at(F.create_map(*[F.lit(x) for kv in categories.items() for x in kv]), F.col("api"))
    return raw.where(F.col("api").isin(*fields)).select("api", pick("id").alias("id"), pick("title").alias("title"), category.alias("category"))


def feed_item(item: Column) -> Column:
    """struct(title, link, description, published) of one RSS item; '' for what it lacks, blanks of descriptions squeezed."""
    part = lambda name: F.trim(F.regexp_replace(F.regexp_extract(item, rf"(?s)<{name}>(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?</{name}>", 1), r"\s+", " "))
    return F.struct(part("title").alias("title"), part("link").alias("link"), part("description").alias("description"), part("pubDate").alias("published"))


def keep_link(url: Column, title: Column, board: Column, exclude: tuple[str, ...] = (), include: tuple[str, ...] = (), titles: tuple[str, ...] = ()) -> Column:
    """Whether a board's link is one of its posts: on the board's host, by no excluded pattern of addresses or titles, and by
    an included one where there are any."""
    wanted = _or([url.rlike(p) for p in include]) if include else F.lit(True)
    return F.coalesce((host(url) == host(board)) & ~_or([url.rlike(p) for p in exclude]) & ~_or([F.coalesce(title, F.lit("")).rlike(p) for p in titles]) & wanted, F.lit(False))


def collectable_text(title: Column, text: Column, images: Column, source: Column) -> Column:
    """Whether a post without images is a notice by its text: with a title, a source, enough text and signs of a call."""
    full = F.coalesce(F.trim(text), F.lit(""))
    return (images == 0) & (F.coalesce(F.trim(title), F.lit("")) != "") & (F.coalesce(F.trim(source), F.lit("")) != "") & (F.length(full) >= SHORT_TEXT) & full.rlike(TEXT_SIGNS)


def upsert_sightings(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """(surface, url, title, ts, event_id, priority): one sighting for each surface and address, the latest; ties go to the
    largest event_id. Surfaces outside SURFACES come last in priority."""
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SURFACES.items() for x in kv]), F.col("surface")), F.lit(9))
    latest = stored.unionByName(seen).groupBy("surface", "url").agg(F.max(F.struct("ts", "event_id", "title")).alias("s"))
    return latest.select("surface", "url", F.col("s.title").alias("title"), F.col("s.ts").alias("ts"), F.col("s.event_id").alias("event_id"), rank.alias("priority"))


def _paired(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """left (slug, key, ...) and right (site, key, ...) joined by key. Both sides of a key are cut into blocks, and each two blocks
    meet under a key of their own, so that no key's pairs are all made in one task, nor those of several keys with few rows."""
    blocks = lambda rows, name: rows.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    sizes = blocks(left, "lefts").join(blocks(right, "rights"), key)
    tile = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    l = left.join(sizes, key).select(*left.columns, tile("slug", "lefts").alias("x"), every("rights").alias("y"))
    r = right.join(sizes, key).select(*right.columns, every("lefts").alias("x"), tile("site", "rights").alias("y"))
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number that is given isn't brought down for the small input that makes many pairs
    return l.repartition(tasks, *key, "x", "y").join(r.repartition(tasks, *key, "x", "y"), [*key, "x", "y"]).drop("x", "y")


def source_sites(sources: DataFrame, sites: DataFrame) -> DataFrame:
    """(slug, site), once each: the sites (site, name, url) of sources (slug, sites, name, list_url, homepage_url): the same slug, one
    listed, the same name, or the same host with one path within the other. Equi-joins on each take the place of comparing
    all pairs; of a path, all that lies above it is compared. What lies at one place is paired block by block.

    Pairs outnumber rows by far, so they aren't shuffled to find repeated ones: slugs and sites come with all that is known
    of them, and a pair is taken from the first of the joins that finds it, there at the least key."""
    def place(url: Column) -> Column:
        bare = F.regexp_extract(F.regexp_replace(F.trim(url), r"[?#].*$", ""), r"(?i)^https?://[^/]+(.*)$", 1)
        return F.struct(host(url).alias("h"), F.regexp_replace(bare, "/+$", "").alias("at"))

    def places(urls: Column) -> Column:
        return F.filter(F.transform(urls, place), lambda p: p["h"].isNotNull())

    def above(known: Column) -> Column:
        steps = lambda p: F.split(p["at"], "/")
        ups = lambda p: F.transform(F.sequence(F.lit(1), F.size(steps(p))), lambda n: F.struct(p["h"].alias("h"), F.array_join(F.slice(steps(p), F.lit(1), n), "/").alias("at")))
        return F.array_distinct(F.flatten(F.transform(known, ups)))

    every = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    none = F.array().cast("array<string>")
    named = F.collect_set(F.when(F.col("name") != "", F.col("name"))).alias("names")
    urls = lambda *kept: F.array_compact(F.array(*kept))
    left = sources.groupBy("slug").agg(every(F.coalesce(F.col("sites"), none)).alias("listed"), named, every(places(urls("list_url", "homepage_url"))).alias("places"))
    right = sites.groupBy("site").agg(named, every(places(urls(F.when(F.col("url") != "", F.col("url"))))).alias("places"))
    right = right.withColumnsRenamed({"names": "site_names", "places": "site_places"})
    equal, listed = F.coalesce(F.col("slug") == F.col("site"), F.lit(False)), F.coalesce(F.array_contains("listed", F.col("site")), F.lit(False))
    key, one = F.struct("h", "at"), (F.size("places") == 1) & (F.size("site_places") == 1)
    within, around = F.array_intersect(above(F.col("places")), "site_places"), F.array_intersect("places", above(F.col("site_places")))
    new = ~equal & ~listed & ~F.arrays_overlap("names", "site_names")
    at = lambda rows, c: rows.select("*", F.explode(c).alias("k")).select(*rows.columns, "k.*")
    name = lambda rows, c: rows.select("*", F.explode(c).alias("name"))
    by = [
        left.select("slug", F.col("slug").alias("site")).join(right.select("site"), "site"),
        left.select("slug", F.explode("listed").alias("site")).join(right.select("site"), "site").where(~equal),
        _paired(name(left, "names"), name(right, "site_names"), ["name"]).where(~equal & ~listed & (F.array_min(F.array_intersect("names", "site_names")) == F.col("name"))),
        _paired(at(left, above(F.col("places"))), at(right, "site_places"), ["h", "at"]).where(new & F.when(one, True).otherwise(F.array_min(within) == key)),
        _paired(at(left, "places"), at(right, above(F.col("site_places"))), ["h", "at"]).where(
            new & F.when(one, F.get("places", 0) != F.get("site_places", 0)).otherwise((F.size(within) == 0) & (F.array_min(around) == key))),
    ]
    return reduce(DataFrame.unionByName, [d.select("slug", "site") for d in by])


def longest_prefix(rows: DataFrame, dirs: DataFrame) -> DataFrame:
    """(id, source): of rows (id, url) the source whose directory (source, dir) is the longest that the address begins with,
    by equi-joins on everything above the address; the least source on ties."""
    d = dirs.select("source", F.lower("dir").alias("dir"))
    found = rows.select("id", F.explode(_prefixes(F.col("url"))).alias("dir")).distinct().join(d, "dir")
    return found.groupBy("id").agg(F.max(F.struct(F.length("dir").alias("n"), (-F.col("source")).alias("s"))).alias("b")).select("id", (-F.col("b.s")).alias("source"))


def hybrid_list(rows: DataFrame, semantic: DataFrame, query: str, columns: list[str], authors: DataFrame, keep: Column, limit: int) -> DataFrame:
    """(id, title, org, similarity): rows found by meaning (id, similarity) or by keyword, filtered, with their authors'
    organisation; by similarity, then the latest end."""
    hit = _or([F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(query.lower())) for c in columns])
    found = rows.where(keep).join(semantic, "id", "left").where(F.col("similarity").isNotNull() | hit)
    top = found.orderBy(F.col("similarity").desc_nulls_last(), F.desc("end_at"), "id").limit(limit)
    return top.join(authors, "author", "left").select("id", "title", "org", "similarity")


def filled(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """old with blank and null values taken from new's row of the same key; what is there stays."""
    joined = old.alias("o").join(new.alias("n"), key, "left")
    value = lambda c: F.coalesce(F.nullif(F.trim(F.col(f"o.{c}")), F.lit("")), F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c)
    return joined.select(key, *[value(c) for c in columns])


def csv_line(*values: Column) -> Column:
    """A CSV line: fields quoted only where they hold quotes, commas or line breaks; null is blank."""
    text = [F.coalesce(v.cast("string"), F.lit("")) for v in values]
    return F.concat_ws(",", *[F.when(t.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t) for t in text])


def checkpoint_sites(rows: DataFrame, folder: str, site: str) -> DataFrame:
    """Writes the results of the sites in rows, over those that these sites had before; all sites' results so far."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(site).parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder).select(*rows.columns)


def audit(before: DataFrame, after: DataFrame, key: str, columns: list[str], actor: str) -> DataFrame:
    """(key, actor, field, old, new): a row of the log for each value that a write changes."""
    pairs = before.alias("b").join(after.alias("a"), key)
    each = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"b.{c}").cast("string").alias("old"), F.col(f"a.{c}").cast("string").alias("new")) for c in columns])
    long = pairs.select(key, F.explode(each).alias("c")).select(key, "c.*")
    return long.where(~F.col("old").eqNullSafe(F.col("new"))).select(key, F.lit(actor).alias("actor"), "field", "old", "new")


def image_dataset(rows: DataFrame, labels: dict[str, str]) -> DataFrame:
    """(id, image, label): images with the label of their notice's status; those of other statuses are left out."""
    label = F.element_at(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]), F.col("status"))
    return rows.where(F.col("image").isNotNull() & F.col("status").isin(*labels)).select("id", "image", label.alias("label"))


def close_stale(runs: DataFrame, now: Column, minutes: int, reason: str) -> DataFrame:
    """(id, started_at, status, minutes, reason): the updates that end runs which have been running for so many minutes."""
    taken = F.timestamp_diff("MINUTE", F.col("started_at"), now)
    return runs.where((F.col("status") == "running") & (taken >= minutes)).select("id", "started_at", F.lit("error").alias("status"), taken.alias("minutes"), F.lit(reason).alias("reason"))


def clamped_number(text: Column, least: int, most: int, otherwise: int) -> Column:
    """A parameter's whole number within bounds; `otherwise` for what is no number."""
    number = F.floor(F.trim(text).try_cast("double")).cast("int")
    return F.when(number.isNull(), otherwise).otherwise(F.greatest(F.lit(least), F.least(F.lit(most), number)))


def comment_notices(comments: DataFrame, notices: DataFrame) -> DataFrame:
    """(comment, receiver, notice): whom a new comment is told to: the notice's owner, if that isn't its author and wants to
    know. comments may be a stream: notices are joined as they stand."""
    joined = comments.join(notices, "notice")
    return joined.where((F.col("author") != F.col("owner")) & F.col("wants")).select("comment", F.col("owner").alias("receiver"), "notice")


def daily_jobs(notices: DataFrame, now: Column) -> DataFrame:
    """(at, id, action): what the three jobs of a night do, in their order: remind of notices that end on the next Korean day,
    close published ones that have ended, and expire candidates that have."""
    end, today = kst_date("end_at"), kst_date(now)
    jobs = [("00:00", "remind", (F.col("status") == "published") & (end == F.date_add(today, 1))), ("00:05", "close", (F.col("status") == "published") & (end < today)), ("00:10", "expire", (F.col("status") == "candidate") & (end < today))]
    due = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(at).alias("at"), F.lit(action).alias("action"))) for at, action, test in jobs]))
    return notices.select("id", F.explode(due).alias("j")).select("j.at", "id", "j.action")
