"""Links and images of notices, and what is handed on: calendars, structured data, site maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeloom.functions.urls import image_identity, link_type, source_key


def assembled_links(links: DataFrame) -> DataFrame:
    """links (id, position, declared, url, label, is_primary) once for each kind and address, the first one's label
    kept, with exactly one primary link a notice: the first that any of its copies marks, if there is one."""
    typed = links.select("id", "position", link_type(F.col("declared"), F.col("url"), F.col("label")).alias("type"), source_key(F.col("url")).alias("key"), "label", "is_primary").where("key IS NOT NULL")
    once = typed.groupBy("id", "type", "key").agg(F.min("position").alias("position"), F.min_by("label", "position").alias("label"), F.max("is_primary").alias("marked"))
    first = Window.partitionBy("id").orderBy(F.col("marked").desc(), "position")
    return once.select("id", "position", "type", "key", "label", (F.col("marked") & (F.row_number().over(first) == 1)).alias("is_primary"))


def ordered_images(images: DataFrame) -> DataFrame:
    """images (id, url, score, passes, proxy, portrait) with their place: tall originals first where there are any;
    else thumbnails before originals where several originals follow them; else by score; rejected ones last."""
    w = Window.partitionBy("id")
    good = F.col("passes")
    tall = F.max(good & ~F.col("proxy") & F.col("portrait")).over(w)
    carousel = F.max(good & F.col("proxy")).over(w) & (F.count_if(good & ~F.col("proxy")).over(w) > 1)
    group = F.when(~good, 9).when(F.col("_tall"), F.when(F.col("proxy"), 8).when(F.col("portrait"), 0).otherwise(1)).when(F.col("_carousel"), F.when(F.col("proxy"), 0).otherwise(1)).otherwise(0)
    rows = images.withColumns({"_tall": tall, "_carousel": carousel}).withColumn("_g", group).where(~((F.col("_g") == 8) & F.col("_tall")))
    return rows.withColumn("place", F.row_number().over(w.orderBy("_g", F.desc("score"), "url"))).select("id", "url", "place")


def representative(images: DataFrame, boards_first: bool = False) -> DataFrame:
    """(id, url): of images (id, url, width, height, priority) the largest; on ties the larger priority number, as
    the rule has been applied so far, or, with boards_first, the smaller one."""
    area = F.coalesce("width", F.lit(0)) * F.coalesce("height", F.lit(0))
    rank = F.coalesce("priority", F.lit(0)) * (-1 if boards_first else 1)
    return images.where("url <> ''").groupBy("id").agg(F.max_by("url", F.struct(area.alias("a"), rank.alias("p"), F.col("url"))).alias("url"))


def distinct_gallery(urls: Column) -> Column:
    """The addresses of an array, the first of each image identity."""
    keyed = F.transform(urls, lambda u: F.struct(image_identity(u).alias("k"), u.alias("u")))
    return F.transform(F.filter(keyed, lambda s, i: F.array_position(F.transform(keyed, lambda x: x["k"]), s["k"]) == i + 1), lambda s: s["u"])


def calendar(id_: Column, title: Column, start: Column, end: Column, stamp: Column, product: str) -> Column:
    """An iCalendar event; it lasts an hour where it has no end, and is null without a start."""
    when = lambda c: F.date_format(c, "yyyyMMdd'T'HHmmss'Z'")
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(title, r"\\", r"\\\\"), "([,;])", r"\\$1"), r"\r?\n", r"\\n")
    until = F.coalesce(end, start + F.expr("INTERVAL 1 HOUR"))
    lines = [F.lit("BEGIN:VCALENDAR"), F.lit("VERSION:2.0"), F.lit(f"PRODID:{product}"), F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), id_.cast("string")), F.concat(F.lit("DTSTAMP:"), when(stamp)),
             F.concat(F.lit("DTSTART:"), when(start)), F.concat(F.lit("DTEND:"), when(until)), F.concat(F.lit("SUMMARY:"), text), F.lit("END:VEVENT"), F.lit("END:VCALENDAR")]
    return F.when(start.isNotNull(), F.concat_ws("\r\n", *lines))


def structured_data(title: Column, org: Column, start: Column, end: Column, verified: Column) -> Column:
    """schema.org JSON of an event; dates only where they are verified."""
    day = lambda c: F.when(verified, F.date_format(c, "yyyy-MM-dd"))
    return F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit("Event").alias("@type"), title.alias("name"), day(start).alias("startDate"), day(end).alias("endDate"), F.struct(F.lit("Organization").alias("@type"), org.alias("name")).alias("organizer")))


def site_map(notices: DataFrame, regions: DataFrame, categories: DataFrame, most: int = 500) -> DataFrame:
    """(region, category, active, total): the pairs that occur on notices (id, active), the most active first."""
    pairs = notices.join(regions, "id").join(categories, "id").groupBy("region", "category")
    return pairs.agg(F.count_if(F.col("active")).alias("active"), F.count("*").alias("total")).orderBy(F.desc("active"), "region", "category").limit(most)
