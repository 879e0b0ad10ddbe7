"""Edits of notices as plans: what changed, what forbids it, and what it means for verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeloom.operators.checklists import checklist


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(c.cast("string")), F.lit("")) == ""


def changed_fields(before: dict[str, Column], after: dict[str, Column]) -> Column:
    """array<string>: the fields whose values differ; blank and null are the same."""
    text = lambda c: F.coalesce(F.trim(c.cast("string")), F.lit(""))
    return F.array_compact(F.array(*[F.when(text(before[n]) != text(after[n]), n) for n in after]))


def edit_plan(rows: DataFrame, fields: list[str]) -> DataFrame:
    """rows: (id, old struct, new struct, reviewed, noted, has_image, source_url) to (id, changed, errors, verified).

    errors: what forbids the edit: missing title or organisation, reversed periods or ages, confidence outside 0 to 1,
    and, for an edit that verifies afresh, an incomplete review. verified: fresh, kept, dropped or none.
    """
    old, new = F.col("old"), F.col("new")
    changed = changed_fields({f: old[f] for f in fields}, {f: new[f] for f in fields})
    was, now = (F.coalesce(s["verified"], F.lit(False)) for s in (old, new))
    fresh = now & (~was | (F.size(changed) > 0))
    sure = lambda c: F.coalesce(c, F.lit(False))
    rules = [
        ("missing-title", _blank(new["title"])), ("missing-organization", _blank(new["org"])), ("period-order", sure(new["start"] > new["end"])), ("age-order", sure(new["age_min"] > new["age_max"])),
        ("age-range", sure(~new["age_min"].between(0, 120)) | sure(~new["age_max"].between(0, 120))), ("confidence-range", sure(~new["confidence"].between(0, 1))),
        ("review-incomplete", fresh & ~sure(F.col("reviewed"))), ("note-missing", fresh & ~sure(F.col("noted"))), ("source-missing", fresh & ~sure(F.col("source_url").rlike("(?i)^https?://"))), ("image-missing", fresh & ~sure(F.col("has_image"))),
    ]
    errors = F.array_compact(F.array(*[F.when(c, name) for name, c in rules]))
    state = F.when(fresh, "fresh").when(now, "kept").when(was, "dropped").otherwise("none")
    return rows.select("id", changed.alias("changed"), errors.alias("errors"), state.alias("verified"))


def preflight(title: Column, source: Column, external: Column, org: Column, start: Column, end: Column, now: Column, category: Column, summary: Column, attachments_failed: Column, duplicates: Column, issues: Column) -> Column:
    """The checks before a candidate becomes a notice. external, attachments_failed: null where there is nothing to check."""
    warn = lambda good: F.when(F.coalesce(good, F.lit(True)), "pass").otherwise("warning")
    return checklist([
        ("title", F.when(_blank(title), "block").otherwise("pass")), ("source", F.when(F.coalesce(source.rlike(r"(?i)^https?://[^/\s]+"), F.lit(False)), "pass").otherwise("block")),
        ("external-original", F.when(external.isNotNull(), warn(external))), ("organization", warn(~_blank(org))), ("period", warn((F.coalesce(end >= now, F.lit(True))) & F.coalesce(start <= end, F.lit(True)))),
        ("category", warn(~_blank(category))), ("summary", warn(~_blank(summary))), ("attachments", F.when(attachments_failed.isNotNull(), warn(~attachments_failed))), ("duplicate", warn(duplicates == 0)), ("quality", warn(issues == 0)),
    ])


def filled_facts(candidate: DataFrame, columns: list[str], accepted: Column) -> DataFrame:
    """candidate with found_<column> taken over where the column itself is empty and the finding is accepted."""
    return candidate.withColumns({c: F.when(~_blank(F.col(c)), F.col(c)).otherwise(F.when(accepted, F.col(f"found_{c}"))) for c in columns})


def converted(candidates: DataFrame, categories: DataFrame, regions: DataFrame) -> DataFrame:
    """Notices from candidates (id, title, category, region_names array): codes of names by two joins with small tables
    (name, code); names without a code are dropped, an unknown category becomes 'etc'."""
    named = candidates.select("id", "title", F.lower(F.trim("category")).alias("name"), "region_names")
    coded = named.join(categories.select(F.lower("name").alias("name"), F.col("code").alias("category_code")), "name", "left")
    places = candidates.select("id", F.explode("region_names").alias("name")).join(regions.select("name", "code"), "name").groupBy("id").agg(F.sort_array(F.collect_set("code")).alias("region_codes"))
    return coded.join(places, "id", "left").select("id", "title", F.coalesce("category_code", F.lit("etc")).alias("category_code"), F.coalesce("region_codes", F.array().cast("array<string>")).alias("region_codes"))


def reminders(favorites: DataFrame, notices: DataFrame, sent: DataFrame, due: Column) -> DataFrame:
    """(user_id, id) to remind: favourites (user_id, id) of notices (id, verified, kind, end_at) that are verified, fixed
    and due, without those already sent (user_id, id)."""
    ending = notices.where(F.col("verified") & (F.col("kind") == "fixed") & due).select("id")
    return favorites.select("user_id", "id").distinct().join(ending, "id").join(sent, ["user_id", "id"], "left_anti").select("user_id", "id")
