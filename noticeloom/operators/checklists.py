"""Ordered findings on a row: approval checks, run hints, source diagnosis, trust in verified facts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STATES = ("pass", "warning", "block")


def checklist(checks: list[tuple[str, Column]]) -> Column:
    """array<struct<key, state>> of the checks, in order; those whose state is null don't apply."""
    each = [F.when(state.isNotNull(), F.struct(F.lit(key).alias("key"), state.alias("state"))) for key, state in checks]
    return F.array_compact(F.array(*each))


def tally(checks: Column) -> dict[str, Column]:
    """How many checks have each state."""
    def count(state: str) -> Column:
        return F.size(F.filter(checks, lambda c: c["state"] == state))

    return {s: count(s) for s in STATES}


def approval(title: Column, org: Column, source: Column, external: Column, media: Column, end: Column, now: Column, date_issues: Column, category: Column, region: Column, summary: Column, attachments_failed: Column, issues: Column) -> Column:
    """The checks before a notice is published. external, attachments_failed: null where there is nothing to check."""
    filled = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    warn = lambda good: F.when(good, "pass").otherwise("warning")
    return checklist([
        ("title", F.when(filled(title), "pass").otherwise("block")), ("organization", warn(filled(org))), ("source", F.when(F.coalesce(source.rlike(r"^https?://[^/\s]+"), F.lit(False)), "pass").otherwise("block")),
        ("external-original", F.when(external.isNotNull(), warn(external))), ("media", warn(media)), ("deadline", warn(F.coalesce(end >= now, F.lit(True)) & (date_issues == 0))), ("category", warn(filled(category))),
        ("region", warn(filled(region))), ("summary", warn(filled(summary))), ("attachments", F.when(attachments_failed.isNotNull(), warn(~attachments_failed))), ("verification", warn(issues == 0)),
    ])


def findings(rules: list[tuple[str, Column]], most: int, otherwise: str) -> Column:
    """array<string>: the first `most` rules that hold, in order, or what stands for none."""
    found = F.slice(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), name) for name, c in rules])), 1, most)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(otherwise)))


def run_hints(run: dict[str, Column]) -> Column:
    """Up to six hints on a run from its counters; 'healthy' where none applies."""
    some = lambda *names: sum((F.coalesce(run[n], F.lit(0)) for n in names), F.lit(0)) > 0
    return findings([
        ("stale-run", run["stale"]), ("empty-list", (run["status"] == "empty") | (run["checked"] == 0)), ("parse-failures", some("board_failed", "detail_failed")), ("text-only-notices", some("no_image")),
        ("images-rejected", some("image_rejected")), ("external-failures", some("external_failed")), ("attachment-failures", some("attachment_failed")), ("nothing-valid", (run["checked"] >= 5) & (run["valid"] == 0)),
    ], 6, "healthy")


def source_level(attention: Column, errors: Column, run_status: Column, stale: Column, watch: Column, planned: Column, checked: Column) -> Column:
    """critical, warning or ok."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(yes(attention) | yes(errors > 0) | yes(run_status == "error") | yes(stale), "critical").when(yes(watch) | yes(planned) | yes(checked == 0), "warning").otherwise("ok")


def trust(status: Column, verified_at: Column, deadline_type: Column, end: Column, event_start: Column, facts: list[Column]) -> Column:
    """struct(verified, seo_ready, calendar_ready, deadline_ready): what verified facts may be used for."""
    verified = F.coalesce(status == "verified", F.lit(False)) & verified_at.isNotNull()
    fixed = F.coalesce(deadline_type == "fixed", F.lit(False)) & end.isNotNull()
    told = F.lit(False)
    for f in facts:
        told = told | (F.coalesce(F.trim(f), F.lit("")) != "")
    return F.struct(verified.alias("verified"), (verified & (end.isNotNull() | event_start.isNotNull() | told)).alias("seo_ready"), (verified & (event_start.isNotNull() | fixed)).alias("calendar_ready"), (verified & fixed).alias("deadline_ready"))
