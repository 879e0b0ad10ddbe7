"""Addresses: hosts, directories, identities and link classes, in built-in string functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parameters that don't change which notice an address names.
SOURCE_URL_PARAMS = ("page", "pageIndex", "cp", "sort", "searchKeyword", "utm_source", "utm_medium", "utm_campaign")
SOURCE_KEY_PARAMS = (
    "cp", "cpage", "page", "pageIndex", "pageNum", "pageNo", "recordCountPerPage", "rows", "rowsSel", "perPage", "hashCode",
    "cat", "schPblancDiv", "schJrsdCodeTy", "schWntyAt", "schAreaDetailCodes", "schEndAt", "orderGb", "sort", "preKeywords",
    "condition", "condition1", "sortOrder", "sortDirection", "listType", "baNotice", "baCommSelec", "baOpenDay", "baUse",
    "searchKeyword", "searchCondition",
)
IMAGE_PARAMS = ("w", "h", "width", "height", "q", "quality", "resize", "thumb", "thumbnail", "cache")
# Hosts, paths and labels of application forms, and of shared form services.
APPLICATION_HOSTS = r"^forms\.gle$|(^|\.)form\.naver\.com$|(^|\.)forms?\.office\.com$|(^|\.)typeform\.com$|(^|\.)tally\.so$"
APPLICATION_PATHS = r"^/forms(/|$)|/viewform(/|$|\?)|/(apply|application|register|registration|signup|reservation|booking)(/|$)"
APPLICATION_LABELS = r"신청|접수|지원(하기|\s*신청|서|\s*접수)|응모|등록|예약|apply|application|register|registration|sign[\s-]?up|booking"
SHARED_FORMS = r"(^|//)(forms\.gle|docs\.google\.com/forms|form\.naver\.com|forms\.office\.com)(/|$)"


def _with(parts: dict[str, Column], body) -> Column:
    """body(parts), with each part worked out once, however often the body names it."""
    return F.get(F.transform(F.array(F.struct(*[c.alias(n) for n, c in parts.items()])), body), 0)


def host(url: Column) -> Column:
    """The host of an http or https address, in lower case, without 'www.' and port; null for others."""
    found = F.regexp_extract(F.lower(F.trim(url)), r"^https?://([^/?#]+)", 1)
    return F.nullif(F.regexp_replace(F.regexp_replace(found, r":[0-9]+$", ""), r"^www\.", ""), F.lit(""))


def directory(url: Column) -> Column:
    """The address up to its last slash, without query and fragment."""
    return F.nullif(F.regexp_replace(F.regexp_replace(F.trim(url), r"[?#].*$", ""), r"[^/]*$", ""), F.lit(""))


def path(url: Column) -> Column:
    """The path of an address, '/' where it has none."""
    found = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/[^?#]*)?", 1)
    return F.when(found == "", "/").otherwise(found)


def query_param(url: Column, key: str) -> Column:
    """The value of a query parameter, undecoded; null where it is missing."""
    found = F.regexp_extract(url, rf"[?&]{key}=([^&#]*)", 1)
    return F.when(url.rlike(rf"[?&]{key}="), found)


def _params(url: Column, drop: tuple[str, ...], drop_blank: bool) -> Column:
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.split(p, "=")[0].isin(*drop) & ~(F.lit(drop_blank) & (F.trim(F.regexp_extract(p, r"^[^=]*=(.*)$", 1)) == "")))
    return F.transform(F.array_sort(F.transform(kept, lambda p: F.struct(F.split(p, "=")[0].alias("k"), p.alias("p")))), lambda s: s["p"])


def _rebuilt(url: Column, drop: tuple[str, ...], drop_blank: bool) -> Column:
    params = F.when(F.contains(url, F.lit("?")), F.array_join(_params(url, drop, drop_blank), "&")).otherwise("")
    base = F.regexp_replace(url, r"[?#].*$", "")
    return F.concat(base, F.when(params == "", "").otherwise(F.concat(F.lit("?"), params)))


def source_url(url: Column) -> Column:
    """An address without fragment and passing parameters, parameters sorted, in lower case."""
    clean = F.trim(F.regexp_replace(F.coalesce(url, F.lit("")), r"\s+", " "))
    return F.lower(_with({"u": clean}, lambda v: _rebuilt(v["u"], SOURCE_URL_PARAMS, False)))


def source_key(url: Column) -> Column:
    """As source_url, with more parameters dropped, blank ones too, and case kept: a notice's key."""
    return F.when(F.coalesce(url, F.lit("")) != "", _rebuilt(F.trim(url), SOURCE_KEY_PARAMS, True))


def image_identity(url: Column) -> Column:
    """An image's address without fragment and size parameters, in lower case."""
    return F.lower(_rebuilt(F.trim(F.coalesce(url, F.lit(""))), IMAGE_PARAMS, False))


def is_application_link(url: Column, label: Column) -> Column:
    """Whether a link leads to an application form, by its host, path or label."""
    def judged(v: Column) -> Column:
        by_label = v["name"].rlike(f"(?i){APPLICATION_LABELS}")
        never = v["at"].rlike(r"^(pf|open)\.kakao\.com$") | (v["at"].rlike(r"(^|\.)google\.com$") & v["path"].rlike(r"(?i)^/forms/about/?$|/abuse/?$"))
        found = by_label | v["at"].rlike(APPLICATION_HOSTS) | ((v["at"] == "docs.google.com") & v["path"].rlike(r"(?i)^/forms(/|$)")) | F.concat(v["path"], v["query"]).rlike(f"(?i){APPLICATION_PATHS}")
        return F.when(v["text"] == "", False).when(v["at"] == "", by_label).otherwise(~never & found)

    def parts(v: Column) -> Column:
        t = v["text"]
        at = F.coalesce(F.regexp_extract(F.lower(t), r"^https?://([^/?#:]+)", 1), F.lit(""))
        return _with({"text": t, "name": v["name"], "at": at, "path": path(t), "query": F.regexp_extract(t, r"^[^?#]*(\?[^#]*)", 1)}, judged)

    return _with({"text": F.trim(F.coalesce(url, F.lit(""))), "name": F.coalesce(label, F.lit(""))}, parts)


def short_link(url: Column) -> Column:
    """Known short links cut down to their token; others unchanged."""
    def cut(v: Column) -> Column:
        origin = F.regexp_extract(v["url"], r"^(https?://[^/?#]+)", 1)
        token = F.regexp_extract(v["path"], r"^/([A-Za-z0-9_-]+)", 1)
        action = F.regexp_extract(v["path"], r"(?i)^/_?[A-Za-z0-9_-]+/(chat|friend)(/|$)", 1)
        channel = F.concat(origin, F.lit("/"), token, F.lit("/"), F.when(action == "", "").otherwise(F.concat(action, F.lit("/"))))
        return F.when(v["at"].isin("forms.gle", "naver.me") & (token != ""), F.concat(origin, F.lit("/"), token)).when((v["at"] == "pf.kakao.com") & (token != ""), channel).otherwise(v["url"])

    return _with({"url": url}, lambda v: _with({"url": v["url"], "at": host(v["url"]), "path": path(v["url"])}, cut))


def link_type(declared: Column, url: Column, label: Column) -> Column:
    return F.when(is_application_link(url, label), "official_apply").otherwise(F.coalesce(F.nullif(declared, F.lit("")), F.lit("other")))


# Words for application links, and texts in their place that are no address.
APPLICATION_LABEL = r"(?i)신청|접수|지원|응모|등록|apply|application"
NO_ADDRESS = r"(?i)^(?:https?:/{1,2}|www\.?|#|-|없음|해당없음|미정|준비중)$"


def bad_application(link: Column, source: Column) -> Column:
    """Whether a link (url, label, type) for applications is missing, malformed, a placeholder, or leads to the
    homepage of the notice's own source. Other links are never bad."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    url, home = F.trim(blank(link["url"])), blank(host(source))
    applies = (blank(link["type"]) == "official_apply") | blank(link["label"]).rlike(APPLICATION_LABEL)
    no_link = (url == "") | url.rlike(NO_ADDRESS) | url.rlike("(?i)^javascript:")
    whole = F.when(url.startswith("//"), F.concat(F.lit("https:"), url)).otherwise(url)
    web, site = whole.rlike("(?i)^https?://"), F.regexp_extract(whole, r"(?i)^https?://([^/?#:]*)", 1)
    rest = F.regexp_replace(F.regexp_replace(whole, r"(?i)^https?://[^/?#]*|#.*$", ""), "[/?&=_-]", "")
    nowhere = web & (~F.contains(site, F.lit(".")) | (F.lower(site) == "localhost"))
    at_home = web & (home != "") & (F.regexp_replace(F.lower(site), r"^www\.", "") == home) & (F.length(rest) < 4)
    unresolved = ~web & ~whole.rlike("(?i)^(mailto|tel):") & ~whole.rlike("(?i)^[a-z][a-z0-9+.-]*:") & (home == "")
    return applies & (no_link | nowhere | at_home | unresolved)
