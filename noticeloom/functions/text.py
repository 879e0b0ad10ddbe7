"""Text normalisation and similarity in built-in functions; only NFKC and counts of shared entries need
Python."""

from __future__ import annotations

import unicodedata
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import types as T
from pyspark.sql import functions as F

#: Bytes of a batch, about, that are Python strings at a time.
SLICE_BYTES = 4 << 20

# Words of a notice's title that don't tell it apart, and legal forms of organisations.
GENERIC_WORDS = ("참여자", "참가자", "교육생", "수강생", "대상자", "모집", "안내", "공고", "신청", "접수", "추가", "기간", "연장")
VARIANT_WORDS = ("신규", "프로그램", "안내")
LEGAL_FORMS = "주식회사|\\(주\\)|㈜|재단법인|사단법인|사회복지법인|유한회사"
WEEKLY = "매주\\s*(?:월|화|수|목|금|토|일)요일"


def nfkc(text: Column) -> Column:
    """Compatibility composition, for which Spark has no function of its own."""
    @F.arrow_udf(T.StringType())
    def composed(values: pa.Array) -> pa.Array:
        rows = max(1, len(values) * SLICE_BYTES // max(1, values.nbytes))  # a whole batch isn't held as Python strings
        parts = [pa.array([None if v is None else unicodedata.normalize("NFKC", v) for v in values.slice(i, rows).to_pylist()], pa.large_string() if pa.types.is_large_string(values.type) else pa.string()) for i in range(0, len(values), rows)]
        return pa.concat_arrays(parts) if parts else values

    return composed(text)


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def normalized(text: Column, compatibility: bool = False) -> Column:
    """Lower case, letters and digits only, single blanks; quotes vanish, other signs become blanks."""
    base = nfkc(squeezed(text)) if compatibility else squeezed(text)
    plain = F.regexp_replace(F.lower(base), "[「」『』“”\"']", "")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"[^\p{L}\p{N}\s]", " "), r"\s+", " "))


def title_key(title: Column, org: Column, compatibility: bool = False) -> Column:
    """A title without its organisation, generic words, weekly schedules and variant words."""
    t, o = normalized(title, compatibility), normalized(org, compatibility)
    t = F.when((o != "") & F.startswith(t, o), F.trim(F.substr(t, F.length(o) + 1))).otherwise(t)
    t = F.regexp_replace(t, "|".join(GENERIC_WORDS), " ")
    t = F.regexp_replace(t, rf"\d{{1,2}}\s+\d{{1,2}}\s*월\s*{WEEKLY}|{WEEKLY}|(?:^|\s)\d{{1,2}}\s*월(?=\s|$)", " ")
    for word in VARIANT_WORDS:
        t = F.regexp_replace(t, rf"(?:^|\s){word}(?=\s|$)", " ")
    return squeezed(t)


def org_key(org: Column, compatibility: bool = False) -> Column:
    return squeezed(F.regexp_replace(F.regexp_replace(normalized(org, compatibility), r"^(?:주|주식회사)\s+", ""), rf"\s*({LEGAL_FORMS})\s*", " "))


def bigrams(text: Column) -> Column:
    """The character pairs of a text without blanks, with repeats; a single character is its own."""
    chars = F.filter(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", ""), ""), lambda c: c != "")
    pairs = lambda cs: F.when(F.size(cs) < 2, cs).otherwise(F.zip_with(F.slice(cs, 1, F.size(cs) - 1), F.slice(cs, 2, F.size(cs)), lambda a, b: F.concat(a, b)))
    return F.get(F.transform(F.array(chars), pairs), 0)


def dice(a: Column, b: Column) -> Column:
    """Dice coefficient of two arrays of strings as multisets; 0 when one is empty. In time linear in both."""
    @F.pandas_udf("int")
    def shared(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series([0 if x is None or y is None else (Counter(x) & Counter(y)).total() for x, y in zip(xs, ys)], dtype="int32")

    # without a common entry nothing is counted, nor sent
    some = F.arrays_overlap(a, b)
    common = shared(F.when(some, a), F.when(some, b))
    total = F.size(a) + F.size(b)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), 2.0 * common / F.nullif(total, F.lit(0))).otherwise(0.0)


def token_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of the words of two or more characters; 0 when one text has none."""
    words = lambda t: F.array_distinct(F.filter(F.split(t, r"\s+"), lambda w: F.length(w) >= 2))
    x, y = words(a), words(b)
    union = F.size(F.array_union(x, y))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.nullif(union, F.lit(0))).otherwise(0.0)


def similarity(a: Column, b: Column) -> Column:
    """1 for equal texts, 0 when one is blank, else the larger of pair Dice and word Jaccard."""
    blank = (F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == "")
    return F.when(blank, 0.0).when(a == b, 1.0).otherwise(F.greatest(dice(bigrams(a), bigrams(b)), token_jaccard(a, b)))


def grounding(value: Column, source: Column) -> Column:
    """The share of a value's distinct character pairs that occur in the source."""
    grams = F.array_distinct(bigrams(F.lower(value)))
    text = F.regexp_replace(F.lower(source), r"\s+", "")
    return F.when(F.size(grams) > 0, F.size(F.filter(grams, lambda g: F.contains(text, g))) / F.nullif(F.size(grams), F.lit(0))).otherwise(0.0)


def search_term(text: Column) -> Column:
    """A search term without pattern signs, single blanks, at most 80 characters."""
    return F.substring(squeezed(F.regexp_replace(F.coalesce(text, F.lit("")), r"[,%_()*]", " ")), 1, 80)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[^\p{L}\p{N}]+", "-"), r"^-+|-+$", "")


def name_id(prefix: str, name: Column) -> Column:
    """A stable id: the prefix and 16 hex digits of the digest of the trimmed lower-case name."""
    return F.concat(F.lit(prefix), F.substring(F.md5(F.lower(F.trim(name)).cast("binary")), 1, 16))


def readable(html: Column) -> Column:
    """Text of a page: scripts and styles go, block ends become line breaks, blank lines collapse."""
    t = F.regexp_replace(html, r"(?is)<(script|style|noscript|nav|footer|header)\b.*?</\1\s*>", " ")
    t = F.regexp_replace(t, r"(?i)<br\s*/?>|</(p|div|li|tr|h[1-6]|section|article)\s*>", "\n")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[ \t\r]+", " "), r"\s*\n\s*", "\n"))


def hamming(a: Column, b: Column) -> Column:
    """Different bits of two hashes of 16 hex digits; 64 for anything else."""
    good = a.rlike("^[0-9a-fA-F]{16}$") & b.rlike("^[0-9a-fA-F]{16}$")
    bits = lambda h: F.conv(h, 16, -10).cast("long")
    return F.when(good, F.bit_count(bits(a).bitwiseXOR(bits(b)))).otherwise(64)
