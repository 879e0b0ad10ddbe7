"""Secret scan: rule matches, and candidate strings whose sliding-window entropy is high.

A candidate is a maximal run of the characters that keys are made of. Within each of its segments of
one character class a window moves by one character at a time; the counts of the window's characters
are kept up incrementally, and so is the sum of c*log2(c) from which the Shannon entropy follows. A
candidate with a window above its class's threshold is reported, unless the allow-list names it. Sample
words are left out part by part, runs like 0123456789 wherever they stand, and of slugs each part is looked at
alone. Keys of lower-case letters alone, without a digit, can't be told from words and are not found.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cover, map_columns

#: The base kinds, in the order that breaks ties of start; the entropy kinds come after them.
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64", "entropy_alnum", "entropy_lower")

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")

_HEX = frozenset("0123456789abcdefABCDEF")
_BASE64 = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")
_LOWER = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")

#: Each character class and width: its members, the window's width, the least bits a character in some
#: window, and the least changes between lower case, upper case, digits and signs in that window, which
#: tell short keys from words with a number.
CLASSES = (
    ("entropy_hex", _HEX, 24, 3.2, 0),
    ("entropy_alnum", frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 16, 3.4, 0),
    ("entropy_base64", _BASE64, 24, 4.1, 0),
    ("entropy_lower", _LOWER, 24, 3.6, 4),
    ("entropy_hex", _HEX, 16, 2.9, 3),
    ("entropy_lower", _LOWER, 16, 3.25, 3),
    ("entropy_base64", _BASE64 - frozenset("+/_=-"), 16, 3.5, 6),
)

#: Candidates that are no secrets: words and identifiers without a digit, of one case or cased as words
#: are, numbers, UUIDs and keys marked as examples at their end. Each takes time in proportion to a candidate's length.
ALLOW = tuple(map(re.compile, (
    r"([a-z_/+=-]*|[A-Z_/+=-]*)$",
    r"(?:[A-Z]?[a-z]{2,}+|[A-Z]{3,}+|[_/+=-])*+$",  # possessive: a run is taken whole or not at all
    r"[0-9_/+=-]+$",
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r".*EXAMPLE(KEY)?$",
)))
#: Parts of a candidate that are left out: documentation samples.
SAMPLE = re.compile(r"(?i)example|sample|placeholder|dummy|changeme|testkey")
#: Candidates that are looked at part by part: words and numbers joined by signs.
SLUG = re.compile(r"[a-z]+([_/-][a-z0-9]+)+$")
PART = re.compile(r"[A-Za-z0-9]+")
#: What an address begins with, left out; and the least length of runs of ascending characters that are.
SCHEME, RUN = re.compile(r"(?i)(https?|www|ftp)\b"), 6

_LOG = [0.0, 0.0, *(c * math.log2(c) for c in range(2, 256))]


def window_entropies(text: str, width: int) -> Iterator[float]:
    """The Shannon entropy, in bits a character, of each window of width characters of text."""
    if width < 1 or len(text) < width:
        return
    plogp = _LOG if width < len(_LOG) else [0.0, 0.0, *(c * math.log2(c) for c in range(2, width + 1))]
    counts: dict[str, int] = {}
    total = 0.0  # of c*log2(c) over the counts
    for i, char in enumerate(text):
        c = counts.get(char, 0)
        counts[char] = c + 1
        total += plogp[c + 1] - plogp[c]
        if i >= width:
            old = text[i - width]
            c = counts[old]
            counts[old] = c - 1
            total += plogp[c - 1] - plogp[c]
        if i >= width - 1:
            yield math.log2(width) - total / width


def _segments(text: str, members: frozenset) -> Iterator[str]:
    start = None
    for i, char in enumerate(text):
        if char in members:
            start = i if start is None else start
        elif start is not None:
            yield text[start:i]
            start = None
    if start is not None:
        yield text[start:]


def _runs(text: str) -> Iterator[tuple[int, int]]:
    """Where at least RUN characters each follow the one before them in the alphabet or among the digits."""
    start = 0
    for i in range(1, len(text) + 1):
        if i == len(text) or ord(text[i]) != ord(text[i - 1]) + 1:
            if i - start >= RUN:
                yield start, i
            start = i


def _stretches(candidate: str) -> Iterator[str]:
    """What of a candidate is looked at: what is between runs, sample words and an address's scheme; of a slug each part."""
    slug = SLUG.match(candidate)
    cuts = [m.span() for m in PART.finditer(candidate) if SAMPLE.search(m[0])] + list(_runs(candidate))
    if scheme := SCHEME.match(candidate):
        cuts.append(scheme.span())
    start = 0
    for cut, end in sorted(cuts) + [(len(candidate), len(candidate))]:
        if cut > start:
            yield from PART.findall(candidate[start:cut]) if slug else [candidate[start:cut]]
        start = max(start, end)


def _changes(window: str) -> int:
    kinds = [c.isdigit() + 2 * c.islower() + 4 * c.isupper() for c in window]
    return sum(a != b for a, b in zip(kinds, kinds[1:]))


def entropy_kind(candidate: str, allow: Iterable[re.Pattern] = ALLOW) -> str | None:
    """The first class, in the order of CLASSES, with a window at or above its thresholds; None for none,
    and for what the allow-list matches from its first character on."""
    allow = tuple(allow)
    if any(rule.match(candidate) for rule in allow):
        return None
    kept = [s for s in _stretches(candidate) if s == candidate or s and not any(rule.match(s) for rule in allow)]
    for kind, members, width, least, changes in CLASSES:
        for stretch in kept:
            for segment in _segments(stretch, members):
                for i, bits in enumerate(window_entropies(segment, width)):
                    if bits >= least and (not changes or _changes(segment[i:i + width]) >= changes):
                        return kind
    return None


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the rule matches, by start, then kind as listed; code points, end exclusive."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def all_spans(text: str, allow: Iterable[re.Pattern] = ALLOW) -> tuple[list, list]:
    """The base spans, and these with the entropy spans that no base span overlaps."""
    base, more = base_spans(text), []
    cover = Cover(base)
    for m in CANDIDATE.finditer(text):
        if not cover.meets(m.start(), m.end()) and (kind := entropy_kind(m[0], allow)):
            more.append((m.start(), m.end(), kind))
    return base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2])))


def scan_secrets(docs: DataFrame, allow: Iterable[str] = ()) -> DataFrame:
    """Secrets of each row of docs (doc_id, text): (doc_id, spans array<struct<kind, start, end, base>>).

    allow: further allow-list patterns, matched from a candidate's first character on; they suppress
    entropy spans only. Null and empty texts have no spans, repeated rows give repeated rows, an empty
    table gives none, other columns are not read. Work and memory follow the length of a text.
    """
    rules = (*ALLOW, *map(re.compile, allow))

    def make():
        def run(ids: list, texts: list) -> tuple:
            out = []
            for text in texts:
                base, spans = all_spans(text, rules)
                known = set(base)
                out.append([{"kind": k, "start": s, "end": e, "base": (s, e, k) in known} for s, e, k in spans])
            return ids, out

        return run

    return map_columns(docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")), "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>", make)


def span_digest(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """The contract's columns from spans: counts of the base kinds, digest of the base spans, all spans."""
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, kinds), F.sha2(text(F.filter("spans", lambda s: s["base"])).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
