"""Personal data by weak supervision.

Patterns propose candidate spans, and labelers vote on each: its format, gazetteers and the words around
it. Over the counts of all candidates' votes, expectation-maximisation estimates how reliable each
labeler is for each kind; the posteriors of its label model then train the final span classifier, a
logistic model over votes, kind, length, the span's shape and what stands before it. Matches of the base patterns are always reported;
the classifier decides on the further ones.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cover, map_columns, written

BASE = ("email", "ip", "card", "phone")
MORE = ("written_email", "local_phone", "iban", "ssn", "name")
KINDS = BASE + MORE
LABELERS = ("format", "gazetteer", "context", "decoy")
#: Characters on either side of a span that the context labeler reads.
AROUND = 40
#: A candidate of a further kind is reported at this probability.
LEAST = 0.5
STEPS = 50
#: Candidates of each kind weigh as so many in all, whatever their number: ten copies of a corpus
#: give the models of one.
MASS = 1000.0
#: Classes that spans' shapes are hashed to.
SHAPES = 16

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

_WRITTEN = re.compile(r"(?<![\w.])[A-Za-z0-9][A-Za-z0-9_-]{1,40}\x20?[\[(]?\x20?(?:at|AT)\x20?[\])]?\x20?[A-Za-z0-9-]{2,40}\x20?[\[(]?\x20?(?:dot|DOT)\x20?[\])]?\x20?[A-Za-z]{2,6}\b")
_LOCAL_PHONE = re.compile(r"(?<![\w+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![\w-])")
_SSN = re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?!\w)")
_NAME = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora)\.?\x20[A-Z][\w'-]+(?:\x20[A-Z][\w'-]+)?|\b(?:[Mm]y name is|[Nn]amed|[Cc]alled)\x20[A-Z][\w'-]+(?:\x20[A-Z][\w'-]+)?")

#: Gazetteers and cue words.
TLDS = frozenset(
    "com org net edu gov mil int io co info biz name pro dev app ai me tv de fr es uk us eu kr jp cn tw hk sg in it nl pl ru ua br ar cl mx ch at be lu dk se no fi is ie pt gr cz sk hu ro bg hr si ee lv lt tr il ae sa za eg ng ke ca au nz id my th vn ph".split()
)
IBAN_LENGTH = dict(DE=22, FR=27, ES=24, GB=22, IT=27, NL=18, BE=16, AT=20, CH=21, PL=28, PT=25, IE=22, SE=24, DK=18, FI=18, NO=15)
GIVEN = frozenset(
    "james john robert michael william david richard joseph thomas charles christopher matthew anthony steven andrew kenneth kevin brian george edward ronald timothy jason jeffrey ryan jacob gary eric stephen jonathan larry justin scott brandon benjamin samuel "
    "mary patricia jennifer linda elizabeth barbara susan jessica sarah karen nancy lisa margaret sandra ashley kimberly emily donna michelle carol amanda melissa deborah stephanie rebecca laura helen amy angela emma olivia sophia jane alice "
    "hans peter klaus jürgen wolfgang stefan andreas markus uwe dieter karl anna maria ursula monika petra sabine gisela claudia heike jean marie françois pierre michel philippe alain nicolas isabelle nathalie sylvie camille "
    "juan josé carlos luis antonio manuel francisco miguel javier carmen ana isabel pilar lucía elena rosa daniel paul mark noah liam lucas sofia mia leon max min-jun ji-woo seo-yeon hiroshi yuki wei li".split()
)
CUES = {
    "email": "mail contact write reach address kontakt courriel correo", "ip": "ip host server address login", "card": "card visa mastercard credit payment karte carte tarjeta",
    "phone": "phone call tel mobile fax contact telefon téléphone teléfono", "written_email": "mail contact write reach kontakt courriel correo", "local_phone": "phone call tel mobile fax contact",
    "iban": "iban bank account konto compte cuenta", "ssn": "ssn social security", "name": "name signed contact regards dear",
}
DECOYS = re.compile(r"(?i)\b(?:version|v|isbn|issn|order|invoice|ticket|part|model|serial|section|chapter|figure|license|licence)\W{0,3}$")
_CUE = {kind: re.compile(r"(?i)\b(?:" + "|".join(words.split()) + ")") for kind, words in CUES.items()}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = 2 * n - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int, str]]:
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end(), "email"
            last = m.end()
        at = text.find("@", max(at + 1, last))


def _part(digits: str) -> bool:
    return len(short := digits.lstrip("0")) <= 3 and int(short or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base matches, by start, then kind as listed; code points, end exclusive."""
    found = list(_emails(text))
    if _DIGIT.search(text):
        found += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(map(_part, m[0].split(".")))]
        for m in _CARD.finditer(text):
            if 14 <= len(m[0]) <= 37 and 14 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), "card"))
        found += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def _proposals(text: str) -> Iterator[tuple[int, int, str]]:
    patterns = [("written_email", _WRITTEN)] if " dot " in text or "dot" in text.lower() and (" at" in text or "[at" in text or "(at" in text) else []
    if _DIGIT.search(text):
        patterns += [("local_phone", _LOCAL_PHONE), ("ssn", _SSN), ("iban", _IBAN)]
    for kind, pattern in (*patterns, ("name", _NAME)):
        for m in pattern.finditer(text):
            yield m.start(), m.end(), kind


def _iban_ok(span: str) -> bool:
    code = span.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def votes(text: str, start: int, end: int, kind: str) -> tuple[int, ...]:
    """The labelers' votes on a span: 1 for personal data, -1 against, 0 for none."""
    span, left = text[start:end], text[max(0, start - AROUND):start]
    digits = [c for c in span if "0" <= c <= "9"]
    if kind in ("email", "written_email"):
        form = 1 if kind == "email" and ".." not in span and not span.startswith(".") else 0
        known = 1 if re.split(r"[^A-Za-z0-9]+", span)[-1].lower() in TLDS else -1
    elif kind == "ip":
        form, known = 1, -1 if span.startswith(("0.", "127.", "255.")) else 0
    elif kind == "iban":
        form, known = 1 if _iban_ok(span) else -1, 1 if IBAN_LENGTH.get(span[:2]) == len(span.replace(" ", "")) else -1
    elif kind == "ssn":
        form, known = -1 if span[:3] in ("000", "666") or span[0] == "9" or span[4:6] == "00" or span[7:] == "0000" else 1, 0
    elif kind == "name":
        form, known = 1 if span.count(" ") > 1 else 0, 1 if any(w.lower() in GIVEN for w in span.split()) else 0
    else:
        form, known = 1, 1 if kind == "card" and span[0] in "3456" or kind == "phone" and span[1] in "123456789" else 0
    near = 1 if _CUE[kind].search(left) or _CUE[kind].search(text[end:end + AROUND]) else 0
    decoy = -1 if DECOYS.search(left) or digits and len(set(digits)) <= 2 and len(digits) > 6 else 0
    return form, known, near, decoy


def shape(span: str) -> int:
    """A class of the span's shape: its runs of digits, capitals, other letters and signs, without their lengths."""
    runs = re.sub(r"[a-z]+", "a", re.sub(r"[0-9]+", "0", re.sub(r"[A-Z]+", "A", span)))
    return zlib.crc32(runs[:24].encode()) % SHAPES


def lead(text: str, start: int) -> int:
    """What stands before a span: 0 nothing or a line break, 1 a colon or equals sign and blanks, 2 a bracket or
    quotation mark, 3 anything else."""
    left = text[max(0, start - 3):start]
    bare = left.rstrip(" ")
    return 0 if not bare and start <= len(left) or bare.endswith("\n") else 1 if bare[-1:] in ":=" else 2 if left[-1:] in "([<\"'" else 3


def candidates(text: str) -> list[dict]:
    """The base spans and the proposals that overlap none of them, with votes and features."""
    base = base_spans(text)
    spans = [(*s, True) for s in base]
    cover = Cover(base)
    for s, e, kind in sorted(_proposals(text)):
        if not cover.meets(s, e):
            spans.append((s, e, kind, False))
    spans.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    size = lambda s, e: min(3, (e - s).bit_length() // 2)
    return [{"kind": k, "start": s, "end": e, "base": b, "votes": list(votes(text, s, e, k)), "features": [size(s, e), shape(text[s:e]), lead(text, s)]} for s, e, k, b in spans]


@dataclass
class LabelModel:
    """prior: kind -> share that is personal data; table: (kind, labeler, truth, vote) -> probability."""

    prior: dict[str, float]
    table: dict[tuple[str, int, int, int], float]

    def posterior(self, kind: str, vote: tuple[int, ...]) -> float:
        odds = [1 - self.prior.get(kind, 0.5), self.prior.get(kind, 0.5)]
        for truth in (0, 1):
            for j, v in enumerate(vote):
                odds[truth] *= self.table.get((kind, j, truth, v), 1 / 3)
        return odds[1] / (sum(odds) or 1.0)


def _shares(counts: dict[tuple, int]) -> dict[tuple, float]:
    """The counts, by kind, scaled to MASS in all."""
    total: dict[str, int] = {}
    for (kind, *_), n in counts.items():
        total[kind] = total.get(kind, 0) + n
    return {key: n * MASS / total[key[0]] for key, n in counts.items()}


def estimate(counts: dict[tuple[str, tuple[int, ...]], int]) -> LabelModel:
    """Expectation-maximisation over the counts of (kind, votes), as shares. It starts from labelers that are right
    seven times in ten, which also serve as a weak prior, and takes votes as independent given the truth."""
    start = {(v, t): 0.5 if v == 0 else 0.35 if (v > 0) == bool(t) else 0.15 for v in (-1, 0, 1) for t in (0, 1)}
    kinds = {k for k, _ in counts}
    counts = _shares(counts)
    model = LabelModel({k: 0.5 for k in kinds}, {(k, j, t, v): p for k in kinds for j in range(len(LABELERS)) for (v, t), p in start.items()})
    for _ in range(STEPS):
        mass: dict = {}
        total = {k: [1.0, 1.0] for k in kinds}
        for (kind, vote), n in counts.items():
            p = model.posterior(kind, vote)
            for truth, share in ((1, p * n), (0, (1 - p) * n)):
                total[kind][truth] += share
                for j, v in enumerate(vote):
                    mass[kind, j, truth, v] = mass.get((kind, j, truth, v), 0.0) + share
        model.prior = {k: t[1] / sum(t) for k, t in total.items()}
        model.table = {(k, j, t, v): (mass.get((k, j, t, v), 0.0) + 10 * start[v, t]) / (total[k][t] - 1 + 10) for k, j, t, v in model.table}
    return model


def _row(kind: str, vote: tuple[int, ...], features: tuple[int, ...]) -> np.ndarray:
    size, form, left = features
    ones = [1.0, *(kind == k for k in KINDS), *(v == s for v in vote for s in (-1, 1)), *(size == s for s in range(4)), *(form == s for s in range(SHAPES)), *(left == s for s in range(4))]
    return np.array(ones, float)


@dataclass
class SpanClassifier:
    weights: np.ndarray

    def probability(self, kind: str, vote: tuple[int, ...], features: tuple[int, ...]) -> float:
        return float(1 / (1 + np.exp(-np.clip(_row(kind, vote, features) @ self.weights, -30, 30))))


def train_classifier(counts: dict[tuple[str, tuple[int, ...], tuple[int, ...]], int], model: LabelModel) -> SpanClassifier:
    """Logistic regression on the label model's posteriors, each kind's patterns weighted by their shares."""
    keys = sorted(counts)
    if not keys:
        return SpanClassifier(np.zeros(len(_row("email", (0,) * len(LABELERS), (0, 0, 0)))))
    shares = _shares(counts)
    x = np.stack([_row(*k) for k in keys])
    y = np.array([model.posterior(k, v) for k, v, _ in keys])
    n = np.array([shares[k] for k in keys])
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (n * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(w))
        w = w - np.clip(np.linalg.solve(hessian, x.T @ (n * (p - y)) + 0.5 * w), -3, 3)
    return SpanClassifier(w)


_SPAN = "kind:string,start:long,end:long,base:boolean"


def find_personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end, base>>) for each row of docs (doc_id, text).

    Candidates are found once and kept, without texts, in the shared folder; the counts of their votes and
    features, whose combinations don't grow with the corpus, train the models. Null and empty texts have no
    spans; long texts are read whole; equal rows give equal rows; an empty table gives none; other
    columns are not read.
    """
    def make():
        return lambda ids, texts: (ids, [candidates(t) for t in texts])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    found = written(map_columns(rows, f"doc_id long, spans array<struct<{_SPAN},votes:array<int>,features:array<int>>>", make), "candidates")
    seen = found.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes", "s.features").count().collect()
    counts = {(r["kind"], tuple(r["votes"]), tuple(r["features"])): r["count"] for r in seen}
    by_votes: dict = {}
    for (kind, vote, _), n in counts.items():
        by_votes[kind, vote] = by_votes.get((kind, vote), 0) + n
    classifier = train_classifier(counts, estimate(by_votes))
    good = {key for key in counts if classifier.probability(*key) >= LEAST}

    def decide():
        keep = lambda s: s["base"] or (s["kind"], tuple(s["votes"]), tuple(s["features"])) in good
        return lambda ids, lists: (ids, [[{k: s[k] for k in ("kind", "start", "end", "base")} for s in x if keep(s)] for x in lists])

    return map_columns(found, f"doc_id long, spans array<struct<{_SPAN}>>", decide)
