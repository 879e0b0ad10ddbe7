"""Patterns over long texts, each guarded by words that any match must hold: searching for a word costs a small part of
trying a pattern at every place."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_P = re._parser


def _needed(parts: Iterable) -> tuple[str, ...] | None:
    """Words of which a match of these parts holds one, in lower case; None where there are none for sure."""
    found, run = [], ""
    for kind, value in [*parts, (None, None)]:
        if kind is _P.LITERAL:
            run += chr(value).lower()
            continue
        if run:
            found.append((run,))
        run = ""
        if kind is _P.BRANCH:
            each = [_needed(b) for b in value[1]]
            found.append(None if None in each else tuple(sorted({w for words in each for w in words})))
        elif kind is _P.SUBPATTERN:
            found.append(_needed(value[-1]))
        elif kind in (_P.MAX_REPEAT, _P.MIN_REPEAT) and value[0] > 0:
            found.append(_needed(value[2]))
        elif kind is _P.IN and all(k is _P.LITERAL for k, _ in value):
            found.append(tuple(sorted({chr(c).lower() for _, c in value})))
    found = [words for words in found if words]
    found = [tuple(w for w in words if not any(v != w and v in w for v in words)) for words in found]
    # short words are found anywhere: rather several longer ones, or rarer ones
    return min(found, key=lambda words: (-min(2, min(map(len, words))), len(words), -min(len(w.encode()) for w in words))) if found else None


@lru_cache(maxsize=None)
def anchors(pattern: str) -> tuple[str, ...] | None:
    """Lower-case words of which every match of the pattern, in any case, holds at least one."""
    return _needed(_P.parse(pattern))


def holds_anchor(lowered: Column, pattern: str) -> Column:
    """Whether a text in lower case may match a pattern that has anchors."""
    return reduce(Column.__or__, [F.contains(lowered, F.lit(w)) for w in anchors(pattern)])


def found(text: Column, lowered: Column, *patterns: str, cased: bool = False) -> Column:
    """Whether one of the patterns is in the text, by default in any case of A-Z; lowered is the text in lower case. A pattern is
    tried only on texts that hold one of its anchors."""
    def one(pattern: str) -> Column:
        hit = text.rlike(pattern if cased else "(?i)" + pattern)
        return hit if anchors(pattern) is None else F.when(holds_anchor(lowered, pattern), hit).otherwise(False)

    return reduce(Column.__or__, map(one, patterns))
