"""Scores, snippets and proximity of keywords in filing texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = " ||| "


def occurrences(text: Column, word: str) -> Column:
    """Non-overlapping occurrences of a plain string."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word)).cast("int")


def keyword_score(text: Column, keywords: Sequence[str], core: Sequence[str], core_weight: int = 4) -> Column:
    total = F.lit(0)
    for w in keywords:
        total = total + occurrences(text, w) * (core_weight if w in core else 1)
    return total


def snippets(text: Column, keywords: Sequence[str], before: int, after: int, most: int) -> Column:
    """The surroundings of the first hit of each keyword, at most `most` of them, in the order of the keywords."""
    parts = []
    for w in keywords:
        at = F.instr(text, w)
        start = F.greatest(F.lit(1), at - before)
        parts.append(F.when(at > 0, F.trim(F.substr(text, start, at + len(w) + after - start))))
    return F.array_join(F.slice(F.array_compact(F.array(*parts)), 1, most), SEPARATOR)


def phrase_pattern(phrase: str) -> str:
    """A phrase at word boundaries, its words apart by anything that is not a letter or digit."""
    return r"\b" + "[^a-z0-9]+".join(phrase.split()) + r"\b"


def field_score(text: Column, phrases: Sequence[str], form_bonus: Column, multi: int = 4) -> Column:
    total = F.lit(0)
    for p in phrases:
        total = total + F.regexp_count(text, F.lit(phrase_pattern(p))) * (multi if " " in p else 1)
    return F.when(total > 0, total + form_bonus).otherwise(0)


def form_bonus(form: Column, preferred: Sequence[str]) -> Column:
    """12 for a preferred form, 9 for an amendment of one, 8 for an exhibit."""
    base = F.regexp_replace(F.upper(form), "/A$", "")
    return F.when(F.upper(form).isin(*preferred), 12).when(base.isin(*preferred), 9).when(F.upper(form).startswith("EX-99"), 8).otherwise(0)


def proximity_bonus(days: Column) -> Column:
    d = F.abs(days)
    return F.when(d <= 45, 25).when(d <= 120, 10).when(d <= 270, 3).otherwise(0)
