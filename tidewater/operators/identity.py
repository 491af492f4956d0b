"""Names and identifiers: match scores and reconciliation."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import cusip_class, cusip_equivalent

#: A name match below this is not trusted.
LEAST_SCORE = 84.0


def token_score(a: Column, b: Column, stop: tuple[str, ...] = ()) -> Column:
    """Of two normalised names: 100 if equal, 95 if all of a's words are in b, else 80 and up to 15 by the share of a's words in b, 0 without any."""
    words = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda x: (x != "") & ~x.isin(*stop) if stop else x != ""))
    wa, wb = words(a), words(b)
    both = F.size(F.array_intersect(wa, wb))
    return (
        F.when((a == "") | (b == "") | a.isNull() | b.isNull(), 0.0)
        .when(a == b, 100.0)
        .when((F.size(wa) > 0) & (both == F.size(wa)), 95.0)
        .when(both > 0, 80.0 + 15.0 * both / F.greatest(F.lit(1), F.size(wa)))
        .otherwise(0.0)
    )


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching blocks of two strings, 0 to 100. No built-in function has this measure."""
    return pd.Series([100.0 * difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def name_score(a: Column, b: Column) -> Column:
    return F.greatest(token_score(a, b), F.when((a != "") & (b != ""), sequence_ratio(a, b)).otherwise(0.0))


def reconciled(raw: Column, resolved: Column, score: Column) -> Column:
    """struct(final, source, decision, review): gaps are filled from a trusted match, a valid value stays, a damaged one is mended if it is the same
    issue, and true conflicts are for review."""
    kind, trusted = cusip_class(raw), (resolved != "") & (score >= LEAST_SCORE)
    same = trusted & cusip_equivalent(raw, resolved)
    made = lambda value, source, decision, review: F.struct(value.alias("final"), F.lit(source).alias("source"), F.lit(decision).alias("decision"), F.lit(review).alias("review"))
    gap = kind.isin("missing", "malformed")
    return (
        F.when(gap & trusted, made(resolved, "crsp", "backfilled", False))
        .when(gap, made(F.lit(""), "", "still_missing", True))
        .when((kind == "short_suspect") & same, made(resolved, "crsp", "format_fixed", False))
        .when((kind == "short_suspect") & trusted, made(resolved, "crsp", "short_replaced", False))
        .when(kind == "short_suspect", made(raw, "bbg", "kept_bbg_short", True))
        .when(~trusted, made(raw, "bbg", "kept_bbg_uncovered", False))
        .when(same, made(raw, "bbg", "confirmed", False))
        .otherwise(made(raw, "bbg", "conflict_review", True))
    )
