"""Numbers, shares, money, ratios and dates out of prose, as column expressions; null where there is none."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean, contains_any

NUMBER = r"-?[0-9]+(?:\.[0-9]+)?"
#: Words that say one half.
HALF_WORDS = ("one-half", "one half", "half of", "fifty percent")
DATE_FORMATS = (
    (r"\b([0-9]{4}-[0-9]{1,2}-[0-9]{1,2})\b", "yyyy-M-d"),
    (r"\b([0-9]{1,2}/[0-9]{1,2}/[0-9]{4})\b", "M/d/yyyy"),
    (r"\b((?:January|February|March|April|May|June|July|August|September|October|November|December) [0-9]{1,2}, [0-9]{4})\b", "MMMM d, yyyy"),
)


def _plain(c: Column) -> Column:
    return F.replace(clean(c), F.lit(","), F.lit(""))


def as_double(c: Column) -> Column:
    """A finite number or null."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def extracted(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(c, pattern, group).try_cast("double")


def first_number(c: Column) -> Column:
    return extracted(_plain(c), f"({NUMBER})")


def bounded_number(c: Column, low: float, high: float) -> Column:
    """The first number from low to high; share counts before it are passed over."""
    found = F.regexp_extract_all(F.replace(c, F.lit(","), F.lit("")), F.lit(r"([0-9]+\.?[0-9]*)"), 1)
    return F.get(F.filter(F.transform(found, lambda x: x.try_cast("double")), lambda x: (x >= low) & (x <= high)), F.lit(0))


def clamp(x: Column) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def bounded_share(x: Column) -> Column:
    """Clamped to 0-1; above 1 and up to 100 is read as a percentage."""
    return clamp(F.when((x > 1) & (x <= 100), x / 100).otherwise(x))


def percent_fraction(c: Column) -> Column:
    """A percentage of 1 to 99 as a fraction."""
    v = extracted(c, r"([0-9]{1,3}(?:\.[0-9]+)?)\s*%")
    return F.when((v >= 1) & (v <= 99), v / 100)


def percent(c: Column) -> Column:
    """0 to 100: the number before a % sign, else a bare fraction; never a share count."""
    t = F.replace(c, F.lit(","), F.lit(""))
    share = extracted(t, r"(?:^|[^0-9.])(0?\.[0-9]+)(?![0-9%])")
    v = F.coalesce(extracted(t, r"([0-9]+\.?[0-9]*)\s*%"), F.when((share >= 0) & (share <= 1), share * 100))
    return F.when((v >= 0) & (v <= 100), v)


def fraction(c: Column) -> Column:
    """Tried in turn: n %, a/b, 0.x, n percent, words for one half."""
    t = F.lower(_plain(c))
    over = extracted(t, r"\b([0-9]+(?:\.[0-9]+)?)\s*/\s*([0-9]+(?:\.[0-9]+)?)\b", 2)
    whole = extracted(t, f"({NUMBER})")
    return F.coalesce(
        extracted(t, r"([0-9]+(?:\.[0-9]+)?)\s*%") / 100,
        extracted(t, r"\b([0-9]+(?:\.[0-9]+)?)\s*/\s*([0-9]+(?:\.[0-9]+)?)\b", 1) / F.nullif(over, F.lit(0.0)),
        extracted(t, r"\b(0\.[0-9]+)\b"),
        F.when((whole > 1) & (whole <= 100) & contains_any(t, ("percent", "pct")), whole / 100),
        F.when(contains_any(t, HALF_WORDS), F.lit(0.5)),
    )


def share(c: Column, denominator: Column | None = None) -> Column:
    """n % as a share; up to 1 as it is; n percent; a count over the denominator; else up to 100 as a percentage."""
    t, x = F.lower(clean(c)), first_number(c)
    out = F.when(F.contains(t, F.lit("%")), bounded_share(x / 100)).when((x >= 0) & (x <= 1), x).when((x > 1) & (x <= 100) & contains_any(t, ("percent", "pct", "share")), x / 100)
    if denominator is not None:
        out = out.when(denominator > 0, bounded_share(x / denominator))
    return out.when((x > 1) & (x <= 100), x / 100)


def money(c: Column) -> Column:
    t = _plain(c)
    return F.coalesce(extracted(t, r"\$\s*([0-9]+(?:\.[0-9]+)?)"), extracted(t, r"(?i)\b([0-9]+(?:\.[0-9]+)?)\s*(?:dollars?|usd)\b"))


def exchange_ratio(c: Column) -> Column:
    t = F.lower(_plain(c))
    return F.coalesce(
        extracted(t, r"exchange ratio (?:of )?([0-9]+(?:\.[0-9]+)?)"),
        extracted(t, r"([0-9]+(?:\.[0-9]+)?)\s*(?:share|shares)\s+of"),
        extracted(t, r"\b([0-9]+(?:\.[0-9]+)?)\s*:\s*1\b"),
        extracted(t, r"\b([0-9]+(?:\.[0-9]+)?)\b"),
    )


def date_in(c: Column) -> Column:
    """The first date of the first form that a text holds."""
    return F.coalesce(*[F.try_to_date(F.nullif(F.regexp_extract(c, p, 1), F.lit("")), f) for p, f in DATE_FORMATS])


def elapsed_days(start: Column, end: Column, fallback: int) -> Column:
    return F.greatest(F.lit(1), F.coalesce(F.datediff(end, start), F.lit(fallback)))


def quarter_before(d: Column, lag: int) -> tuple[Column, Column]:
    back = F.add_months(F.trunc(d, "quarter"), -3 * lag)
    return F.year(back), F.quarter(back)


def signed_log(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x worked out one time for each row however often f names it."""
    return F.transform(F.array(x), f)[0]


def proration_factor(c: Column, option: str) -> Column:
    """The share of an option's elections that is filled, out of prose: the first percentage, else decimal below 1, in a window around a mention of the
    option that speaks of proration or elections; the whole text where it is mentioned but no window does."""
    width, none = len(option), F.array().cast("array<string>")

    def windows(t: Column, parts: Column) -> Column:
        starts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.length(F.array_join(F.slice(parts, F.lit(1), i), option)))
        cut = F.transform(F.slice(starts, F.lit(1), F.size(parts) - 1), lambda s: F.substr(t, F.greatest(F.lit(0), s - 120) + 1, s + width + 180 - F.greatest(F.lit(0), s - 120)))
        near = F.filter(cut, lambda w: F.contains(w, F.lit("prorat")) | F.contains(w, F.lit("election")))
        return once(near, lambda n: F.when(F.size(n) > 0, n).otherwise(F.array(t)))

    def first(found: Column) -> Column:
        return once(F.get(F.filter(found, lambda x: x.isNotNull()), F.lit(0)), bounded_share)

    read = lambda w: F.coalesce(extracted(w, r"([0-9]+(?:\.[0-9]+)?)\s*%") / 100, extracted(w, r"\b(0\.[0-9]+)\b"))
    in_windows = lambda t: F.when(F.contains(t, F.lit(option)), once(F.split(t, option), lambda parts: windows(t, parts))).otherwise(none)
    return F.when(c.isNotNull(), first(F.transform(once(F.lower(clean(c)), in_windows), read)))


def cap_fraction(c: Column, shares_out: Column) -> Column:
    """A cap as a share: what fraction() reads, else a number of more than 100 shares over those outstanding."""
    n = first_number(c)
    return F.coalesce(fraction(c), F.when((shares_out > 0) & (n > 100), bounded_share(n / shares_out)))


def date_window(d: Column, before: int, after: int) -> tuple[Column, Column]:
    return F.date_sub(d, before), F.date_add(d, after)


def display_money(x: Column) -> Column:
    return F.coalesce(F.when(~F.isnan(x), F.concat(F.lit("$"), F.format_number(x, 0))), F.lit("n/a"))


def display_percent(x: Column) -> Column:
    return F.coalesce(F.when(~F.isnan(x), F.concat(F.replace(F.format_number(x, 2), F.lit(","), F.lit("")), F.lit("%"))), F.lit("n/a"))


def number_or_null(columns: Sequence[str], name: str, missing: float | None = None) -> Column:
    """A column as numbers, or null (or a value) throughout where a table does not have it."""
    fill = F.lit(missing).cast("double")
    return F.coalesce(F.col(name).try_cast("double"), fill) if name in columns else fill


def hundredths(share: Column) -> Column:
    """A share of 0 to 1 as C prints it with two digits: by the exact value of the double, halves to even. Java's format rounds the shortest decimal that stands for it,
    halves up."""
    middles = [(2 * k + 1) / 200 for k in range(100)]
    # the least double that goes up from each hundredth
    least = [m if float(f"{m:.2f}") > m else math.nextafter(m, 1) for m in middles]
    down = F.greatest(F.lit(0), F.least(F.lit(99), F.floor(share * 100).cast("int")))
    whole = down + (share >= F.element_at(F.array(*[F.lit(x) for x in least]), down + 1)).cast("int")
    return F.format_string("%d.%02d", F.floor(whole / 100).cast("int"), whole % 100)
