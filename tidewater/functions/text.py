"""Cleaning and classifying strings, as column expressions. Missing values are null or empty as each function says."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens that stand for a missing value, in four sets that differ on purpose.
MISSING_OUTCOME = ("", "nan", "none", "null", "not_found", "not applicable", "n/a")
MISSING_ADAPTER = ("", "nan", "none", "null")
MISSING_PRORATION = ("", "nan", "not_found", "not applicable")
FALSE_WORDS = ("", "0", "n", "no", "false", "f", "none", "null")
#: Words that mark an outcome, in order of precedence.
OUTCOME_WORDS = {
    "withdrawn": ("withdrawn", "withdraw", "acquirer withdrew", "offer withdrawn"),
    "terminated": ("terminated", "termination", "abandoned", "cancelled", "canceled"),
    "completed": ("completed", "complete", "closed", "closing", "consummated", "effective time"),
}
#: Patterns that name kinds of holders, in order of precedence.
HOLDER_PATTERNS = {
    "etf_or_index_fund": r"\b(etf|exchange traded|index fund|index trust|spdr|ishares|vanguard|first trust|proshares|direxion|global x|wisdomtree)\b",
    "passive_manager": r"\b(blackrock|ishares|vanguard|state street|ssga|geode|northern trust|dimensional|franklin templeton|invesco|spdr)\b",
    "hedge_or_event_driven": r"\b(elliott|third point|paulson|millennium|citadel|de shaw|two sigma|point72|cnc|glazer|magnetar|soros)\b",
}
FLOATING_RATIO = r"(?i)vwap|÷|floating|average (trading|closing|share) price|/\s*\w+\s*(10|5|20)[- ]day|collar"
LEGAL_SUFFIXES = ("inc", "incorporated", "corp", "corporation", "co", "company", "ltd", "limited", "llc", "lp", "plc", "holdings", "holding", "group", "the")


def blank() -> Column:
    return F.lit("")


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def clean(c: Column, missing: tuple[str, ...] = MISSING_OUTCOME) -> Column:
    """Trimmed text; null and missing tokens become empty."""
    t = trimmed(c)
    return F.when(c.isNull() | F.lower(t).isin(*missing), blank()).otherwise(t)


def first_filled(*columns: Column, missing: tuple[str, ...] = MISSING_OUTCOME) -> Column:
    """The first of columns with a value in this row; empty if none has."""
    return F.coalesce(*[F.nullif(clean(c, missing), blank()) for c in columns], blank())


def normal_name(c: Column) -> Column:
    """Lower case, anything but letters and digits becomes one space."""
    return F.trim(F.regexp_replace(F.lower(clean(c)), "[^a-z0-9]+", " "))


def company_name(c: Column) -> Column:
    """normal_name without what stands in parentheses and without legal suffixes; & is read as and."""
    t = F.regexp_replace(F.lower(F.coalesce(c, blank())), r"\([^)]*\)", " ")
    t = F.regexp_replace(F.replace(t, F.lit("&"), F.lit(" and ")), "[^a-z0-9 ]+", " ")
    return F.array_join(F.filter(F.split(t, r"\s+"), lambda x: (x != "") & ~x.isin(*LEGAL_SUFFIXES)), " ")


def file_name(c: Column, most: int = 90) -> Column:
    t = F.regexp_replace(F.regexp_replace(F.coalesce(c, blank()), "[^A-Za-z0-9._ -]+", "_"), r"\s+", "_")
    t = F.substring(F.regexp_replace(t, r"^[._ -]+|[._ -]+$", ""), 1, most)
    return F.when(t == "", F.lit("NA")).otherwise(t)


def contains_any(c: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(c, F.lit(w))
    return found


def outcome_label(c: Column) -> Column:
    """withdrawn before terminated before completed, by the words that a text holds; empty if none."""
    t = F.lower(clean(c))
    out = None
    for label, words in OUTCOME_WORDS.items():
        hit = contains_any(t, words)
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out.otherwise(blank())


def exact_status(c: Column) -> Column:
    t = F.lower(clean(c))
    return F.when(t.isin(*OUTCOME_WORDS), t).otherwise(blank())


def _mentions(c: Column) -> tuple[Column, Column]:
    return F.contains(c, F.lit("cash")), F.contains(c, F.lit("stock"))


def default_rule_structural(c: Column) -> Column:
    """cash or stock if only that is named, else mixed; missing is mixed."""
    cash, stock = _mentions(F.lower(clean(c)))
    return F.when(cash & ~stock, F.lit("cash")).when(stock & ~cash, F.lit("stock")).otherwise(F.lit("mixed"))


def default_rule_panel(c: Column) -> Column:
    """As the structural one, but mix and blend win and nothing named is null."""
    t = F.lower(F.coalesce(c, F.lit("nan")))
    cash, stock = _mentions(t)
    return F.when(F.contains(t, F.lit("mix")) | F.contains(t, F.lit("blend")), F.lit("mixed")).when(cash & ~stock, F.lit("cash")).when(stock & ~cash, F.lit("stock"))


def default_rule_probability(c: Column, pi_cash: Column) -> Column:
    """Probability that a holder who does not elect gets cash: 1, 0, or the pool's share."""
    t = F.lower(F.trim(F.coalesce(c, blank())))
    cash, stock = _mentions(t)
    pool = F.greatest(F.lit(0.0), F.least(F.lit(1.0), pi_cash))
    return F.when(cash & ~stock, F.lit(1.0)).when(stock & ~cash, F.lit(0.0)).otherwise(F.coalesce(F.when(pi_cash.isNotNull(), pool), F.lit(0.5)))


def ratio_type(c: Column) -> Column:
    return F.when(F.coalesce(c.rlike(FLOATING_RATIO), F.lit(False)), F.lit("floating")).otherwise(F.lit("fixed"))


def holder_category(name: Column, kind: Column | None = None) -> Column:
    t = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.concat_ws(" ", name, kind if kind is not None else blank())), "[^a-z0-9 ]+", " "), r"\s+", " "))
    out = None
    for label, pattern in HOLDER_PATTERNS.items():
        hit = t.rlike(pattern)
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out.otherwise(F.lit("active_or_other_institution"))


def truthy(c: Column) -> Column:
    return ~F.lower(clean(c, MISSING_ADAPTER)).isin(*FALSE_WORDS)


def market_suffix(c: Column) -> Column:
    """The last word of a ticker of several."""
    parts = F.split(F.upper(clean(c)), r"\s+")
    return F.when(F.size(parts) > 1, F.element_at(parts, -1)).otherwise(F.lit("__missing__"))


def present_flag(c: Column) -> Column:
    t = F.upper(F.regexp_replace(clean(c), "[^A-Za-z0-9]+", ""))
    return F.when(t.isin("", "NA", "NAN", "NONE", "NULL"), F.lit("missing")).otherwise(F.lit("present"))


def strip_html(c: Column) -> Column:
    """Text of a page in lower case: scripts and styles go, tags become spaces, the five core references are decoded."""
    t = F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]+>", " ")
    for code, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(code), F.lit(char))
    return F.trim(F.regexp_replace(F.lower(t), r"[ \t\r\n]+", " "))


def ticker(c: Column) -> Column:
    """'VMW US' is VMW; placeholders of digits are blank; classes are written with a slash."""
    t = F.regexp_replace(F.upper(clean(c, MISSING_ADAPTER)), r"\s+", " ")
    t = F.when(F.regexp_count(t, F.lit(" ")) >= 1, F.regexp_replace(t, " [^ ]{1,3}$", "")).otherwise(t)
    t = F.when(t.rlike(r"^[0-9]{4,}[A-Z]?$"), blank()).otherwise(t)
    return F.trim(F.when(F.contains(t, F.lit("/")), F.replace(t, F.lit("."), F.lit("/"))).otherwise(t))


def cusip(c: Column, width: int = 9) -> Column:
    return F.substring(F.upper(F.regexp_replace(clean(c, MISSING_ADAPTER), "[^A-Za-z0-9]+", "")), 1, width)


def cusip_check_digit(base: Column) -> Column:
    """The mod-10 digit of an 8-character base: letters count from 10, every second value doubles, digits of values add up; null if not computable."""
    symbols = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ*@#"
    digits = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: (F.position(F.substr(F.upper(base), i, F.lit(1)), F.lit(symbols)) - 1) * F.when(i % 2 == 0, 2).otherwise(1))
    total = F.aggregate(digits, F.lit(0), lambda a, v: a + F.floor(v / 10).cast("int") + v % 10)
    return F.when(F.upper(base).rlike("^[0-9A-Z*@#]{8}"), ((10 - total % 10) % 10).cast("string"))


def to_cusip9(c: Column) -> Column:
    t = cusip(c)
    return F.when(F.length(t) == 8, F.concat(t, F.coalesce(cusip_check_digit(t), blank()))).otherwise(t)


def cusip_class(c: Column) -> Column:
    t = clean(c, MISSING_ADAPTER)
    return F.when((t == "") | F.upper(t).isin("N.A.", "N/A", "."), F.lit("missing")).when(t.rlike("^[0-9A-Za-z]{9}$"), F.lit("ok")).when(t.rlike("^[0-9A-Za-z]{8}$"), F.lit("short_suspect")).otherwise(F.lit("malformed"))


def cusip_equivalent(raw: Column, nine: Column) -> Column:
    """Equal, or equal but for a lost leading zero or the check digit."""
    b, c = (F.upper(F.regexp_replace(clean(x, MISSING_ADAPTER), "[^0-9A-Za-z]", "")) for x in (raw, nine))
    base = F.substring(c, 1, 8)
    short = (F.length(b) == 8) & ((F.concat(F.lit("0"), b) == c) | (b == base))
    return (b != "") & (c != "") & ((b == c) | short | ((F.length(b) == 9) & (F.substring(b, 1, 8) == base)))


def category(c: Column) -> Column:
    """What a payment or a default rule offers: cash or stock, cash and stock, one of them, mixed, else its first 80 characters."""
    t = F.regexp_replace(F.lower(clean(c)), r"\s+", " ")
    cash, stock = _mentions(t)
    return (
        F.when(t == "", F.lit("__missing__"))
        .when(F.contains(t, F.lit("cash or stock")), F.lit("cash_or_stock"))
        .when(F.contains(t, F.lit("cash and stock")), F.lit("cash_and_stock"))
        .when(cash & ~stock, F.lit("cash"))
        .when(stock & ~cash, F.lit("stock"))
        .when(F.contains(t, F.lit("mixed")) | cash & stock, F.lit("mixed"))
        .otherwise(F.substring(t, 1, 80))
    )


def path_value(c: Column, *path: str) -> Column:
    """What a JSON text holds at a path; objects and lists as JSON, null where the path ends."""
    return F.get_json_object(c, "$" + "".join(f"['{x}']" for x in path))


def filing_urls(base: str, cik: Column, accession: Column, document: Column) -> dict[str, Column]:
    """Addresses of a filing under base: its folder, main document, full text and index."""
    folder = F.concat(F.lit(f"{base}/"), cik.cast("long").cast("string"), F.lit("/"), F.replace(accession, F.lit("-"), F.lit("")), F.lit("/"))
    return {"base_url": folder, "primary_url": F.concat(folder, document), "complete_txt_url": F.concat(folder, accession, F.lit(".txt")), "index_json_url": F.concat(folder, F.lit("index.json"))}


def display_name_parts(c: Column) -> dict[str, Column]:
    """The ten-digit id, the ticker before it and the name that a search result's display name holds; null or empty where there is none."""
    return {
        "cik10": F.nullif(F.regexp_extract(c, r"\(CIK ([0-9]{10})\)", 1), F.lit("")),
        "name": F.trim(F.get(F.split(c, r"  \("), F.lit(0))),
        "ticker": F.regexp_extract(c, r"\(([A-Z][A-Z0-9.-]{0,6})\)\s*\(CIK", 1),
    }


def json_list(c: Column) -> Column:
    """A JSON list's items as text; a scalar, or what is no JSON, is one item; missing text none."""
    t = clean(c)
    parsed = F.when(t.startswith("["), F.from_json(t, "array<string>"))
    string = F.when(t.startswith('"'), F.get_json_object(F.concat(F.lit('{"x":'), t, F.lit("}")), "$.x"))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.coalesce(parsed, F.array(F.coalesce(string, t))))


#: Parts of names of files that are no documents, and the endings of those that are.
NOT_DOCUMENTS = r"(index|filingsummary|metalinks|\.xsd$|_cal\.xml$|_def\.xml$|_lab\.xml$|_pre\.xml$|report[0-9]*\.htm$)"
DOCUMENT_ENDINGS = (".htm", ".html", ".txt", ".xml")


def is_document(name: Column) -> Column:
    """Whether a file of a filing is a document to read, by its name."""
    t = F.lower(F.trim(F.coalesce(name, blank())))
    ends = F.lit(False)
    for x in DOCUMENT_ENDINGS:
        ends = ends | t.endswith(x)
    return ends & ~t.rlike(NOT_DOCUMENTS)


def menu_flag(flag: Column, menu: Column, payment: Column) -> Column:
    """true or false: a flag that says so, else whether the payment or the menu offers cash or stock."""
    t, m, p = (F.lower(clean(c)) for c in (flag, menu, payment))
    offered = F.contains(p, F.lit("cash or stock")) | F.contains(m, F.lit("cash election")) & F.contains(m, F.lit("stock election"))
    return F.when(t.isin("true", "1", "yes"), F.lit("true")).when(t.isin("false", "0", "no"), F.lit("false")).otherwise(F.when(offered, F.lit("true")).otherwise(F.lit("false")))
