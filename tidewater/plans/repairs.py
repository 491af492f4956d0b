"""Queries of mended prices and of labels sent out and taken back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import labels as L
from ..operators import price_repair as R
from .registry import query

_PLAN = """
kn AS (SELECT event_id, bool_or(side = 'acquirer') AS has FROM {vendor_prices} GROUP BY event_id),
cd AS (
  SELECT a.event_id, announce_date, permno, row_number() OVER (PARTITION BY a.event_id ORDER BY announce_date BETWEEN from_date AND to_date DESC, CASE WHEN NOT announce_date BETWEEN from_date AND to_date THEN to_date END DESC NULLS LAST, permno) AS n
  FROM {acquirers} a JOIN kn ON kn.event_id = a.event_id AND NOT has JOIN {links} l ON l.cusip8 = substr(upper(regexp_replace(cusip, '[^0-9A-Za-z]', '', 'g')), 1, 8)),
ov AS (SELECT o.event_id, a.announce_date, side, min(o.permno) AS permno FROM {price_overrides} o JOIN {acquirers} a ON a.event_id = o.event_id JOIN kn ON kn.event_id = o.event_id GROUP BY ALL),
pl AS (
  SELECT *, true AS rep FROM ov
  UNION ALL SELECT event_id, announce_date, 'acquirer', permno, false FROM cd WHERE n = 1 AND event_id NOT IN (SELECT event_id FROM ov WHERE side = 'acquirer'))"""


@query("repair_plan", f"WITH {_PLAN.strip()} SELECT event_id, announce_date, side, permno, rep AS replace FROM pl")
def repair_plan(t):
    """Which sides of which events are to be fetched, and of which security."""
    return R.repair_plan(t.vendor_prices, t.acquirers, t.links, t.price_overrides)


@query(
    "price_repair",
    f"""WITH {_PLAN.strip()},
ad AS (SELECT pl.event_id, side, s.price_date, s.price, s.volume, s.permno, CASE WHEN rep THEN side || '_permno_override' ELSE 'cusip_permno_fix' END AS symbol_source, rep FROM pl JOIN {{securities}} s ON s.permno = pl.permno AND s.price_date BETWEEN announce_date - 30 AND announce_date + 400)
SELECT event_id, side, price_date, price, volume, permno, symbol_source FROM {{vendor_prices}} v WHERE NOT EXISTS (SELECT 1 FROM ad WHERE rep AND ad.event_id = v.event_id AND ad.side = v.side)
UNION ALL SELECT event_id, side, price_date, price, volume, permno, symbol_source FROM ad""",
)
def price_repair(t):
    """All prices after the repair."""
    return R.repaired(t.vendor_prices, t.acquirers, t.links, t.securities, t.price_overrides)


LABELS, CONTEXT = ("purchase", "click"), ("view", "error")
_FIRST = ", ".join(f"min_by(value, row_idx) FILTER (field_name = '{f}' AND value IS NOT NULL) AS \"{f}\"" for f in (*LABELS, *CONTEXT))
_ASKED = f"rq AS (SELECT * FROM (SELECT event_id, {_FIRST} FROM {{extraction}} GROUP BY event_id) WHERE coalesce(purchase, click) IS NOT NULL)"


@query("label_request", f"WITH {_ASKED} SELECT event_id, purchase, click, view, error, {' + '.join(f'CASE WHEN {f} IS NULL THEN 0 ELSE 1 END' for f in (*LABELS, *CONTEXT))} AS filled FROM rq")
def label_request(t):
    """What is asked for each event; the payload holds the same fields as JSON, which is read back here."""
    d = L.requests(t.extraction, LABELS, CONTEXT)
    fields = [*LABELS, *CONTEXT]
    back = F.from_json("payload", f"struct<raw_disclosure:struct<{', '.join(f'{f}:string' for f in fields)}>>")["raw_disclosure"]
    filled = sum((F.when(F.col(f).isNotNull(), 1).otherwise(0) for f in fields), F.lit(0))
    return d.select("event_id", *[back[f].alias(f) for f in fields], filled.alias("filled"))


_NUMBER = "TRY_CAST(json_extract_string(j, '$.{k}') AS DOUBLE)"


def _merge_sql() -> str:
    faults = []
    for k, (low, high) in L.NUMBERS.items():
        value = _NUMBER.format(k=k)
        outside = f"coalesce({value} < {low}e0{f' OR {value} > {high}e0' if high is not None else ''}, true)"
        faults.append(f"WHEN json_extract_string(j, '$.{k}') IS NOT NULL AND {outside} THEN 'bad_{k}'")
    for k, words in (("disclosure_type", L.DISCLOSURES), ("basis", L.BASES)):
        faults.append(f"WHEN json_extract_string(j, '$.{k}') IS NOT NULL AND json_extract_string(j, '$.{k}') NOT IN ({', '.join(repr(w) for w in words)}) THEN 'bad_{k}'")
    columns = [f"CASE WHEN status = 'ok' THEN {_NUMBER.format(k=k)} END AS {k}" for k in L.NUMBERS] + [f"CASE WHEN status = 'ok' THEN json_extract_string(j, '$.{k}') END AS {k}" for k in L.TEXTS]
    return f"""WITH {_ASKED},
js AS (SELECT event_id, response, TRY_CAST(nullif(regexp_extract(response, '[{{].*[}}]', 0), '') AS JSON) AS j FROM {{answers}}),
st AS (SELECT coalesce(js.event_id, rq.event_id) AS event_id, j, CASE WHEN rq.event_id IS NULL THEN 'not_requested' WHEN response IS NULL THEN 'no_answer' WHEN j IS NULL THEN 'parse_error' {' '.join(faults)} ELSE 'ok' END AS status FROM js FULL JOIN rq ON rq.event_id = js.event_id)
SELECT event_id, {', '.join(columns)}, status FROM st"""


@query("label_merge", _merge_sql())
def label_merge(t):
    """Answers merged back: each whole or not at all, and why not."""
    return L.merged(L.requests(t.extraction, LABELS, CONTEXT), t.answers)
