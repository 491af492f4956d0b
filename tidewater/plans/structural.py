"""Queries of the structural trade model, rolled along time: each deal is decided with the holder fit and the outcome model of the deals before it, and with draws of both elections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.numbers import proration_factor, signed_log
from ..operators import capacity as C
from ..operators import holders as H
from ..operators import payoff as P
from ..operators import structural as S
from ..operators.cuts import cut, dealt
from .capacity import HOLDER_FIT_SQL
from .panel import realized_share
from .payoff import VOTES_SQL
from .registry import query

HOLDERS = C.CapacityConfig()
#: The gates: no loss expected, a fifth percentile of no less than -6 a share, and a loss less likely than not.
CFG = S.TradeConfig(least_p05=-6.0, most_loss_probability=0.5)
EVEN, DRAWS = 32, 20_000
#: Deals in a task: each costs some milliseconds of draws, or some microseconds of even ones.
DEALS, EVEN_DEALS = 256, 1 << 16
#: The outcome model's features. Shares and percentages enter as they are, the rest by their signed logarithm.
NUMERIC = (
    "value_mil", "tv_ebitda", "quoted_target", "acq_price", "entry_target", "entry_acquirer", "deal_spread", "deal_spread_pct", "target_adv", "target_dollar_adv", "target_quote_spread_pct", "target_market_cap",
    "target_shares", "acquirer_adv", "acquirer_quote_spread_pct", "short_ratio", "short_ratio_20", "passive_percent", "etf_percent", "cash", "ratio", "pi_cash_fraction", "stock_cap_fraction",
)
CATEGORICAL = ("payment_raw", "payment_text", "rule", "other_rule", "is_menu")
_PLAIN = ("_pct", "_percent", "_fraction")


def panel(t) -> DataFrame:
    """Deals in order with what was disclosed of their elections as a share, its source and its weight: the demand itself, or the cap over the fill that prose tells."""
    d = H.panel(t.traits).withColumn("pi_cash_fraction", F.col("pi_cash"))
    final, early = (proration_factor(F.col(c), "cash") for c in ("final_results", "preliminary_results"))
    got = realized_share(F.col("reported"), F.lit(None).cast("double"), F.col("pi_cash"), final, early)
    return d.withColumn("_got", got).withColumns({"f_cash": F.col("_got.share"), "label_source": F.col("_got.source"), "weight": F.col("_got.weight")}).drop("_got")


def features(d: DataFrame) -> DataFrame:
    menu = F.contains(F.lower(F.coalesce("payment_raw", "payment_text")), F.lit("cash or stock"))
    numeric = [(F.col(k) if k.endswith(_PLAIN) else signed_log(F.col(k))).alias(k) for k in NUMERIC]
    kinds = {"payment_raw": F.col("payment_raw"), "payment_text": F.col("payment_text"), "rule": X.first_filled(F.col("default_rule"), F.col("other_rule")), "other_rule": F.col("other_rule")}
    return d.select("event_id", "labelled", "label", *numeric, *[X.category(c).alias(k) for k, c in kinds.items()], F.when(menu, "true").otherwise("false").alias("is_menu"))


def outcomes(d: DataFrame) -> DataFrame:
    """Outcome probabilities of each deal of the panel from the 250 labelled ones before it."""
    return S.rolling_outcomes(features(H.labelled_before(d, "label", "pos")), NUMERIC, CATEGORICAL)


def elections(t) -> DataFrame:
    """Both elections of each deal, from the fits of the deals before it."""
    d = cut(panel(t))
    fit = H.rolling_fit(d, HOLDERS).select("event_id", "p_hat", "q_hat", F.col("fit_n").alias("holder_fit_n"))
    odds = outcomes(d).select("event_id", *[f"p_{s}" for s in S.STATES], F.col("fit_n").alias("outcome_fit_n"))
    d = d.join(fit, "event_id").join(odds, "event_id")
    votes = P.predicted_votes(F.col("p_hat"), F.col("q_hat"), F.col("passive"), F.col("default_rule"), F.col("cash"), F.col("stock"), F.col("target_price"))
    k = F.col("event_id")
    d = d.select(
        "event_id", "cash", "stock", "ratio", F.col("target_price").alias("entry"), F.col("acq_price").alias("entry_acq"), (F.col("acq_price") * (0.9 + (k % 17) / 64.0)).alias("exit_acq"), F.col("pi_cash").alias("cash_cap"), (1 - F.col("pi_cash")).alias("stock_cap"),
        votes["cash_demand"].alias("cash_demand"), C.own_vote_share(F.lit(CFG.notional), F.col("target_price"), F.col("target_shares")).alias("own_share"), F.col("target_quote_spread_pct").alias("target_spread"), F.col("acquirer_quote_spread_pct").alias("acq_spread"),
        (30 + k % 60).alias("days"), F.col("f_cash").alias("observed"), "label_source", F.col("label").alias("outcome"), "p_hat", "q_hat", "holder_fit_n", "outcome_fit_n", *[f"p_{s}" for s in S.STATES],
    )
    return S.elections(d, CFG)


def decided(t, draws: int, even: bool) -> DataFrame:
    return S.decide(S.simulated(dealt(elections(t), "event_id", EVEN_DEALS if even else DEALS), CFG, draws, even), CFG)


def _logged(k: str) -> str:
    source = {"pi_cash_fraction": "pi_cash"}.get(k, k)
    return f"{source} AS {k}" if k.endswith(_PLAIN) else f"sign({source}) * ln(1e0 + abs({source})) AS {k}"


def _rolling_sql(source: str) -> str:
    """The outcome model over the 250 labelled rows before each, by windows over every row."""
    states, base = S.STATES, (0.9, 0.07, 0.03)
    w = ", ".join(f"count(*) FILTER (label = '{s}') OVER w AS n{i}" for i, s in enumerate(states))
    w += "".join(
        f", count({k}) FILTER (label = '{s}') OVER w AS {k}_c{i}, coalesce(sum({k} - {k}_m) FILTER (label = '{s}') OVER w, 0) AS {k}_s{i}, coalesce(sum(({k} - {k}_m) * ({k} - {k}_m)) FILTER (label = '{s}') OVER w, 0) AS {k}_q{i}"
        for k in NUMERIC
        for i, s in enumerate(states)
    )
    w += "".join(f", len(list_distinct(coalesce(list({k}) FILTER (label IS NOT NULL) OVER w, []) || ['__missing__'])) AS {k}_words" for k in CATEGORICAL)
    w += "".join(f", count(*) FILTER (label = '{s}') OVER {k}_w AS {k}_v{i}" for k in CATEGORICAL for i, s in enumerate(states))
    frames = "w AS (ORDER BY labelled RANGE BETWEEN 250 PRECEDING AND 1 PRECEDING), " + ", ".join(f"{k}_w AS (PARTITION BY {k} ORDER BY labelled RANGE BETWEEN 250 PRECEDING AND 1 PRECEDING)" for k in CATEGORICAL)

    def score(i: int) -> str:
        prior = f"((n{i} + {base[i]}e0) / (n0 + n1 + n2 + 3)) / ((n0 + n1 + n2 + 1) / (n0 + n1 + n2 + 3))"
        out = f"ln(greatest({prior}, 1e-12))"
        for k in NUMERIC:
            gn, gs, gq = (f"({' + '.join(f'{k}_{x}{j}' for j in range(3))})" for x in "csq")
            mean = f"CASE WHEN {k}_c{i} >= 2 THEN {k}_s{i} / {k}_c{i} WHEN {gn} > 0 THEN {gs} / {gn} ELSE -{k}_m END"
            var = f"CASE WHEN {k}_c{i} >= 2 THEN greatest(({k}_q{i} - {k}_s{i} * {k}_s{i} / {k}_c{i}) / ({k}_c{i} - 1), 1e-4) WHEN {gn} > 0 THEN greatest(({gq} - {gs} * {gs} / {gn}) / greatest(1, {gn} - 1), 1e-4) ELSE 1e0 END"
            out += f" + coalesce(-5e-1 * (ln(2 * 3.141592653589793e0 * ({var})) + ({k} - {k}_m - ({mean})) * ({k} - {k}_m - ({mean})) / ({var})), 0e0)"
        return out + "".join(f" + ln(({k}_v{i} + 1e0) / (n{i} + {k}_words))" for k in CATEGORICAL)

    e = ", ".join(f"exp(s{i} - greatest(s0, s1, s2)) AS e{i}" for i in range(3))
    p = ", ".join(f"CASE WHEN fit_n >= 25 THEN e{i} / (e0 + e1 + e2) ELSE {base[i]}e0 END AS p_{s}" for i, s in enumerate(states))
    return f"""
rf AS (
  SELECT event_id, label, count(label) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS labelled, {', '.join(_logged(k) for k in NUMERIC)},
    CASE event_id % 5 WHEN 0 THEN 'cash_or_stock' WHEN 1 THEN 'cash_and_stock' WHEN 2 THEN 'stock' WHEN 3 THEN '__missing__' ELSE 'cash' END AS payment_raw, CASE party % 4 WHEN 0 THEN '__missing__' WHEN 1 THEN 'mixed' ELSE 'cash' END AS payment_text,
    default_rule AS rule, CASE event_id % 6 WHEN 0 THEN 'mixed' WHEN 1 THEN '__missing__' ELSE 'stock' END AS other_rule, CASE WHEN event_id % 5 = 0 THEN 'true' ELSE 'false' END AS is_menu FROM {source}),
rm AS (SELECT *, {', '.join(f'avg({k}) OVER () AS {k}_m' for k in NUMERIC)} FROM rf),
rs AS (SELECT *, {w} FROM rm WINDOW {frames}),
rc AS (SELECT event_id, n0 + n1 + n2 AS fit_n, {', '.join(f'{score(i)} AS s{i}' for i in range(3))} FROM rs),
rx AS (SELECT event_id, fit_n, {e} FROM rc),
ro AS (SELECT event_id, {p}, fit_n, CASE WHEN fit_n >= 25 THEN 'rolling_naive_bayes' ELSE 'default_probabilities_insufficient_history' END AS source FROM rx)"""


#: The panel with what was disclosed, and the outcome model over it.
_PANEL = f"""
pd AS (
  SELECT *, CAST(regexp_extract(final_results, '([0-9]+)%', 1) AS DOUBLE) / 100 AS final, CAST(regexp_extract(preliminary_results, '(0[.][0-9]+)', 1) AS DOUBLE) AS early FROM {{traits}}),
pn AS (
  SELECT *, row_number() OVER (ORDER BY announce_date, event_id) AS pos, passive_percent AS passive, CASE WHEN payment_type LIKE '1%' THEN 'cash' WHEN payment_type LIKE '2%' THEN 'stock' ELSE 'mixed' END AS default_rule, ratio * acq_price AS stock,
    cash * (9e-1 + (event_id % 13) / 64e0) AS target_price, coalesce(reported, CASE WHEN final > 0 THEN least(1e0, pi_cash / final) END, CASE WHEN early > 0 THEN least(1e0, pi_cash / early) END) AS f_cash,
    CASE WHEN reported IS NOT NULL THEN 1e0 WHEN nullif(final, 0e0) IS NOT NULL THEN 65e-2 WHEN nullif(early, 0e0) IS NOT NULL THEN 45e-2 ELSE 0e0 END AS weight,
    CASE WHEN reported IS NOT NULL THEN 'direct_realized_cash_election_demand' WHEN nullif(final, 0e0) IS NOT NULL THEN 'final_proration_results_backed_out_from_cap' WHEN nullif(early, 0e0) IS NOT NULL THEN 'preliminary_proration_results_backed_out_from_cap' ELSE '' END AS label_source FROM pd),"""


@query("observed_shares", f"WITH {_PANEL.strip().rstrip(',')} SELECT event_id, round(f_cash, 9) AS cash_share, round(1 - f_cash, 9) AS stock_share, label_source, weight FROM pn")
def observed_shares(t):
    """The elections of each deal as disclosed, those out of prose too."""
    return panel(t).select("event_id", F.round("f_cash", 9).alias("cash_share"), F.round(1 - F.col("f_cash"), 9).alias("stock_share"), "label_source", "weight")


@query("rolling_outcomes", f"WITH {_PANEL.strip()} {_rolling_sql('pn').strip()} SELECT event_id, {', '.join(f'round(p_{s}, 7) AS p_{s}' for s in S.STATES)}, fit_n, source FROM ro")
def rolling_outcomes(t):
    """Outcome probabilities of each deal from the 250 labelled ones before it, by 23 numeric and 5 categorical features."""
    return outcomes(panel(t)).select("event_id", *[F.round(f"p_{s}", 7).alias(f"p_{s}") for s in S.STATES], "fit_n", "source")


#: Each deal with its fits, votes, and both elections side by side, on even draws.
_ELECTIONS = f"""{_PANEL}
hf AS ({HOLDER_FIT_SQL.replace('PANEL', 'pn')}),
{_rolling_sql('pn').strip()},
pv AS (SELECT pn.*, hf.p_hat, hf.q_hat, ro.p_completed, ro.p_terminated, ro.p_withdrawn FROM pn JOIN hf ON hf.event_id = pn.event_id JOIN ro ON ro.event_id = pn.event_id),
{VOTES_SQL.format(p='p_hat', q='q_hat').replace('{holders}', 'pv')},
b0 AS (
  SELECT event_id, cash, stock, ratio, target_price AS entry, acq_price AS entry_acq, acq_price * (9e-1 + (event_id % 17) / 64e0) AS exit_acq, pi_cash AS cash_cap, 1 - pi_cash AS stock_cap, CASE WHEN cd + sd > 1e-12 THEN cd / (cd + sd) ELSE cd END AS cash_demand,
    greatest(0e0, least(25e-2, 1e6 / target_price / target_shares)) AS own, target_quote_spread_pct AS tsp, acquirer_quote_spread_pct AS asp, 30 + event_id % 60 AS days, f_cash AS observed, label AS outcome, p_completed, p_terminated, p_withdrawn FROM v3),
b1 AS (SELECT b0.*, c AS choice, cash_demand * (1 - own) + CASE WHEN c = 'cash' THEN own ELSE 0 END AS d FROM b0 CROSS JOIN (VALUES ('cash'), ('stock')) x(c)),
b2 AS (SELECT *, CASE WHEN choice = 'cash' THEN CASE WHEN d <= 1e-12 THEN 1e0 ELSE least(1e0, cash_cap / d) END ELSE 1 - CASE WHEN 1 - d <= 1e-12 THEN 1e0 ELSE least(1e0, stock_cap / (1 - d)) END END AS cp FROM b1),
b3 AS (SELECT *, 1 - cp AS sp, cp * cash + (1 - cp) * stock - entry AS gross, greatest(0e0, (1 - cp) * ratio) AS h FROM b2),
b4 AS (SELECT *, entry * 5e-4 + h * entry_acq * 5e-4 + coalesce(5e-1 * entry * tsp, 0) + coalesce(h * entry_acq * asp, 0) + h * entry_acq * 5e-3 * days / 365 AS cost FROM b3),
b5 AS (SELECT *, gross - cost AS net, entry * 75e-2 - entry - cost AS term, entry * 65e-2 - entry - cost AS wdr FROM b4),
k0 AS (
  SELECT b5.*, (k + 1) * 0.6180339887498949e0 - floor((k + 1) * 0.6180339887498949e0) AS u,
    greatest(1e-6, least(1 - 1e-6, cash_demand + sqrt(3 * cash_demand * (1 - cash_demand) / 76e0) * (2 * (k + 5e-1) / 32e0 - 1))) * (1 - own) + CASE WHEN choice = 'cash' THEN own ELSE 0 END AS f FROM b5, range(32) r(k)),
k1 AS (SELECT *, CASE WHEN choice = 'cash' THEN 1 - least(1e0, cash_cap / greatest(f, 1e-12)) ELSE least(1e0, stock_cap / greatest(1 - f, 1e-12)) END AS s FROM k0),
k2 AS (SELECT *, (1 - s) * cash + s * stock - entry - ((entry + s * ratio * entry_acq) * 5e-4 + 5e-1 * entry * coalesce(tsp, 0) + s * ratio * entry_acq * coalesce(asp, 0) + s * ratio * entry_acq * 5e-3 * days / 365) AS v FROM k1),
k3 AS (SELECT event_id, choice, CASE WHEN u < p_terminated THEN term WHEN u < p_terminated + p_withdrawn THEN wdr ELSE v END AS v FROM k2),
k4 AS (SELECT event_id, choice, avg(v) AS mean, quantile_cont(v, 5e-2) AS p05, avg(CASE WHEN v < 0 THEN 1e0 ELSE 0e0 END) AS loss FROM k3 GROUP BY event_id, choice),
b6 AS (SELECT b5.*, mean, p05, loss FROM b5 JOIN k4 ON k4.event_id = b5.event_id AND k4.choice = b5.choice),
de AS (
  SELECT event_id, max(cash) AS cash, max(stock) AS stock, max(entry) AS entry, max(mean) FILTER (choice = 'cash') AS ca, max(mean) FILTER (choice = 'stock') AS sa, max(p05) FILTER (choice = 'cash') AS cp05, max(p05) FILTER (choice = 'stock') AS sp05,
    max(loss) FILTER (choice = 'cash') AS cl, max(loss) FILTER (choice = 'stock') AS sl FROM b6 GROUP BY event_id),
df AS (SELECT *, CASE WHEN ca >= sa THEN 'cash' ELSE 'stock' END AS choice, greatest(ca, sa) AS value, CASE WHEN ca >= sa THEN cp05 ELSE sp05 END AS p05, CASE WHEN ca >= sa THEN cl ELSE sl END AS loss FROM de),
dc AS (
  SELECT event_id, choice, value, p05, loss, CASE WHEN cash < entry AND stock < entry THEN 'both_uncapped_evs_negative_rational_exit' WHEN round(value, 9) < 0 THEN 'risk_adjusted_alpha_below_threshold'
    WHEN round(p05, 9) < -6 THEN 'mc_p05_alpha_below_threshold' WHEN loss > 5e-1 THEN 'mc_loss_probability_above_threshold' ELSE 'risk_adjusted_alpha_positive' END AS reason FROM df)"""


@query(
    "choice_decision",
    f"""WITH {_ELECTIONS.strip()} SELECT dc.event_id, dc.choice, round(value, 8) AS value, round(dc.p05, 8) AS p05, dc.loss, reason, CASE WHEN reason = 'risk_adjusted_alpha_positive' THEN 'trade_' || dc.choice || '_election' ELSE 'no_trade' END AS signal,
  round(gross, 9) AS gross, round(net, 9) AS net FROM dc JOIN b6 ON b6.event_id = dc.event_id AND b6.choice = dc.choice""",
)
def choice_decision(t):
    """The better election of each deal after costs and breaks on even draws, and the gates that it passes."""
    d = decided(t, EVEN, True)
    own = lambda x: F.round(F.when(F.col("choice") == "cash", F.col(f"cash_{x}")).otherwise(F.col(f"stock_{x}")), 9).alias(x)
    return d.select("event_id", "choice", F.round("value", 8).alias("value"), F.round("p05", 8).alias("p05"), "loss", "reason", "signal", own("gross"), own("net"))


_JUDGED = f"""{_ELECTIONS.strip()},
j0 AS (SELECT b6.*, dc.choice AS picked, reason = 'risk_adjusted_alpha_positive' AS trades, coalesce(observed, cash_demand) AS od, CASE WHEN reason = 'risk_adjusted_alpha_positive' THEN own ELSE 0 END AS ow, 1e6 / entry AS n FROM b6 JOIN dc ON dc.event_id = b6.event_id),
j1 AS (SELECT *, od * (1 - ow) + CASE WHEN choice = 'cash' THEN ow ELSE 0 END AS jd FROM j0),
j2 AS (SELECT *, CASE WHEN choice = 'cash' THEN CASE WHEN jd <= 1e-12 THEN 1e0 ELSE least(1e0, cash_cap / jd) END ELSE 1 - CASE WHEN 1 - jd <= 1e-12 THEN 1e0 ELSE least(1e0, stock_cap / (1 - jd)) END END AS jc FROM j1),
j3 AS (SELECT *, CASE coalesce(outcome, '') WHEN 'terminated' THEN n * term WHEN 'withdrawn' THEN n * wdr ELSE n * jc * cash + n * (1 - jc) * ratio * exit_acq - 1e6 + n * h * (entry_acq - exit_acq) - n * cost END AS pnl FROM j2),
j4 AS (SELECT event_id, bool_or(coalesce(outcome, '') IN ('terminated', 'withdrawn') OR observed IS NOT NULL) AS labelled, bool_or(trades) AS trades, max(pnl) AS best, max(pnl) FILTER (trades AND choice = picked) AS done FROM j3 GROUP BY event_id)"""


@query("choice_outcome", f"WITH {_JUDGED} SELECT event_id, labelled, round(best, 4) AS best_pnl, round(done, 4) AS executed_pnl, coalesce(labelled AND NOT trades AND best > 0, false) AS missed, coalesce(labelled AND trades AND done < 0, false) AS lost, coalesce(NOT labelled AND NOT trades AND best > 0, false) AS proxy_missed, coalesce(NOT labelled AND trades AND done < 0, false) AS proxy_lost FROM j4")
def choice_outcome(t):
    """What came of each decision, and the flags of missed and of losing trades."""
    d = S.judged(decided(t, EVEN, True), CFG)
    return d.select("event_id", "labelled", F.round("best_pnl", 4).alias("best_pnl"), F.round("executed_pnl", 4).alias("executed_pnl"), "missed", "lost", "proxy_missed", "proxy_lost")


@query(
    "structural_backtest",
    f"""WITH {_JUDGED} SELECT count(*) AS events, count(*) FILTER (trades) AS trades, count(*) FILTER (labelled) AS labelled, round(sum(done) FILTER (labelled), 2) AS realized_pnl, round(avg(done) FILTER (labelled), 4) AS mean_pnl, round(avg(CASE WHEN done > 0 THEN 1e0 ELSE 0e0 END) FILTER (labelled AND done IS NOT NULL), 9) AS hit_rate,
  count(*) FILTER (labelled AND NOT trades AND best > 0) AS missed, count(*) FILTER (labelled AND trades AND done < 0) AS lost, count(*) FILTER (NOT labelled AND NOT trades AND best > 0) AS proxy_missed, count(*) FILTER (NOT labelled AND trades AND done < 0) AS proxy_lost FROM j4""",
)
def structural_backtest(t):
    d = S.backtest_summary(S.judged(decided(t, EVEN, True), CFG))
    return d.withColumns({"realized_pnl": F.round("realized_pnl", 2), "mean_pnl": F.round("mean_pnl", 4), "hit_rate": F.round("hit_rate", 9)})


@query("structural_mc")
def structural_mc(t, draws=DRAWS):
    """Draws of both elections of each deal, random ones, which have no SQL."""
    d = S.simulated(dealt(elections(t), "event_id", DEALS), CFG, draws)
    return d.select("event_id", *[f"{c}_{x}" for c in S.CHOICES for x in S.DRAWN])


@query("rolling_backtest")
def rolling_backtest(t, draws=DRAWS):
    """The backtest's summary where decisions rest on random draws."""
    return S.backtest_summary(S.judged(decided(t, draws, False), CFG))
