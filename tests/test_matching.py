"""Best matches in a register against all pairs."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewater.operators import matching as M
from tidewater.plans import identity
from tidewater.sources.derived import Tables


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=12), st.text("abc", max_size=12))
def test_longest_common_subsequence(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    assert M.longest_common(a, b) == best[-1][-1] == M.longest_common(b, a)


def test_ratio_by_hand():
    assert M.set_ratio("acme steel", "steel acme") == 100 and M.set_ratio("acme", "acme steel works") == 100
    assert M.set_ratio("", "a") == 0 and M.set_ratio("abcd", "abce") == pytest.approx(75)
    # "first" is common; "bank" and "bankk" differ by one letter of 9 + 1 + 5 ... : 1 - 1 / (10 + 11)
    assert M.set_ratio("first bank", "first bankk") == pytest.approx(100 * (1 - 1 / 21))
    # what "zz" adds to the common words counts for one side alone
    assert M.set_ratio("alpha beta gamma zz", "alpha beta gamma other") == pytest.approx(100 * (1 - 3 / 35))


def brute(asked, register):
    known = {}
    for i, n in register:
        if n:
            known[n] = min(i, known.get(n, i))
    out = {}
    for i, n in asked:
        if n in known:
            out[i] = (100.0, known[n])
        elif n:
            score, match = min((-round(M.set_ratio(n, m), 9), j) for m, j in known.items())
            out[i] = (-score, match) if -score >= M.LEAST_SCORE else None
        else:
            out[i] = None
    return out


def normal(df):
    return [(r.id, r.n) for r in df.select("id", M.company_name(F.col("name")).alias("n")).collect()]


def test_whole_register(spark, small):
    t = Tables(spark, small)
    want = brute(normal(identity.asked(t)), normal(identity.titled(t)))
    got = {r.query_id: (r.score, r.match_id) if r.matched else None for r in identity.company_match(t).collect()}
    assert got.keys() == want.keys()
    sure = [i for i, w in want.items() if w]
    hit = [i for i in sure if got[i] and round(got[i][0], 6) == round(want[i][0], 6)]
    assert len(hit) >= 0.98 * len(sure) and len(sure) > 100 and all(got[i] is None for i, w in want.items() if not w)
    assert all(got[i][1] == want[i][1] for i in hit if want[i][0] == 100)


def test_common_words_alone_are_never_missed(spark):
    rng = random.Random(2)
    words = ["bank", "first", "steel", "united", "trust", "zinc", "opal", "quartz", "ridge", "energy", "of", "a"]
    names = [" ".join(rng.choices(words, k=rng.randint(1, 5))) for _ in range(150)]
    asked = [(i, " ".join(rng.choices(words, k=rng.randint(1, 5)))) for i in range(150)] + [(900, ""), (901, None), (902, "Inc."), (903, "bank")]
    register = [(1000 + i, n) for i, n in enumerate(names)] + [(5000, ""), (5001, None), (5002, "bank")] * 2
    q, r = spark.createDataFrame(asked, "id long, name string"), spark.createDataFrame(register, "id long, name string")
    want = brute(normal(q), normal(r))
    got = {x.query_id: (x.score, x.match_id) if x.matched else None for x in M.best_matches(q, r, pieces=0).collect()}
    for i, w in want.items():
        a = dict(asked)[i]
        # by common words: one's are all in the other's, or what one adds is little
        if w and any(wc >= M.LEAST_SCORE for n in names if (wc := by_words(a, n)) and round(M.set_ratio(a, n), 9) == w[0] == round(wc, 9)):
            assert got[i] and got[i][0] == pytest.approx(w[0]), (a, w, got[i])
    assert got[900] is got[901] is got[902] is None and got[903][0] == 100
    assert M.best_matches(q.limit(0), r).count() == 0 and all(not x.matched for x in M.best_matches(q, r.limit(0)).collect())


def by_words(a, b):
    wa, wb = set((a or "").split()), set(b.split())
    both, xa, xb = " ".join(wa & wb), " ".join(wa - wb), " ".join(wb - wa)
    if not both:
        return 0
    if not xa or not xb:
        return 100.0
    return max(100 * (1 - (1 + len(x)) / (2 * len(both) + 1 + len(x))) for x in (xa, xb))
