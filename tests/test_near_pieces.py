"""Names that meet in a piece: compared where they meet, with nothing lost against scoring every pair."""

import random

import pytest

from tidewater.operators import matching as M


def made(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(2, 7))) for _ in range(40)]
    names = {" ".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(n)}
    return sorted(names | {x[:2] + x[3:] for x in names})


@pytest.mark.parametrize("cells", [1, 64, 1 << 20])
def test_letters_leave_out_no_pair_that_counts(cells):
    a, b = made(60, 1), made(60, 2)
    kept = list(M.alike_letters(M.letters(a), M.letters(b), 84.0, cells))
    assert len(set(kept)) == len(kept) < len(a) * len(b)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            both = set(x.split()) & set(y.split())
            assert both or M.set_ratio(x, y) < 84 or (i, j) in kept


@pytest.mark.parametrize("cells", [3, 1 << 21])
def test_matches_are_the_best_of_all_scored_candidates(spark, cells, monkeypatch):
    side = lambda seed: spark.createDataFrame(list(enumerate(made(120, seed))), "id long, norm string")
    q, r = side(3), side(4)
    r = r.join(q.select("norm"), "norm", "left_anti").select("id", "norm")
    plain = M.near_by_pieces
    monkeypatch.setattr(M, "near_by_pieces", lambda x, y, least: plain(x, y, least, cells))
    want = {}
    for x in M.scored(M.candidates(q, r)).collect():
        if x.score >= M.LEAST_SCORE:
            want[x.query_norm] = min(want.get(x.query_norm, (0, 0)), (-round(x.score, 9), x.match)) if x.query_norm in want else (-round(x.score, 9), x.match)
    got = {x.query_norm: (-round(x.score, 9), x.match) for x in M.near_matches(q, r, M.LEAST_SCORE, 10, 4).collect()}
    assert want and got == want


def test_pairs_that_cannot_count_are_not_scored(spark):
    pairs = [(i, x, j, y) for i, x in enumerate(made(50, 5)) for j, y in enumerate(made(50, 6))]
    df = spark.createDataFrame(pairs, "query long, query_norm string, match long, match_norm string")
    want = {(i, j): s for i, x, j, y in pairs if (s := M.set_ratio(x, y)) >= 84}
    got = {(r["query"], r["match"]): r["score"] for r in M.scored(df, 84.0).collect()}
    assert {k: v for k, v in got.items() if v >= 84} == want and len(got) < len(pairs) / 2
