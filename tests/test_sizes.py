"""What larger tables showed: results to the last bit as the SQL gives them, and memory or work that grows with the rows only."""

import tracemalloc

import numpy as np
import pytest

from lacuna.functions import kernels as K
from lacuna.functions import rankpairs
from lacuna.functions import ranksums as R
from lacuna.operators import comparisons as C
from lacuna.operators import groups, values
from lacuna.operators.panel import Panel
from lacuna.queries import tidy


def test_whiskers_and_rounding_as_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    v = [[1.1, 3.8, 4.3, 5.0], [3.7, 4.6, 4.8, 4.9], [1.2, 1.5, 2.1, 3.2, 3.4, 5.9]]
    long = spark.createDataFrame([("a", "all", "m", str(g), x) for g, xs in enumerate(v) for x in xs], "aspect string, variable string, metric string, group string, value double")
    got = {r["group"]: (r["whisker_low"], r["whisker_high"]) for r in groups.describe_groups(long).collect()}
    con = duckdb.connect()
    for g, xs in enumerate(v):
        sql = "WITH x AS (SELECT unnest(?::DOUBLE[]) AS v), q AS (SELECT quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b FROM x) SELECT min(v), max(v) FROM x, q WHERE v BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)"
        assert got[str(g)] == con.execute(sql, [xs]).fetchone()
    halves = [(2 * k + 1) * 5e-7 for k in range(0, 40000, 7)] + [1e300, -2.5e-7, -0.0000005, float("inf"), float("nan"), None]
    rounded = [r["x"] for r in tidy(spark.createDataFrame([(i, x) for i, x in enumerate(halves)], "i int, x double")).orderBy("i").collect()]
    want = [r[0] for r in con.execute("SELECT round(x, 6) + 0.0 FROM (SELECT unnest(?::DOUBLE[]) AS x)", [halves]).fetchall()]
    assert [repr(x) for x in rounded] == [repr(x) for x in want]


def test_hodges_lehmann_of_all_pairs():
    rng = np.random.default_rng(5)
    for size in (1, 7, 60):
        for make in (rng.normal, lambda size: rng.integers(0, 4, size) / 10):
            x, y = make(size=size), make(size=size + 2)
            d, found = np.sort((x[:, None] - y[None, :]).ravel()), K.Differences(np.sort(x), np.sort(y))
            K.LISTED_PAIRS, kept = 3, K.LISTED_PAIRS
            try:
                assert [found.ranked(k) for k in range(len(d))] == d.tolist()
            finally:
                K.LISTED_PAIRS = kept
    x = np.arange(20_000) * 1.0  # 400 million pairs: all count, and no list of them is made
    tracemalloc.start()
    assert K.hodges_lehmann(x, x + 3)["shift"] == -3.0
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150_000_000


def _panel(spark, n=400):
    """Ids of 1 to 40 rows, masks with nulls, values with ties, nulls and a NaN."""
    rng, rows = np.random.default_rng(8), []
    for i in range(n):
        id_, m = int(i**0.8), rng.integers(0, 3, 2)
        rows.append((id_, i, [None, float(rng.integers(0, 9)), float("nan") if i == 7 else float(rng.normal())][rng.integers(0, 3)], float(rng.integers(0, 3)), *(None if x == 2 else int(x) for x in m)))
    df = spark.createDataFrame(rows, "id long, clock long, a double, b double, a_mask int, b_mask int")
    return rows, Panel.of(df, cols=["a", "b"])


def _by_pairs(first, rest):
    """Rank-biserial of all pairs."""
    d = np.sign(np.array(first)[:, None] - np.array(rest)[None, :])
    return d.mean() if d.size else None


def test_lagged_ranks_without_a_row_for_each_lag(spark):
    rows, p = _panel(spark)
    found = C.rank_biserial_by_lag(p, 17)  # 35 cells: more than one code
    plan = found._jdf.queryExecution().toString()
    assert "Generate" not in plan and "explode" not in plan
    got = {(r["x"], r["y"], r["lag"]): (r["n1"], r["n0"], r["rank_biserial"]) for r in found.collect()}
    want = {}
    for x, y, value, mask in (("a", "b", 3, 4), ("b", "a", 2, 5)):
        seen = [r for r in rows if r[value] is not None]
        for k in range(-17, 18):
            sides = ([], [])
            for i, r in enumerate(seen):
                if 0 <= i - k < len(seen) and seen[i - k][0] == r[0] and seen[i - k][mask] is not None and r[value] == r[value]:
                    sides[seen[i - k][mask]].append(r[value])
            if sides[0] or sides[1]:
                want[x, y, k] = (len(sides[1]), len(sides[0]), _by_pairs(sides[1], sides[0]))
    assert got.keys() == want.keys()
    for k, (n1, n0, r) in want.items():
        assert got[k][:2] == (n1, n0) and (got[k][2] is None) == (r is None) and (r is None or abs(got[k][2] - r) < 1e-12), k


def test_many_equal_values_travel_as_totals():
    g = R.Gathered(0, 1, np.array([1.0, 2.0]))
    v = np.r_[np.full(50_000, 1.0), np.arange(3.0), np.full(63, 2.5)]
    rows = g.add(v, np.full((len(v), 1), R.ONE)) + g.deal()
    assert sum(len(r[2]) for r in rows) // 8 == 2 + 63  # one of the three ties with the many
    assert sum(np.frombuffer(r[5], dtype=np.int64)[0] for r in rows if r[5]) == 50_001


def test_logistic_fits_add_up_both_models_in_a_pass(spark):
    """The slope vanishes at the fit, also where a feature parts the classes or is constant; areas are those of all pairs, ties by half."""
    rng = np.random.default_rng(3)
    x = np.stack([rng.integers(-2, 3, 600) / 2.0, np.zeros(600), rng.normal(size=600).round(1)])
    label = (rng.random(600) < 1 / (1 + np.exp(0.4 - 0.8 * x[0] + 0.5 * x[2]))).astype(float)
    for y in (label, (x[2] > 0.25).astype(float)):
        rows = spark.createDataFrame([(float(a), *map(float, b)) for a, b in zip(y, x.T)], "label double, a double, b double, c double").repartition(5)
        fits = C.logistic(rows, [2, 3], 600, y.sum(), 1e-6)
        for ll, b in fits:
            own = np.stack([np.ones(600), *x[: len(b) - 1]])
            q = 1 / (1 + np.exp(-(b @ own)))
            assert np.abs(own @ (y - q) - np.r_[0.0, np.full(len(b) - 1, 1e-6)] * b).max() < 1e-4
            kept = np.clip(q, 1e-12, 1 - 1e-12)
            assert abs(ll - (y * np.log(kept) + (1 - y) * np.log(1 - kept)).sum()) < 1e-6
        for area, (_, b) in zip(C._areas(rows, [b for _, b in fits], 600, y.sum()), fits):
            _, q = K.logit_parts(b, np.stack([np.ones(600), *x]))
            q = np.clip(q, 1e-12, 1 - 1e-12)
            assert abs(area - (_by_pairs(q[y == 1], q[y == 0]) + 1) / 2) < 1e-12


@pytest.mark.parametrize("rows", [20_000, 15])
def test_rank_correlations_of_pairs_at_once(spark, monkeypatch, rows):
    """As ranks of the complete rows have them, with few buckets and with many, ties, a value that most rows have, a constant, nulls and a NaN."""
    monkeypatch.setattr(rankpairs, "BUCKET_ROWS", rows)
    rng = np.random.default_rng(2)
    a = rng.normal(size=700)
    x = np.stack([a, np.where(rng.random(700) < 0.9, 1.0, a.round(1)), (a + rng.normal(size=700)).round(1), rng.integers(0, 3, 700) / 1.0, np.full(700, 4.0)])
    gone = rng.random(x.shape) < 0.2
    rows_ = [tuple(None if g else float("nan") if i == 9 else float(v) for v, g in zip(xs, gs)) for i, (xs, gs) in enumerate(zip(x.T, gone.T))]
    rows_ += [(None, None, None, None, None, 1.0), (None, None, None, None, None, 2.0)]
    df = spark.createDataFrame([r if len(r) == 6 else (*r, None) for r in rows_], "a double, b double, c double, d double, e double, f double").repartition(3)
    names = df.columns
    found = {(x, y): (n, r) for x, y, n, r in values.rank_correlations(df, [(x, y) for i, x in enumerate(names) for y in names[i + 1 :]])}
    assert not any("f" in k for k in found) and len(found) == 10  # no complete rows: no result, as before

    def ranks(v):
        _, at, n = np.unique(v, return_inverse=True, return_counts=True)
        return (np.cumsum(n) - n + (n + 1) / 2)[at]

    gone[:, 9] = True
    for i in range(5):
        for j in range(i + 1, 5):
            both = ~gone[i] & ~gone[j]
            n, r = found[names[i], names[j]]
            assert n == both.sum()
            if j == 4:
                assert r is None
            else:
                assert abs(r - np.corrcoef(ranks(x[i][both]), ranks(x[j][both]))[0, 1]) < 1e-12


def test_a_value_that_most_rows_have_is_dealt_nowhere(spark, monkeypatch):
    """Its rank follows from totals, so its rows do not meet in one task."""
    kept = []
    monkeypatch.setattr(rankpairs, "stored", lambda df, name: kept.append(df) or df)
    df = spark.createDataFrame([(float(i) if i % 10 == 0 else 0.5, float(i % 7)) for i in range(5000)], "a double, b double").repartition(4)
    monkeypatch.setattr(rankpairs, "BUCKET_ROWS", 20)
    assert rankpairs.rank_correlations(df, [(0, 1)])[0][0] == 5000
    assert sum(len(r["a"]) // 8 for r in kept[1].where(f"side <> {rankpairs.SUMS}").collect()) <= 500
