"""Kernels against definitions, other implementations in the JVM, and the distributed forms."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lacuna.functions import kernels as K
from lacuna.functions import special as S
from lacuna.functions.order import average_ranks, quantiles
from lacuna.operators import comparisons as C

small = st.lists(st.integers(-5, 5).map(float), min_size=1, max_size=12)


def test_tails_against_the_jvm(spark):
    d = spark._jvm.org.apache.commons.math3.distribution
    for df in (1, 2, 5, 30):
        for x in (0.1, 1.0, 3.84, 20.0):
            assert S.chi2_sf(x, df) == pytest.approx(1 - d.ChiSquaredDistribution(float(df)).cumulativeProbability(x), abs=1e-10)
            assert S.t_sf(x, df) == pytest.approx(1 - d.TDistribution(float(df)).cumulativeProbability(x), abs=1e-10)
            assert S.f_sf(x, df, 7) == pytest.approx(1 - d.FDistribution(float(df), 7.0).cumulativeProbability(x), abs=1e-9)
    assert S.t_ppf(0.975, 10) == pytest.approx(2.228139, abs=1e-5)
    assert S.studentized_range_sf(3.314493, 3) == pytest.approx(0.05, abs=1e-4)  # tabled, infinite degrees of freedom


@given(small, small)
@settings(max_examples=60, deadline=None)
def test_dominance_by_definition(x, y):
    sign = [[(a > b) - (a < b) for b in y] for a in x]
    d = np.mean(sign)
    c = K.cliffs_delta(x, y)
    assert c["delta"] == pytest.approx(d)
    m = K.mann_whitney(x, y)
    assert m["rank_biserial"] == pytest.approx(d) and 0 <= m["p_value"] <= 1
    if c["low"] is not None:
        assert -1 <= c["low"] <= c["high"] + 1e-12 <= 1 + 1e-9
    h = K.hodges_lehmann(x, y)
    assert h["shift"] == pytest.approx(np.median([a - b for a in x for b in y])) and h["low"] <= h["shift"] <= h["high"]


def test_exact_mann_whitney():
    assert K.mann_whitney([1, 2, 3], [4, 5, 6])["p_value"] == pytest.approx(0.1)
    assert K.mann_whitney([1, 5], [2, 3, 4])["p_value"] == pytest.approx(1.0)


def test_published_values():
    # Shapiro and Wilk (1965), weights of eleven men
    w = K.shapiro_wilk([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
    assert w["w"] == pytest.approx(0.7888, abs=2e-4) and w["p_value"] == pytest.approx(0.0067, abs=3e-4)
    assert K.kruskal([[1, 2, 3], [4, 5, 6], [7, 8, 9]])["h"] == pytest.approx(7.2)
    assert K.benjamini_hochberg([0.01, 0.04, 0.03, None]) == [pytest.approx(0.03), pytest.approx(0.04), pytest.approx(0.04), None]
    assert K.chi2_2x2(10, 0, 0, 0)["chi2"] is None
    t = K.t_test([1, 2, 3, 4], [2, 3, 4, 5])
    assert t["equal_var"] and t["t"] == pytest.approx(-1.095445, abs=1e-5) and t["p_value"] == pytest.approx(0.315328, abs=1e-5)


def test_normality_of_normal_and_other_rows():
    rng = np.random.default_rng(1)
    assert K.henze_zirkler(rng.normal(size=(300, 3)))["p_value"] > 0.01
    assert K.henze_zirkler(rng.exponential(size=(300, 3)))["p_value"] < 1e-6
    assert K.shapiro_wilk(rng.normal(size=500))["p_value"] > 0.01


def test_little_on_a_well_conditioned_set():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 2))
    gone = rng.random(4000) < 0.3
    own = [((0, 0), int((~gone).sum()), x[~gone].mean(axis=0).tolist()), ((0, 1), int(gone.sum()), [x[gone, 0].mean(), None])]
    r = K.little_mcar(own, x[~gone].mean(axis=0), np.cov(x[~gone].T), 4000)
    assert r["df"] == 1 and r["p_value"] > 0.01
    biased = x[:, 0] > 0.8
    own = [((0, 0), int((~biased).sum()), x[~biased].mean(axis=0).tolist()), ((0, 1), int(biased.sum()), [x[biased, 0].mean(), None])]
    assert K.little_mcar(own, x[~biased].mean(axis=0), np.cov(x[~biased].T), 4000)["p_value"] < 1e-6


def test_bootstrap_does_not_depend_on_order():
    a, b = [1.0, 5, 3, 9], [2.0, 8, 4]
    eta = lambda g: K.kruskal(g)["eta_squared"]
    assert K.bootstrap([a, b], eta, 50) == K.bootstrap([a[::-1], b[::-1]], eta, 50)


@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(3)
    data = [(k, g, float(rng.choice([rng.randint(-3, 3), rng.gauss(0, 5)]))) for k in "pq" for g in range(3) for _ in range(rng.randint(40, 90))]
    return data, spark.createDataFrame(data, "facet string, g long, v double").repartition(5).persist()


def test_distributed_forms_equal_kernels(mixed):
    data, df = mixed
    two = df.where("g < 2").selectExpr("facet", "v", "g = 0 as first")
    for r in C.mann_whitney(two, ["facet"], "v", "first").collect():
        x, y = ([v for k, g, v in data if k == r["facet"] and g == w] for w in (0, 1))
        want = K.mann_whitney(x, y)
        assert r["u"] == pytest.approx(want["u"]) and r["p_value"] == pytest.approx(want["p_value"], abs=1e-9)
    for r in C.cliffs_delta(two, ["facet"], "v", "first").collect():
        x, y = ([v for k, g, v in data if k == r["facet"] and g == w] for w in (0, 1))
        want = K.cliffs_delta(x, y)
        assert (r["delta"], r["low"], r["high"]) == (pytest.approx(want["delta"]), pytest.approx(want["low"]), pytest.approx(want["high"]))
    for r in C.kruskal_wallis(df, ["facet"], "v", "g").collect():
        want = K.kruskal([[v for k, g, v in data if k == r["facet"] and g == w] for w in range(3)])
        assert r["h"] == pytest.approx(want["h"]) and r["p_value"] == pytest.approx(want["p_value"])


def test_ranks_and_quantiles(mixed):
    data, df = mixed
    for r in quantiles(df, ["facet"], "v", {"a": 0.0, "b": 0.37, "c": 1.0}).collect():
        own = [v for k, _, v in data if k == r["facet"]]
        assert [r["a"], r["b"], r["c"]] == pytest.approx(np.quantile(own, [0, 0.37, 1]).tolist())
    got = {(r["facet"], r["v"]): r["rank"] for r in average_ranks(df, ["facet"], "v").collect()}
    for k in "pq":
        own = np.array([v for x, _, v in data if x == k])
        for v, rank in zip(own, K.average_rank(own)):
            assert got[(k, v)] == rank


def test_auc_and_pair_budget():
    assert K.auc([0, 0, 1, 1], [0.1, 0.4, 0.35, 0.8]) == pytest.approx(0.75)
    x, y = K.pair_budget(np.arange(1000.0), np.arange(2000.0), 10_000)
    assert len(x) * len(y) <= 10_000 and math.isclose(len(y) / len(x), 2, rel_tol=0.1)
