"""Bootstrap intervals against the whole-sample kernel; the decomposition against series whose parts are known; one analysis a group."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.functions import kernels as K
from lacuna.functions.seasonal import stl
from lacuna.operators import comparisons as C
from lacuna.operators import resampling, timeline, values
from lacuna.plans.analyzer import Analyzer


@pytest.fixture(scope="module")
def sides(spark):
    rng = np.random.default_rng(4)
    rows = [("smooth", g, float(rng.normal(g / 2, 1))) for g in (0, 1, 2) for _ in range(120 + 30 * g)]
    rows += [("ties", g, float(rng.integers(0, 5 + g))) for g in (0, 1, 2) for _ in range(90)]
    rows += [("lone", 0, 1.0), ("lone", 0, 2.0), ("flat", 0, 3.0), ("flat", 1, 3.0), ("ties", None, 1.0), ("ties", 1, None), ("ties", 1, float("nan"))]
    return rows, spark.createDataFrame(rows, "f string, g int, v double").repartition(3)


def _groups(rows, f):
    return [[v for k, i, v in rows if k == f and i == g and v is not None] for g in (0, 1, 2)]


def test_rank_biserial_interval_is_that_of_whole_resamples(sides):
    rows, df = sides
    two = df.where("g is null or g < 2").withColumn("first", F.col("g") == 1)
    got = {r["f"]: r for r in resampling.rank_biserial_interval(two, ["f"], "v", "first", 600).collect()}
    again = {r["f"]: r for r in resampling.rank_biserial_interval(two.repartition(5), ["f"], "v", "first", 600).collect()}
    point = {r["f"]: r["rank_biserial"] for r in C.mann_whitney(two.where("v is not null and not isnan(v) and g is not null"), ["f"], "v", "first").collect()}
    for f in ("smooth", "ties"):
        a, b, _ = _groups(rows, f)
        want = K.bootstrap([b, a], lambda g: 2 * K.mann_whitney(*g)["u"] / (len(b) * len(a)) - 1, 600)
        assert got[f]["low"] == pytest.approx(want[0], abs=0.04) and got[f]["high"] == pytest.approx(want[1], abs=0.04)
        assert got[f]["low"] < point[f] < got[f]["high"] and got[f] == again[f]
    assert (got["lone"]["low"], got["lone"]["high"]) == (None, None) and (got["flat"]["low"], got["flat"]["high"]) == (0.0, 0.0)


def test_eta_squared_interval_is_that_of_whole_resamples(sides):
    rows, df = sides
    got = {r["f"]: r for r in resampling.eta_squared_interval(df, ["f"], "v", "g", 600).collect()}
    for f in ("smooth", "ties"):
        want = K.bootstrap(_groups(rows, f), lambda g: K.kruskal(g)["eta_squared"], 600)
        assert got[f]["low"] == pytest.approx(want[0], abs=0.03) and got[f]["high"] == pytest.approx(want[1], abs=0.03)
    assert got["lone"]["low"] is None and got["flat"]["low"] is None
    assert resampling.eta_squared_interval(df.where("f = 'smooth'"), [], "v", "g", 50).columns == ["low", "high"]
    assert resampling.eta_squared_interval(df.where("f = 'none'"), ["f"], "v", "g", 50).collect() == []


def test_draws_of_one_bucket_have_the_rank_sums_of_their_values():
    """Buckets and chunks add up to ranks over the whole draw."""
    import pandas as pd

    left = pd.DataFrame({"k": 1, "_b": 0, "_g": ["a", "a", "b", "b"], "_v": [1.0, 2.0, 2.0, 3.0], "n": [2, 1, 2, 1]})
    right = pd.DataFrame({"k": 1, "_b": 0, "_g": ["a", "b"], "_c": [[3, 0, 2], [3, 4, 0]]})
    out = resampling._rank_sums(left, right, ["k"], 3, 1).set_index("_g")
    for i in range(3):
        n = out["_c"]["a"][i] + out["_c"]["b"][i]
        assert out["_r"]["a"][i] + out["_r"]["b"][i] == pytest.approx(n * (n + 1) / 2)


def test_decomposition_finds_trend_and_season():
    t = np.arange(60)
    y = 0.05 * t + np.sin(2 * np.pi * t / 6)
    trend, season, rest = stl(y, 6)
    assert np.allclose(trend + season + rest, y)
    assert np.abs(trend - 0.05 * t)[6:-6].max() < 0.05 and np.abs(season - np.sin(2 * np.pi * t / 6))[6:-6].max() < 0.05
    spiked = y.copy()
    spiked[30] += 8
    robust, plain = stl(spiked, 6), stl(spiked, 6, robust=False)
    assert robust[2][30] == pytest.approx(8, abs=0.2) and robust[2][30] > plain[2][30]
    flat = stl(np.ones(12), 4)
    assert np.allclose(flat[0] + flat[1], 1)
    with pytest.raises(ValueError):
        stl(y[:11], 6)


def test_decomposed_autocorrelations_add_up_and_short_ones_go(spark):
    rows = [("long", k, float(np.cos(k))) for k in range(1, 21)] + [("short", k, 0.5) for k in range(1, 8)]
    df = spark.createDataFrame(rows, "variable string, lag int, autocorr double")
    got = timeline.decomposed(df, ["variable"], 5).collect()
    assert [r["lag"] for r in sorted(got, key=lambda r: r["lag"])] == list(range(1, 21)) and {r["variable"] for r in got} == {"long"}
    assert all(r["trend"] + r["seasonal"] + r["remainder"] == pytest.approx(np.cos(r["lag"])) for r in got)


@pytest.fixture(scope="module")
def wards(spark):
    rng, data = random.Random(3), []
    for i in range(9):
        for j in range(12):
            data.append((i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=7 * j + i), *(None if rng.random() < 0.3 else rng.gauss(50, 5) for _ in "ab"), "xyy"[i % 3]))
    return data, spark.createDataFrame(data, "id int, clock timestamp_ntz, a double, b double, ward string").persist()


def test_full_analysis_of_each_group(wards, monkeypatch):
    data, df = wards
    monkeypatch.setattr(Analyzer, "run", lambda self: self)  # its steps have tests of their own
    whole = Analyzer(df, cols=["a", "b"], save_path=None).run_grouped_analysis("ward", analysis_mode="full")
    assert list(whole.group_results) == ["y", "x"] and whole.group_results["y"].group_results == {}
    for name, g in whole.group_results.items():
        got = {r["variable"]: r["indicated_count"] for r in g.intravariable.column_statistics().results["cs_overall_statistics"].collect()}
        assert got == {v: sum(r[k] is None for r in data if r[4] == name) for v, k in (("a", 2), ("b", 3))}
        assert g.irregularity.case_metrics().results["cm_case_metrics"].count() == {"x": 3, "y": 6}[name]
    with pytest.raises(ValueError):
        whole.run_grouped_analysis("ward", analysis_mode="other")


def test_cheap_full_analysis_has_strata(wards):
    _, df = wards
    g = Analyzer(df.drop("b"), cols=["a"]).run_grouped_analysis("ward", analysis_mode="full", cheap_mode=True, top_n_groups=1).group_results
    assert set(g) == {"y"}
    for aspect in (g["y"].irregularity, g["y"].intravariable, g["y"].intervariable):
        assert "stratum" in aspect.results["cm_case_metrics"].columns


def test_pairs_of_one_variable_are_none(wards):
    _, df = wards
    p = Analyzer(df, cols=["a"]).panel
    for frame in (values.correlation_listwise(p), values.correlation_pairwise(p), C.chi2_pairs(p), timeline.lagged_cross_correlation(p, 2), C.asymmetric_matrix(p, 2), C.asymmetric_comparison(p)):
        assert frame.collect() == [] and {"x", "y"} <= set(frame.columns)
    assert [tuple(r) for r in timeline.phi_matrix(p).collect()] == [("a", "a", 1.0)]


def test_windowed_significance_has_an_interval(wards):
    _, df = wards
    one = Analyzer(df, cols=["a", "b"]).intravariable.windowed_significance(500, n_bootstrap=50)
    r = one.results["ws_mwu_result"].where("variable = 'a'").collect()[0]
    assert r["effect_low"] <= r["rank_biserial"] <= r["effect_high"]
