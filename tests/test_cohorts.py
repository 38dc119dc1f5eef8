"""Two-sample tests against their kernels; scores, folds, returns and grids against plain Python."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.functions import kernels as K
from lacuna.operators import cohorts, evaluation, strata, values
from lacuna.operators import comparisons as C
from lacuna.operators.panel import Panel


@pytest.fixture(scope="module")
def sides(spark):
    rng = np.random.default_rng(1)
    rows = [("a", g, float(np.round(rng.normal(g, 1 + g), 1))) for g in (0, 1, 2) for _ in range(30 + 7 * g)] + [("b", 0, 1.0), ("b", 1, 2.0), ("b", 1, None)]
    return rows, spark.createDataFrame(rows, "f string, g int, v double")


def test_t_test_is_the_kernel(sides):
    rows, df = sides
    got = {r["f"]: r for r in C.t_test(df.where("g < 2").withColumn("first", F.col("g") == 0), ["f"], "v", "first").collect()}
    want = K.t_test(*([v for k, g, v in rows if k == "a" and g == i] for i in (0, 1)))
    assert set(got) == {"a"}  # b has one value a side
    for c in ("t", "p_value", "low", "high", "cohens_d"):
        assert got["a"][c] == pytest.approx(want[c])
    assert got["a"]["equal_var"] == want["equal_var"]
    twin = df.where("f = 'a' and g < 1").crossJoin(df.sparkSession.createDataFrame([(True, 0.0), (False, 1.0)], "first boolean, up double")).withColumn("v", F.col("v") + F.col("up"))
    own = C.t_test(twin, [], "v", "first").collect()[0]
    base = np.array([v for k, g, v in rows if k == "a" and g == 0])
    assert own["equal_var"] and own["t"] == pytest.approx(K.t_test(base, base + 1)["t"])


def test_brown_forsythe_and_dunn_are_the_kernels(sides):
    rows, df = sides
    groups = [[v for k, g, v in rows if k == "a" and g == i] for i in (0, 1, 2)]
    got = {r["f"]: r for r in C.brown_forsythe(df, ["f"], "v", "g").collect()}
    want = K.levene(groups)
    assert (got["a"]["w"], got["a"]["p_value"]) == (pytest.approx(want["w"]), pytest.approx(want["p_value"])) and got["b"]["w"] is None
    pairs = {(r["group_a"], r["group_b"]): (r["z"], r["p_value"]) for r in C.dunn(df.where("f = 'a'"), ["f"], "v", "g").collect()}
    for i, j, z, p in K.dunn(groups):
        assert pairs[i, j] == (pytest.approx(z), pytest.approx(p))


def test_scores(spark):
    rng = np.random.default_rng(2)
    rows = [(int(rng.random() < 0.4), float(np.round(rng.random(), 1))) for _ in range(200)]
    r = evaluation.scores(spark.createDataFrame([*rows, (None, 0.5), (1, None)], "y int, s double"), [], "y", "s").collect()[0]
    y, s = np.array(rows).T
    assert r["n"] == 200 and r["n_positive"] == y.sum()
    assert r["auroc"] == pytest.approx(np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]]))
    ap, before = 0.0, 0
    for t in sorted(set(s), reverse=True):
        tp = (y[s >= t] == 1).sum()
        ap += (tp - before) / y.sum() * tp / (s >= t).sum()
        before = tp
    assert r["auprc"] == pytest.approx(ap) and r["brier"] == pytest.approx(np.mean((s - y) ** 2))
    one = evaluation.scores(spark.createDataFrame([(1, 0.5), (1, 0.7)], "y int, s double"), [], "y", "s").collect()[0]
    assert one["auroc"] is None and one["auprc"] is None and one["brier"] == pytest.approx((0.25 + 0.09) / 2)


def test_folds_keep_ids_together_and_thresholds_apart(spark):
    df = spark.createDataFrame([(i % 40, float(i % 7), float(i % 5)) for i in range(200)], "id long, x double, y double")
    f = evaluation.folds(df, "id", 4)
    assert f.groupBy("id").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0
    rows = [(i, i % 2, float(i), float(-i)) for i in range(10)]
    got = {r["fold"]: r["threshold_x"] for r in evaluation.train_only_strata(spark.createDataFrame(rows, "id int, fold int, x double, y double"), "x", "y").collect()}
    assert got == {0: 5.0, 1: 4.0}


def test_returns_within(spark):
    day, t0 = dt.timedelta(days=1), dt.datetime(2024, 1, 1)
    stays = [(1, 0, 1), (1, 1, 2), (1, 5, 6), (1, 20, 21), (2, 0, 9), (2, 3, 4), (2, 12, 13), (3, 0, 1)]
    df = spark.createDataFrame([(i, t0 + a * day, t0 + b * day) for i, a, b in stays], "id int, start timestamp_ntz, end timestamp_ntz")
    got = sorted((r["id"], (r["start"] - t0).days, r["returned"]) for r in cohorts.returns_within(df, "id", "start", "end", 3 * 86400).collect())
    want = sorted((i, a, any(j == i and b <= c <= b + 3 for j, c, _ in stays)) for i, a, b in stays)
    assert got == want


def test_upsample_and_common_ids(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, t0 + dt.timedelta(minutes=m), v) for m, v in ((0, None), (10, None), (35, 2.0), (50, 3.0), (130, None), (185, 5.0))] + [(2, t0, None)]
    df = spark.createDataFrame(rows, "id int, clock timestamp_ntz, v double")
    both = [r["v"] for r in cohorts.upsample(df, "id", "clock", ["v"]).where("id = 1").orderBy("step").collect()]
    forward = [r["v"] for r in cohorts.upsample(df, "id", "clock", ["v"], backward=False).where("id = 1").orderBy("step").collect()]
    assert both == [3.0, 3.0, 3.0, 3.0, 3.0, 3.0, 5.0] and forward == [None, 3.0, 3.0, 3.0, 3.0, 3.0, 5.0]
    assert [r["id"] for r in cohorts.common_ids([df, df.where("v is not null"), df.limit(7)], "id").collect()] == [1]


def test_histogram_and_own_strata(spark):
    p = Panel.of(spark.createDataFrame([(1, i, float(i), 7.0) for i in range(11)], "id int, clock int, v double, w double"))
    got = {(r["variable"], r["bin"]): r["n"] for r in values.histogram(p, 5).collect()}
    assert got == {("v", 0): 2, ("v", 1): 2, ("v", 2): 2, ("v", 3): 2, ("v", 4): 3, ("w", 0): 11}
    df = spark.createDataFrame([(i, float(i), float((i * 7) % 10)) for i in range(10)], "id int, a double, b double")
    out = strata.fit_and_stratify(df, ["a", "b"], ("a", "b"), lambda d, axes: F.when(F.col(axes.x) > axes.x_threshold, "up").otherwise("down"))
    assert {r["stratum"] for r in out.collect()} == {"up", "down"}
    assert {r["stratum"] for r in strata.fit_and_stratify(df, ["a", "b"], ("a", "b")).collect()} <= {strata.ALPHA, strata.BETA, strata.GAMMA, strata.DELTA}


def test_scratch_deletes_what_is_written_inside(spark, tmp_path):
    from lacuna.sources.store import cut, scratch, stored

    kept, at = cut(spark.range(3), "outside")
    with scratch(spark):
        _, gone = cut(spark.range(3), "inside")
        assert stored(spark.range(5), "inside").count() == 5
    assert kept.count() == 3
    from pathlib import Path

    assert Path(at.removeprefix("file://")).exists() and not Path(gone.removeprefix("file://")).exists()
