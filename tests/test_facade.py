"""The facade, groups, streams, writers and the driver's entry."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lacuna.operators import groups
from lacuna.plans.analyzer import Analyzer
from lacuna.plans.report import report
from lacuna.sources import io
from lacuna.streaming import streams

T0 = dt.datetime(2024, 3, 1)


@pytest.fixture(scope="module")
def cohort(spark):
    rng, data = random.Random(9), []
    for i in range(24):
        t = T0
        for _ in range(18):
            t += dt.timedelta(seconds=rng.choice([60, 120, 300, 45, 600]))
            miss = [0.05, 0.3, 0.6][i % 3]
            data.append((f"p{i:02d}", t, *(None if rng.random() < miss else rng.gauss(m + i, 5) for m in (80, 120, 15)), "abc"[i % 3]))
    return spark.createDataFrame(data, "id string, clock timestamp_ntz, heartrate double, sbp double, resprate double, ward string").persist()


VARS = ["heartrate", "sbp", "resprate"]


def test_run_and_cheap_mode(cohort):
    a = Analyzer(cohort, cols=VARS).run(cheap_mode=True)
    assert {"ins_case_statistics"} <= set(a.irregularity.results) and "mcar_little" in a.intervariable.results
    a.intravariable.case_metrics(stratify=True)
    r = a.intravariable.results["cm_case_metrics"].collect()
    assert len(r) == 72 and {x["stratum"] for x in r} <= {None, "Q_complete", "Q_alpha", "Q_beta", "Q_gamma", "Q_delta"}
    assert "cv_stratum" in a.intravariable.results["cm_cross_variable"].columns
    assert a.intervariable.summary().count() > 0


def test_groups(cohort):
    a = Analyzer(cohort, cols=VARS).run_grouped_analysis("ward", n_bootstrap=20)
    r = {(x["aspect"], x["variable"], x["metric"]): x for x in a.results["group_comparison_results"].collect()}
    x = r[("intravariable", "sbp", "indicated_pct")]
    assert x["n_groups"] == 3 and x["test"] == "Kruskal-Wallis" and x["significant"] and x["p_value"] <= x["q_value"]
    post = a.results["group_comparison_posthoc"].where("metric = 'indicated_pct' and variable = 'sbp'").collect()
    assert len(post) == 3 and all(p["delta"] < 0 for p in post)
    d = a.results["group_comparison_descriptives"].where("metric = 'indicated_pct'").collect()
    assert all(y["n"] == 8 and y["min"] <= y["whisker_low"] <= y["q25"] <= y["median"] <= y["q75"] <= y["whisker_high"] <= y["max"] for y in d)


def test_groups_are_top_n_and_one_label_per_id(spark):
    df = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x"), (3, None), (4, "z"), (5, "x")], "id int, g string")
    got = {(r["id"], r["g"]) for r in groups.annotate(df, "id", "g", top=1).collect()}
    assert got == {(1, "x"), (2, "x"), (5, "x")}


def test_cross_aspect_and_events(cohort, spark):
    a = Analyzer(cohort, cols=VARS).cross_aspect_correlation()
    r = a.results["cross_aspect_correlations"].collect()
    assert {x["kind"] for x in r} == {"within", "cross"} and all(x["correlation"] is None or -1 <= x["low"] <= x["correlation"] <= x["high"] <= 1 for x in r if x["low"] is not None)
    ev = cohort.groupBy("id").agg(F.min("clock").alias("clock"))
    a.run_event_based_analysis(ev, window_size=900)
    assert a.results["event_share"].collect()[0]["n"] == cohort.count()
    assert a.results["event_column_statistics"].count() == 3


def test_mar_mnar(cohort):
    r = {x["variable"]: x for x in Analyzer(cohort, cols=VARS).intervariable.mar_mnar_test().results["mar_mnar_results"].collect()}
    assert set(r) == set(VARS) and all(x["lrt"] >= 0 and 0 <= x["p_value"] <= 1 and 0.4 < x["auc_mnar"] <= 1 for x in r.values())


def test_validation(spark):
    df = spark.createDataFrame([(1, T0, 1.0), (1, None, 2.0)], "id int, clock timestamp_ntz, v double")
    with pytest.warns(UserWarning):
        a = Analyzer(df, cols=["v", "w", "x"])
    assert a.bare.cols == ["v"] and a.panel.df.count() == 1
    with pytest.raises(ValueError):
        Analyzer(df, imperfection="x")


def test_writers_and_report(spark, cohort, tmp_path):
    a = Analyzer(cohort, cols=VARS, save_path=str(tmp_path / "out"))
    a.intravariable.column_statistics()
    back = io.read_csv(spark, str(tmp_path / "out/intravariable/cs_overall_statistics"), "variable string, indicated_count long, indicated_pct double, non_indicated_count long")
    assert back.count() == 3
    io.write_text(back.limit(1), str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t")).count() == 4
    io.write_parquet(cohort, str(tmp_path / "p"))
    assert io.read_parquet(spark, str(tmp_path / "p"), ["id"], 5).count() == 5
    assert "<svg" in report("x", {"stats": back}) and "heartrate" in report("x", {"stats": back})


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    data = [(i % 3, T0 + dt.timedelta(seconds=60 * i), None if i % 4 == 0 else float(i)) for i in range(40)]
    spark.createDataFrame(data, "id int, clock timestamp, v double").coalesce(1).write.parquet(src)
    rows = spark.readStream.schema("id int, clock timestamp, v double").parquet(src)
    rates = streams.imperfection_rates(streams.stream_masks(rows, ["v"]), ["v"], window="10 minutes")
    for name, df, mode in (("rates", rates, "complete"), ("iv", streams.stream_intervals(rows, timeout=None), "append")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    assert spark.table("rates").agg(F.sum("v_indicated_count"), F.sum("n")).collect()[0][:] == (10, 40)
    got = [r["interval_seconds"] for r in spark.table("iv").collect()]
    assert got == [180] * 37


def test_entry_names_match():
    import __spark_entry__ as e

    q, s = e.queries(), e.oracle_sql()
    assert set(s) <= set(q) and "gap_case_metrics" in q
