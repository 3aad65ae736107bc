import math

import pytest

from freshet.functions import metrics as m

OBS = [0, 0, 5, 4, 3.5, 1, 6, 0.5]
PRED = [0, 3, 5, 4, 1, 0.5, 6, 0.3]


def pairs(spark, pred, obs):
    return spark.createDataFrame([(None if p is None else float(p), None if o is None else float(o)) for p, o in zip(pred, obs, strict=True)], "pred double, obs double")


def test_contingency_and_scores(spark):
    r = m.event_metrics(pairs(spark, PRED, OBS), 2.0).first()
    assert (r["TP"], r["FP"], r["FN"], r["TN"]) == (3, 1, 1, 3)
    assert (r["POD"], r["FAR"], r["CSI"], r["precision"], r["F1"], r["recall"]) == (0.75, 0.25, 0.6, 0.75, 0.75, 0.75)


@pytest.mark.parametrize("pred,obs,want", [([3, 3, 3, 0], [3, 3, 3, 0], (3, 0, 0, 1)), ([3, 0, 0], [0, 0, 0], (0, 1, 0, 2)), ([0, 0, 0], [3, 3, 3], (0, 0, 3, 0)), ([float("nan"), 3], [3, None], (0, 1, 1, 0))])
def test_contingency_cases(spark, pred, obs, want):
    r = m.event_metrics(pairs(spark, pred, obs), 2.0).first()
    assert (r["TP"], r["FP"], r["FN"], r["TN"]) == want


def test_zero_denominators(spark):
    df = pairs(spark, [0, 0], [0, 0])
    r = m.event_metrics(df, 2.0).first()
    assert [r[k] for k in ("POD", "FAR", "CSI", "precision", "F1")] == [None] * 5
    assert m.event_metrics(df, 2.0, on_zero="zero").first()["CSI"] == 0.0


def test_regression(spark):
    df = pairs(spark, [1, 2, 4, None, 9], [1, 3, 5, 7, float("nan")])
    r = m.regression_metrics(df).first()
    assert r["RMSE"] == pytest.approx(math.sqrt(2 / 3)) and r["MAE"] == pytest.approx(2 / 3) and r["ME"] == pytest.approx(-2 / 3)
    assert r["NSE"] == pytest.approx(1 - 2 / 8) and r["R2"] == pytest.approx(1 - 2 / 8)


def test_no_spread_and_no_rows(spark):
    r = m.regression_metrics(pairs(spark, [2, 2], [2, 2])).first()
    assert r["NSE"] is None and r["R2"] == 1.0
    assert m.regression_metrics(pairs(spark, [1, 2], [2, 2])).first()["R2"] == 0.0
    assert m.regression_metrics(pairs(spark, [], [])).first()["RMSE"] is None


def brute_auc(pred, obs, t):
    wins = [(p > q) + 0.5 * (p == q) for p, o in zip(pred, obs, strict=True) if o >= t for q, w in zip(pred, obs, strict=True) if w < t]
    return sum(wins) / len(wins)


@pytest.mark.parametrize("per_range", [1, 3, 1000])
def test_auc_with_ties(spark, per_range):
    pred, obs = [i % 7 for i in range(60)], [(i * 5) % 11 for i in range(60)]
    assert m.roc_auc(pairs(spark, pred, obs), 4.0, per_range=per_range).first()["roc_auc"] == pytest.approx(brute_auc(pred, obs, 4))
    assert m.roc_auc(pairs(spark, pred, obs), 99.0).first()["roc_auc"] is None
    assert m.roc_auc(pairs(spark, [], []), 1.0).first()["roc_auc"] is None


def test_evaluate(spark):
    cfg = {"experiment": {"name": "e"}, "alert": {"warning_level_m": 2.0, "danger_level_m": None}, "evaluation": {"regression_metrics": ["RMSE", "nonsense"], "classification_metrics": ["POD"]}}
    out = m.evaluate(pairs(spark, PRED, OBS), cfg)
    assert out["n_samples"] == 8 and out["warning_level_f1"] == 0.75 and "danger_level_f1" not in out and "nonsense" not in out
