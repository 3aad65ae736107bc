import pytest
import yaml
from pyspark.sql import functions as F

from freshet.operators.temporal import build_features, chronological_split, engineer_flood_features, extract_xy
from freshet.plans.model import FloodModel, build_model_from_config
from freshet.plans.training import check_columns, compare_flood_baselines, format_comparison_report, main, run_training, train_on_features
from freshet.sources.sensor import generate_synthetic_sensor_data, load_sensor_csv

SMALL = {"n_estimators": 3, "max_depth": 2, "subsample": 0.8, "min_samples_split": 10, "random_state": 42}


@pytest.fixture(scope="module")
def series(spark):
    df = engineer_flood_features(generate_synthetic_sensor_data(spark, 300), time_col="timestamp").cache()
    train, _, test = chronological_split(df, "2023-01-10", time_col="timestamp")
    return train, test


@pytest.fixture(scope="module")
def fitted(series):
    xy = extract_xy(series[0], time_col="timestamp")
    features = [c for c in xy.columns if c not in ("timestamp", "label")]
    return FloodModel("gradient_boosting", SMALL).fit(xy, features, order=["timestamp"])


def test_guards():
    with pytest.raises(ValueError, match="Unsupported model kind"):
        FloodModel("forest")
    with pytest.raises(RuntimeError, match="not fitted"):
        FloodModel("gradient_boosting").predict(None)
    with pytest.raises(FileNotFoundError):
        FloodModel.load("/nowhere/model")
    assert build_model_from_config({"model": {"kind": "gradient_boosting", "gradient_boosting": SMALL}}).params == SMALL


def test_predict_importance_and_persistence(spark, series, fitted, tmp_path):
    test = extract_xy(series[1], time_col="timestamp")
    rows = fitted.predict(test).collect()
    assert len(rows) == test.count() and all(r["predicted"] >= 0 for r in rows)
    top = fitted.feature_importance(spark, 5).collect()
    assert len(top) == 5 and [r["importance"] for r in top] == sorted((r["importance"] for r in top), reverse=True)
    again = FloodModel.load(fitted.save(str(tmp_path), "flood"))
    assert [r["predicted"] for r in again.predict(test).orderBy("timestamp").collect()] == [r["predicted"] for r in sorted(rows, key=lambda r: r["timestamp"])]


def test_same_seed_same_model_whatever_the_partitioning(series, fitted):
    xy = extract_xy(series[0], time_col="timestamp")
    other = FloodModel("gradient_boosting", SMALL).fit(xy.repartition(7), fitted.features, order=["timestamp"])
    test = extract_xy(series[1], time_col="timestamp").orderBy("timestamp")
    assert [r["predicted"] for r in fitted.predict(test).collect()] == [r["predicted"] for r in other.predict(test).collect()]


def test_comparison(series):
    report = compare_flood_baselines(*series, validated_threshold_m=3.8, gb_params=SMALL, xgb_params={"n_estimators": 3}, time_col="timestamp")
    assert "RMSE" in report["models"]["xgboost"]
    assert {"RMSE", "MAE", "R2", "NSE", "event_metrics"} <= set(report["models"]["gradient_boosting"])
    assert "xgboost" in report["models"] and "gradient_boosting" in format_comparison_report(report)
    empty = compare_flood_baselines(series[0], series[1].limit(0), time_col="timestamp")
    assert "warning" in empty and not empty["models"]


def two_stations(spark, tmp_path):
    """A file of two stations with interleaved rows: (path of the data, config, path of the config)."""
    one, two = (generate_synthetic_sensor_data(spark, 300, seed=s).withColumn("station", F.lit(n)) for n, s in (("7", 1), ("8", 2)))
    data = tmp_path / "two.csv"
    one.union(two.withColumn("water_level_m", F.col("water_level_m") + 100)).orderBy("timestamp", "station").toPandas().to_csv(data, index=False)
    cfg = {
        "experiment": {"name": "two", "seed": 1}, "data": {"input_path": str(data), "key_cols": ["station"]}, "split": {"train_end": "2023-01-10"},
        "features": {"lag_hours": [1], "rolling_sum_windows": [3], "dynamic_sensor_cols": ["water_level_m"]},
        "model": {"kind": "gradient_boosting", "gradient_boosting": SMALL}, "artifacts": {k: str(tmp_path / k) for k in ("model_dir", "metrics_dir", "configs_dir")},
    }
    path = tmp_path / "two.yaml"
    path.write_text(yaml.dump(cfg))
    return data, cfg, path


def test_stations_stay_apart(spark, tmp_path):
    data, cfg, path = two_stations(spark, tmp_path)
    df = load_sensor_csv(spark, str(data), keys=["station"])
    assert dict(df.dtypes)["station"] == "string"
    lags = build_features(df, cfg, "timestamp", ["station"]).where("water_level_m_lag_1 IS NOT NULL")
    assert lags.where(F.abs(F.col("water_level_m_lag_1") - F.col("water_level_m")) > 50).count() == 0
    assert lags.count() == 2 * 299
    out = run_training(spark, str(path))
    assert "station" not in out["metadata"]["feature_names"] and out["metadata"]["n_train"] == out["metadata"]["n_train"] // 2 * 2
    saved = spark.read.csv(str(tmp_path / "metrics_dir" / "two_predictions.csv"), header=True)
    assert saved.columns[0] == "station" and saved.select("station").distinct().count() == 2
    assert saved.where(F.abs(F.col("observed").cast("double") - F.col("predicted").cast("double")) > 50).count() == 0
    direct = train_on_features(spark, str(data), str(path), str(tmp_path / "direct2"))
    assert direct["metrics"]["RMSE"] > 0
    assert run_training(spark, str(path), keys=["station"])["metrics"]["RMSE"] == out["metrics"]["RMSE"]


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    data, cfg, path = two_stations(spark, tmp_path)
    monkeypatch.setattr("freshet.session.build_session", lambda *a, **k: spark)
    assert main(["--config", str(path)]) == 0
    assert capsys.readouterr().out.strip().splitlines()[-1].endswith("two_metrics.json")
    assert main(["--config", str(path), "--data", str(data), "--artifact-dir", str(tmp_path / "cli")]) == 0
    with pytest.raises(SystemExit):
        main([])


def test_xgboost_parameters_and_early_stopping(spark, series, tmp_path):
    train, test = (extract_xy(d, time_col="timestamp") for d in series)
    features = [c for c in train.columns if c not in ("timestamp", "label")]
    given = {"n_estimators": 6, "max_depth": 2, "reg_alpha": 0.1, "gamma": 0.01, "n_jobs": 4, "objective": "reg:squarederror", "early_stopping_rounds": 1, "random_state": 1}
    alone, stopped = FloodModel("xgboost", given).fit(train, features), FloodModel("xgboost", given).fit(train, features, train.withColumn("label", -F.col("label")))
    assert len(alone.model.trees) == 6 and len(stopped.model.trees) == 0
    assert alone.predict(test).where("predicted < 0").count() == 0
    again = FloodModel.load(alone.save(str(tmp_path), "flood"))
    assert again.model.nodes(spark).collect() == alone.model.nodes(spark).collect()
    for r in alone.explain(alone.predict(test, clip_negative=False)).collect():
        assert r["expected"] + sum(r["attributions"].values()) == pytest.approx(r["predicted"], abs=1e-9)
    for other in ({"objective": "reg:absoluteerror"}, {"loss": "huber"}):
        with pytest.raises(ValueError):
            FloodModel("xgboost", other)


def test_training_run(spark, tmp_path):
    data = tmp_path / "s.csv"
    generate_synthetic_sensor_data(spark, 300).toPandas().to_csv(data, index=False)
    cfg = {
        "experiment": {"name": "t", "seed": 1}, "data": {"input_path": str(data)}, "split": {"train_end": "2023-01-10"},
        "features": {"lag_hours": [1], "rolling_sum_windows": [3], "dynamic_sensor_cols": ["water_level_m"]},
        "model": {"kind": "gradient_boosting", "gradient_boosting": SMALL}, "evaluation": {"classification_metrics": []},
        "artifacts": {k: str(tmp_path / k) for k in ("model_dir", "metrics_dir", "configs_dir")},
    }
    path = tmp_path / "c.yaml"
    path.write_text(yaml.dump(cfg))
    out = run_training(spark, str(path))
    assert out["metrics"]["RMSE"] > 0 and (tmp_path / "metrics_dir" / "t_metrics.json").exists()
    direct = train_on_features(spark, str(data), str(path), str(tmp_path / "direct"))
    assert direct["metrics"]["RMSE"] > 0 and spark.read.csv(direct["importance_path"], header=True).columns == ["feature", "importance"]
    cfg["split"]["val_end"], cfg["hyperopt"] = "2023-01-12", {"enabled": True, "max_evals": 2}
    path.write_text(yaml.dump(cfg))
    searched = run_training(spark, str(path))["model"]
    assert searched.params["max_depth"] != SMALL["max_depth"] or searched.params["subsample"] != SMALL["subsample"]
    cfg["data"]["input_path"] = None
    path.write_text(yaml.dump(cfg))
    with pytest.raises(SystemExit):
        run_training(spark, str(path))
    with pytest.raises(SystemExit):
        check_columns(spark, str(data), "absent")
