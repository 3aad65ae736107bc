import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from freshet.operators import temporal as t
from freshet.sources.sensor import generate_synthetic_sensor_data

T0 = datetime(2023, 1, 1)


def frame(spark, values, column="rainfall_mm_hr"):
    return spark.createDataFrame([(T0 + timedelta(hours=i), v) for i, v in enumerate(values)], f"ts timestamp, {column} double")


def column(df, name):
    return [r[name] for r in df.orderBy("ts").collect()]


def test_lag_and_lead(spark):
    out = t.add_lag_features(frame(spark, [1.0, 2.0, 3.0]), ["rainfall_mm_hr", "absent"], [0, 1, -1])
    assert out.columns == ["ts", "rainfall_mm_hr", "rainfall_mm_hr_lag_1", "rainfall_mm_hr_lag_-1"]
    assert column(out, "rainfall_mm_hr_lag_1") == [None, 1.0, 2.0]
    assert column(out, "rainfall_mm_hr_lag_-1") == [2.0, 3.0, None]


def test_existing_lag_column_stays(spark):
    df = frame(spark, [1.0, 2.0]).withColumn("rainfall_mm_hr_lag_1", F.lit(9.0))
    assert column(t.add_lag_features(df, ["rainfall_mm_hr"], [1]), "rainfall_mm_hr_lag_1") == [9.0, 9.0]


@pytest.mark.parametrize("func,want", [("sum", [1, 3, 2, 4]), ("mean", [1, 1.5, 2, 4]), ("max", [1, 2, 2, 4]), ("min", [1, 1, 2, 4])])
def test_rolling_skips_nulls(spark, func, want):
    out = t.add_rolling_features(frame(spark, [1.0, 2.0, None, 4.0]), ["rainfall_mm_hr"], [2], func)
    assert column(out, f"rainfall_mm_hr_rolling_{func}_2") == want


def test_rolling_rejects_other_functions(spark):
    with pytest.raises(ValueError, match="Invalid aggregation function"):
        t.add_rolling_features(frame(spark, [1.0]), ["rainfall_mm_hr"], [2], "median")


def test_delta(spark):
    out = t.add_rate_of_rise(frame(spark, [1.0, 3.0, 6.0], "water_level_m"), delta_windows=[1, 2])
    assert column(out, "water_level_m_delta_1") == [None, 2.0, 3.0]
    assert column(out, "water_level_m_delta_2") == [None, None, 5.0]


def test_index_is_the_recurrence_in_both_designs(spark):
    rain = [float(i % 7) for i in range(60)]
    want, a = [], 0.0
    for i, r in enumerate(rain):
        a = r if i == 0 else 0.9 * a + r
        want.append(a)
    for method in ("scan", "grouped"):
        got = column(t.add_antecedent_precipitation_index(frame(spark, rain), method=method), "antecedent_precipitation_index")
        assert got == pytest.approx(want)


@pytest.mark.parametrize("method", ["scan", "grouped"])
def test_index_null_poisons_or_counts_as_zero(spark, method):
    df = frame(spark, [1.0, None, 3.0])
    assert column(t.add_antecedent_precipitation_index(df, method=method), "antecedent_precipitation_index") == [1.0, None, None]
    got = column(t.add_antecedent_precipitation_index(df, null_as_zero=True, method=method), "antecedent_precipitation_index")
    assert got == pytest.approx([1.0, 0.9, 3.81])


def test_constant_rain_rises(spark):
    got = column(t.add_antecedent_precipitation_index(frame(spark, [10.0] * 10)), "antecedent_precipitation_index")
    assert all(b > a for a, b in zip(got, got[1:], strict=False)) and math.isclose(got[0], 10.0)


def test_empty_frames(spark):
    empty = frame(spark, [1.0]).limit(0)
    for out in (t.add_antecedent_precipitation_index(empty), t.add_lag_features(empty, ["rainfall_mm_hr"], [1]), t.resample_mean(empty, ["rainfall_mm_hr"]), t.infer_frequency(empty, keys=["rainfall_mm_hr"])):
        assert out.count() == 0


def test_resample_is_dense_and_fill_goes_both_ways(spark):
    rows = [(datetime(2023, 1, 1, 1, 10), 2.0), (datetime(2023, 1, 1, 1, 50), 4.0), (datetime(2023, 1, 1, 4, 0), None), (datetime(2023, 1, 1, 3, 0), 7.0), (None, 1.0)]
    df = spark.createDataFrame(rows, "ts timestamp, x double")
    out = t.resample_mean(df, ["x"], "1h")
    assert column(out, "x") == [3.0, None, 7.0, None]
    assert column(t.fill_both_ways(out, ["x"]), "x") == [3.0, 3.0, 7.0, 7.0]
    lead = spark.createDataFrame([(T0, None), (T0 + timedelta(hours=1), 5.0)], "ts timestamp, x double")
    assert column(t.fill_both_ways(lead, ["x"]), "x") == [5.0, 5.0]


def test_frequency(spark):
    df = frame(spark, [1.0] * 4).withColumn("k", F.lit("a"))
    assert t.infer_frequency(df, keys=["k"]).first()["freq_seconds"] == 3600
    assert t.infer_frequency(df.limit(2), keys=["k"]).first()["freq_seconds"] is None
    with pytest.raises(ValueError):
        t.frequency_seconds("fortnight")


def test_split_at_midnight(spark):
    df = spark.createDataFrame([(datetime(2023, 12, 30) + timedelta(hours=i),) for i in range(60)], "ts timestamp")
    train, val, test = t.chronological_split(df, "2023-12-31")
    assert (train.count(), val.count(), test.count()) == (25, 0, 35)
    train, val, test = t.chronological_split(df, "2023-12-31", "2024-01-01")
    assert (train.count(), val.count(), test.count()) == (25, 24, 11)
    with pytest.raises(ValueError, match="train_end"):
        t.chronological_split(df, None)
    with pytest.raises(TypeError):
        t.chronological_split(df.withColumn("ts", F.lit("x")), "2023-12-31")


def test_supervised_frame(spark):
    df = frame(spark, [1.0, 2.0, 3.0], "water_level_m").withColumn("f", F.lit(1.0))
    out = t.extract_xy(df)
    assert column(out, "label") == [2.0, 3.0] and "water_level_m" not in out.columns
    with pytest.raises(ValueError, match="Target"):
        t.extract_xy(df, "absent")


def test_build_features_keeps_rows(spark):
    df = generate_synthetic_sensor_data(spark, 200, seed=0)
    cfg = {"data": {"target_col": "water_level_m"}, "features": {"lag_hours": [1], "rolling_sum_windows": [3], "dynamic_sensor_cols": ["rainfall_mm_hr"], "delta_features": [{"col": "water_level_m"}], "drop_cols": ["soil_moisture_pct"]}}
    out = t.build_features(df, cfg, "timestamp")
    assert out.count() == 200
    assert {"rainfall_mm_hr_lag_1", "upstream_rainfall_mm_hr_rolling_sum_3", "water_level_m_delta_6", "antecedent_precipitation_index"} <= set(out.columns)
    assert "soil_moisture_pct" not in out.columns


def test_keys_keep_stations_apart(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("b", 2, 5.0), ("a", 3, 2.0)], "k string, ts int, x double")
    rows = {(r["k"], r["ts"]): r["x_lag_1"] for r in t.add_lag_features(df, ["x"], [1], keys=["k"]).collect()}
    assert rows == {("a", 1): None, ("b", 2): None, ("a", 3): 1.0}
