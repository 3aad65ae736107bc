from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from freshet.errors import CWCJoinError, CWCSchemaError
from freshet.operators import quality
from freshet.operators.fusion import join_cwc_data, validate_cwc_join
from freshet.operators.temporal import in_time_order
from freshet.sources import config, schema, sensor, telemetry

T0 = datetime(2023, 6, 1)


def rainfall(spark, hours=48, start=T0, station="TEST_STATION"):
    rows = [(station, (start + timedelta(hours=i)).strftime("%Y-%m-%d %H:%M:%S"), float(i % 10)) for i in range(hours)]
    return spark.createDataFrame(rows, "Station_Code string, Observation_DateTime string, Rainfall_mm double")


def level(spark, hours=48, start=T0, station="TEST_STATION"):
    rows = [(station, (start + timedelta(hours=i)).strftime("%Y-%m-%d %H:%M:%S"), 3.0 + 0.1 * (i % 20), 5.0, 7.0) for i in range(hours)]
    return spark.createDataFrame(rows, "Station_Code string, Observation_DateTime string, Water_Level_m double, Warning_Level_m double, Danger_Level_m double")


def ready(df):
    return telemetry.parse_cwc_timestamp(telemetry.normalize_cwc_columns(df))


def test_names(spark):
    df = rainfall(spark, 1).withColumn("Mystery", F.lit(1))
    assert telemetry.normalize_cwc_columns(df).columns == ["station_code", "timestamp", "rainfall_mm_hr", "Mystery"]
    assert len(telemetry.COLUMN_MAP) == 46


def test_local_time_becomes_utc(spark):
    rows = [("2023-06-01 00:00:00",), ("2023-06-01T00:00:00+05:30",), ("2023-06-01 00:00:00Z",), ("01-06-2023 00:00",), ("no time",), (None,)]
    out = spark.createDataFrame(rows, "timestamp string").select(telemetry.utc_timestamp(F.col("timestamp")).alias("t")).collect()
    before = datetime(2023, 5, 31, 18, 30)
    assert [r["t"] for r in out] == [before, before, T0, before, None, None]
    with pytest.raises(CWCSchemaError, match="Timestamp column"):
        telemetry.parse_cwc_timestamp(spark.createDataFrame([(1,)], "a int"))


def test_report(spark):
    df = ready(rainfall(spark)).withColumn("rainfall_mm_hr", F.when(F.col("rainfall_mm_hr") == 0, None).otherwise(F.col("rainfall_mm_hr")))
    r = quality.inspect_cwc_dataframe(df, "rain").first()
    assert (r["n_rows"], r["freq_seconds"], r["n_duplicates"], r["station_code_values"], r["span_days"]) == (48, 3600, 0, ["TEST_STATION"], 1)
    missing = {m["column_name"]: (m["n_missing"], float(m["pct_missing"])) for m in quality.missing_values(df).collect()}
    assert missing["rainfall_mm_hr"] == (5, 10.42)
    twice = df.union(df.limit(1))
    assert quality.inspect_cwc_dataframe(twice).first()["freq_seconds"] is None
    assert quality.duplicate_timestamps(twice).first()["n_duplicates"] == 1
    empty = quality.inspect_cwc_dataframe(df.limit(0)).first()
    assert (empty["n_rows"], empty["ts_min"], empty["n_duplicates"]) == (0, None, 0)
    bad = quality.out_of_range(df, {"rainfall_mm_hr": (2, 8), "absent": (0, 1)}).first()
    assert (bad["n_below"], bad["n_above"]) == (5, 4)


def test_join_guards(spark):
    rain = ready(rainfall(spark))
    with pytest.raises(CWCJoinError, match="overlap"):
        validate_cwc_join(rain, ready(level(spark, start=T0 + timedelta(days=900))))
    with pytest.raises(CWCJoinError, match="overlap"):
        validate_cwc_join(rain, ready(level(spark)))  # 47 hours are too few
    with pytest.raises(CWCJoinError, match="station"):
        validate_cwc_join(rain, ready(level(spark, station="B")), 24)
    with pytest.raises(CWCJoinError, match="DatetimeIndex"):
        validate_cwc_join(rain.drop("timestamp_utc"), rain, 24)
    validate_cwc_join(rain, ready(level(spark)), 24)


def test_join(spark):
    rain, wl = ready(rainfall(spark)).withColumn("hfl_m", F.lit(1.0)), ready(level(spark, start=T0 + timedelta(hours=10))).withColumn("hfl_m", F.lit(2.0))
    out = join_cwc_data(rain, wl, min_overlap_hours=24)
    rows = in_time_order(out, "timestamp_utc").collect()
    assert len(rows) == 58 and {"hfl_m", "hfl_m_wl"} <= set(out.columns)
    assert [r["timestamp_utc"] for r in rows] == sorted(r["timestamp_utc"] for r in rows)
    # half-hour local times fall into the hour before
    assert rows[0]["timestamp_utc"] == datetime(2023, 5, 31, 18)


def test_station_filter_really_filters(spark):
    both = rainfall(spark, station="A").union(rainfall(spark, station="B").withColumn("Rainfall_mm", F.lit(100.0)))
    wl = level(spark, station="A").union(level(spark, station="B"))
    out = join_cwc_data(ready(both), ready(wl), min_overlap_hours=24, station_filter="A")
    assert out.agg(F.max("rainfall_mm_hr")).first()[0] == 9.0
    with pytest.raises(CWCJoinError, match="station"):
        join_cwc_data(ready(both), ready(wl), station_filter="C")


def test_files(spark, tmp_path):
    path = str(tmp_path / "rain.csv")
    rainfall(spark, 30).toPandas().to_csv(path, index=False)
    assert telemetry.load_cwc_rainfall(spark, path).count() == 30
    with pytest.raises(CWCSchemaError):
        telemetry.load_cwc_waterlevel(spark, path)
    with pytest.raises(FileNotFoundError):
        telemetry.load_cwc_rainfall(spark, str(tmp_path / "absent.csv"))


def test_loading_and_joining_sorts_nothing(spark):
    """One range shuffle of a feed would be for nothing: its rows are resampled next."""
    plan = join_cwc_data(ready(rainfall(spark)), ready(level(spark)), min_overlap_hours=24)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan


def test_sensor_csv(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text("timestamp,a,b,note\n2023-01-01 02:00:00,1,x,n\n2023-01-01 00:00:00,3,5,m\n")
    df = sensor.load_sensor_csv(spark, str(path), drop_cols=["zz"])
    assert [(r["a"], r["b"], r["note"]) for r in in_time_order(df, "timestamp").collect()] == [(3.0, 5.0, "m"), (1.0, None, "n")]
    dense = sensor.load_sensor_csv(spark, str(path), resample_freq="1h").orderBy("timestamp").collect()
    assert [(r["a"], r["b"]) for r in dense] == [(3.0, 5.0), (3.0, 5.0), (1.0, 5.0)]
    with pytest.raises(ValueError, match="Timestamp column"):
        sensor.load_sensor_csv(spark, str(path), "when")
    bad = tmp_path / "bad.csv"
    bad.write_text("timestamp,a\n2023-01-01 02:00:00,1\nyesterday,2\n")
    for ansi in ("true", "false"):
        spark.conf.set("spark.sql.ansi.enabled", ansi)
        try:
            with pytest.raises(ValueError, match="1 values of 'timestamp'"):
                sensor.load_sensor_csv(spark, str(bad))
        finally:
            spark.conf.unset("spark.sql.ansi.enabled")
    with pytest.raises(ValueError, match="Missing"):
        sensor.validate_schema(df)


def test_synthetic_series(spark):
    df = sensor.generate_synthetic_sensor_data(spark, 100)
    sensor.validate_schema(df)
    assert df.count() == 100 and df.orderBy("timestamp").first()["water_level_m"] == 1.5
    assert df.exceptAll(sensor.generate_synthetic_sensor_data(spark, 100)).count() == 0


def test_declared_schema(spark):
    df = spark.createDataFrame([("2023-01-01 00:00:00", "12.5", float("nan"), 1)], "timestamp string, rainfall_mm_hr string, water_level_m double, other int")
    out = schema.conform(df)
    assert out.columns == [f.name for f in schema.SENSOR_SCHEMA.fields]
    r = out.first()
    assert (r["timestamp"], r["rainfall_mm_hr"], r["water_level_m"], r["station_id"]) == (datetime(2023, 1, 1), 12.5, None, None)
    assert quality.out_of_range(df.withColumn("rainfall_mm_hr", F.lit(301.0)), schema.RANGES).where("column_name = 'rainfall_mm_hr'").first()["n_above"] == 1


def test_config(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("a:\n  b: 1\n  c: null\n")
    cfg = config.load_config(str(path))
    assert config.get_nested(cfg, "a", "b") == 1 and config.get_nested(cfg, "a", "x", default=7) == 7
    assert config.null_leaves(cfg) == ["a.c"]
    with pytest.raises(FileNotFoundError):
        config.load_config(str(tmp_path / "absent.yaml"))


def test_as_of_join_equals_search(spark):
    import random

    from freshet.operators.fusion import as_of_join

    rng = random.Random(9)
    side = lambda n: [(rng.choice(["a", "a", "b", None]), None if rng.random() < 0.05 else rng.randint(0, 400), k, rng.choice([None, round(rng.random(), 3)])) for k in range(n)]
    left, right = side(150), side(200)
    frames = [spark.createDataFrame(rows, "k string, t long, id long, v double").select("k", F.timestamp_seconds("t").alias("ts"), "t", "id", "v").repartition(4) for rows in (left, right)]
    for tolerance in (0, 1, 7, 60, 1000):
        got = {r["id"]: r for r in as_of_join(frames[0].drop("v"), frames[1], ["v"], tolerance, ["k"], ties=["id"], age_col="age").collect()}
        assert len(got) == len(left)
        for k, t, i, _ in left:
            near = [r for r in right if k is not None and t is not None and r[0] == k and r[1] is not None and 0 <= t - r[1] <= tolerance]
            best = max(near, key=lambda r: (r[1], r[2]), default=None)
            assert (got[i]["v"], got[i]["age"]) == ((best[3], float(t - best[1])) if best else (None, None))
    with_own = as_of_join(frames[0], frames[1], ["v"], 60, ties=["id"])
    assert with_own.columns == ["k", "ts", "t", "id", "v"] and with_own.count() == len(left)
    assert as_of_join(frames[0].limit(0), frames[1], ["v"], 60, ["k"]).count() == 0
    assert as_of_join(frames[0], frames[1].limit(0), ["v"], 60, ["k"]).where("v IS NOT NULL").count() == 0
    with pytest.raises(ValueError):
        as_of_join(*frames, ["v"], -1, ["k"])


def test_as_of_join_has_no_range_join(spark):
    from freshet.operators.fusion import as_of_join

    df = spark.range(10).select(F.lit("a").alias("k"), F.timestamp_seconds("id").alias("ts"), F.col("id").alias("v"))
    plan = as_of_join(df.drop("v"), df, ["v"], 3, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Cartesian" not in plan
