"""Long series in time ranges against the same operators on whole series."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from freshet.operators import temporal as t
from freshet.operators.ranges import cut_into_ranges, in_time_ranges, time_number

CFG = {"features": {"dynamic_sensor_cols": ["water_level_m", "rainfall_mm_hr"], "lag_hours": [1, 7, -2], "rolling_sum_windows": [3, 24], "delta_features": [{"col": "water_level_m", "windows": [1, 5]}]}}


def rows_of(df, digits=None):
    def cell(v):
        return None if v is None else round(v, digits) if digits is not None and isinstance(v, float) else v

    return sorted((tuple((c, cell(r[c])) for c in sorted(df.columns)) for r in df.collect()), key=str)


def recurrence(rain, decay):
    out, a = [], 0.0
    for r in rain:
        a = None if r is None or a is None else decay * a + r
        out.append(a)
    return out


@pytest.fixture(scope="module")
def stations(spark):
    """A long station with bursts, gaps and nulls, a null station as long, and short ones."""
    rng = random.Random(3)
    out, t0 = [], 1_700_000_000
    for name, n in (("a", 900), (None, 400), ("b", 3), ("c", 60)):
        at = t0
        for _ in range(n):
            at += rng.choice([1, 60, 3600, 3600, 90_000])
            out.append((name, at, None if rng.random() < 0.02 else round(rng.expovariate(1), 3), round(rng.random(), 3)))
    df = spark.createDataFrame(out, "k string, s long, rainfall_mm_hr double, water_level_m double")
    return df.select("k", F.timestamp_seconds("s").alias("ts"), "rainfall_mm_hr", "water_level_m").repartition(5)


@pytest.mark.parametrize("size", [1, 50, 899])
def test_features_of_ranges_equal_those_of_series(stations, size):
    whole, cut = (t.build_features(stations, CFG, keys=["k"], rows_per_range=n) for n in (None, size))
    assert cut.columns == whole.columns and rows_of(cut, 9) == rows_of(whole, 9)
    whole, cut = (t.extract_xy(stations, forecast_horizon=5, drop_na=False, keys=["k"], rows_per_range=n) for n in (None, size))
    assert rows_of(cut) == rows_of(whole)
    one = stations.where("k = 'a'").drop("k")
    whole, cut = (t.engineer_flood_features(one, rows_per_range=n) for n in (None, size))
    assert rows_of(cut, 9) == rows_of(whole, 9)


def test_halo_is_whole_where_ranges_are_shorter_than_it(spark):
    """One row a range now and then, lags far longer than a range, in both directions."""
    times = [1, 2, 3, 1000, 1001, 5000, 5001, 5002, 5003, 9000, 9001, 9002, 20_000, 20_001, 20_002, 20_003, 40_000]
    df = spark.createDataFrame([(x, float(x)) for x in times], "ts long, x double")
    for back, ahead in ((1, 0), (4, 0), (13, 3), (0, 9), (16, 16)):
        cut = in_time_ranges(df, lambda d, k: t.add_lag_features(d, ["x"], [back, -ahead], keys=k), rows_per_range=2, back=back, ahead=ahead)  # noqa: B023
        got = {r["ts"]: r for r in cut.collect()}
        for i, x in enumerate(times):
            assert not back or got[x][f"x_lag_{back}"] == (float(times[i - back]) if i >= back else None)
            assert not ahead or got[x][f"x_lag_-{ahead}"] == (float(times[i + ahead]) if i + ahead < len(times) else None)


def test_ties_and_rows_without_a_time(spark):
    """Rows of one time are alike here, so any order among them gives one result."""
    times = [None] * 5 + [k // 4 for k in range(400)]
    df = spark.createDataFrame([(x, -1.0 if x is None else float(x)) for x in times], "ts int, x double").repartition(3)
    compute = lambda d, k: t.add_rolling_features(t.add_lag_features(d, ["x"], [1, 6], keys=k), ["x"], [9], keys=k)
    assert rows_of(in_time_ranges(df, compute, rows_per_range=20, back=9)) == rows_of(compute(df, []))
    nothing = spark.createDataFrame([(None, 1.0)] * 40, "ts int, x double")
    assert rows_of(in_time_ranges(nothing, compute, rows_per_range=5, back=9)) == rows_of(compute(nothing, []))
    assert in_time_ranges(df.limit(0), compute, rows_per_range=5, back=9).count() == 0


def test_a_series_uses_many_tasks(spark):
    df = spark.range(200_000).select(F.timestamp_seconds(F.col("id") * 3600).alias("ts"), (F.col("id") % 7).cast("double").alias("rainfall_mm_hr"))
    cut = cut_into_ranges(df, "ts", [], 10_000, back=24)
    sizes = {r["_range"]: r for r in cut.groupBy("_range").agg(F.sum(F.col("_own").cast("int")).alias("own"), F.count("*").alias("n")).collect()}
    assert len(sizes) == 20 and sum(r["own"] for r in sizes.values()) == 200_000
    assert all(9_000 <= r["own"] <= 11_000 and r["n"] - r["own"] <= 1000 for r in sizes.values())
    out = t.build_features(df, CFG, rows_per_range=10_000)
    tasks = out.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(tasks) > 1


@pytest.mark.parametrize("decay", [0.0, 1e-250, 0.01, 0.5, 0.9, 0.99, 0.999999, 1.0, -0.7, -1.0])
def test_scan_equals_the_recurrence(spark, decay):
    rng = random.Random(7)
    rain = [round(rng.expovariate(0.5), 3) if rng.random() < 0.3 else 0.0 for _ in range(3000)]
    rain[1:1500] = [0.0] * 1499 if decay == 0.5 else rain[1:1500]
    want = recurrence(rain, decay)
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rain)], "ts long, rainfall_mm_hr double").repartition(4)
    for size in (None, 100, 777):
        got = [r["antecedent_precipitation_index"] for r in t.add_antecedent_precipitation_index(df, decay_factor=decay, rows_per_range=size).orderBy("ts").collect()]
        assert got == pytest.approx(want, rel=1e-12, abs=1e-300)
        assert size or got[:64] == want[:64]


def test_scan_keeps_nulls_and_keys_apart(spark):
    rain = {"a": [1.0] * 50 + [None] + [2.0] * 250, "b": [3.0] * 300, None: [None, *[1.0] * 299], "short": [1.0, None, 1.0]}
    df = spark.createDataFrame([(k, i, r) for k, rs in rain.items() for i, r in enumerate(rs)], "k string, ts long, rainfall_mm_hr double").repartition(5)
    for zero in (False, True):
        for size in (None, 20, 130):
            out = t.add_antecedent_precipitation_index(df, keys=["k"], null_as_zero=zero, rows_per_range=size)
            got = {(r["k"], r["ts"]): r["antecedent_precipitation_index"] for r in out.collect()}
            for k, rs in rain.items():
                want = recurrence([0.0 if zero and r is None else r for r in rs], 0.9)
                assert [got[k, i] for i in range(len(rs))] == [None if w is None else pytest.approx(w, rel=1e-12) for w in want]


def test_growing_decays_follow_the_recurrence(spark):
    df = spark.createDataFrame([(k, 1.0) for k in range(5)], "ts int, rainfall_mm_hr double")
    got = t.add_antecedent_precipitation_index(df, decay_factor=2.0).orderBy("ts").collect()
    assert [r["antecedent_precipitation_index"] for r in got] == [1.0, 3.0, 7.0, 15.0, 31.0]
    with pytest.raises(ValueError):
        t.add_antecedent_precipitation_index(df, decay_factor=2.0, method="scan")


def test_time_numbers_keep_the_order(spark):
    days = [datetime.datetime(2024, 3, 30, 22) + datetime.timedelta(minutes=20 * k, microseconds=k) for k in range(30)]
    df = spark.createDataFrame([(d, d.date()) for d in days], "t timestamp_ntz, d date")
    numbers = [r[0] for r in df.orderBy("t").select(time_number(df, "t")).collect()]
    assert all(b - a == 1_200_000_001 for a, b in zip(numbers, numbers[1:], strict=False))
    assert [r[0] for r in df.orderBy("d").select(time_number(df, "d")).collect()] == sorted(r[0] for r in df.select(time_number(df, "d")).collect())
    with pytest.raises(TypeError):
        time_number(spark.createDataFrame([("x",)], "t string"), "t")


def test_fills_take_time_in_proportion(spark):
    import time

    def seconds(n):
        df = spark.range(n).select(F.col("id").alias("ts"), F.when(F.col("id") % 1000 == 999, F.col("id").cast("double")).alias("x"))
        began = time.time()
        out = t.fill_both_ways(df, ["x"]).agg(F.sum("x"), F.count("x")).first()
        assert out[1] == n
        return time.time() - began

    seconds(1000)
    assert seconds(160_000) < 8 * max(seconds(20_000), 0.5)


def test_grid_of_a_long_span(spark):
    df = spark.createDataFrame([("a", 0), ("a", 3600 * 9999), ("b", 7200)], "k string, s long").select("k", F.timestamp_seconds("s").alias("ts"))
    grid = t.hourly_grid(df, keys=["k"])
    assert grid.count() == 10_001 and grid.distinct().count() == 10_001
    assert grid.where("k = 'a'").agg(F.min(F.unix_timestamp("ts")), F.max(F.unix_timestamp("ts"))).first() == (0, 3600 * 9999)
