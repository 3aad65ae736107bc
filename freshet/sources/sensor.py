"""Sensor series: CSV, a synthetic generator and the hourly view over the events table."""

from __future__ import annotations

import os
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.operators.temporal import fill_both_ways, hourly_grid, resample_mean

REQUIRED = ("rainfall_mm_hr", "timestamp", "water_level_m")


def validate_schema(df: DataFrame, required: Sequence[str] = REQUIRED) -> None:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"Missing required columns: {missing}. Available: {sorted(df.columns)}")


def require_local_file(path: str) -> None:
    """An error for an absent local path; paths with another scheme are left to Spark."""
    if "://" not in path and not os.path.exists(path):
        raise FileNotFoundError(f"File not found: {path}")


def load_sensor_csv(
    spark: SparkSession, path: str, timestamp_col: str = "timestamp", drop_cols: Sequence[str] = (), resample_freq: str | None = None, keys: Sequence[str] = (),
) -> DataFrame:
    """Read a sensor CSV: strict timestamps (one that doesn't parse is an error, whatever the
    session's ANSI setting), listed columns dropped, measures as double (what doesn't parse is
    null), and on request a dense grid of means by ``keys``, filled forward then back.

    ``keys`` stay text, and so do columns that hold no number at all, so that they can't empty a
    feature set. Rows aren't sorted: ``in_time_order`` does that for what leaves Spark.
    """
    require_local_file(path)
    df = spark.read.csv(path, header=True)
    if timestamp_col not in df.columns:
        raise ValueError(f"Timestamp column '{timestamp_col}' not found. Available: {df.columns}")
    df = df.drop(*[c for c in drop_cols if c in df.columns and c not in keys])
    others = [c for c in df.columns if c != timestamp_col and c not in keys]
    time = F.try_to_timestamp(F.col(f"`{timestamp_col}`"))
    found = df.agg(
        F.count_if(F.col(f"`{timestamp_col}`").isNotNull() & time.isNull()).alias("bad"),
        *[F.count(F.expr(f"try_cast(`{c}` AS DOUBLE)")).alias(f"n{i}") for i, c in enumerate(others)],
    ).first()
    if found["bad"]:
        raise ValueError(f"{found['bad']} values of '{timestamp_col}' are not timestamps")
    numeric = [c for i, c in enumerate(others) if found[f"n{i}"]]
    df = df.withColumns({timestamp_col: time, **{c: F.nanvl(F.expr(f"try_cast(`{c}` AS DOUBLE)"), F.lit(None)) for c in numeric}})
    if resample_freq:
        df = fill_both_ways(resample_mean(df, numeric, resample_freq, timestamp_col, keys), numeric, timestamp_col, keys)
    return df


def generate_synthetic_sensor_data(spark: SparkSession, n_hours: int = 8760, start: str = "2023-01-01", seed: int = 42) -> DataFrame:
    """A test fixture: exponential rain with storms, a seasonal soil moisture, a level that
    follows its own past and the rain, and upstream rain three hours off. The level is
    sequential, so the series is made on the driver; it is as long as ``n_hours``."""
    rng = np.random.default_rng(seed)
    storm = rng.random(n_hours) < 0.05
    rain = np.clip(rng.exponential(0.2, n_hours) + storm * rng.exponential(8.0, n_hours), 0, 200).round(3)
    soil = np.clip(30 + 20 * np.sin(2 * np.pi * np.arange(n_hours) / 8760) + rng.normal(0, 3, n_hours), 0, 100).round(1)
    noise, level = rng.normal(0, 0.05, n_hours), np.empty(n_hours)
    for t in range(n_hours):
        level[t] = 1.5 if t == 0 else 0.92 * level[t - 1] + 0.04 * rain[t - 1] + 0.3 + noise[t]
    level = np.clip(level, 0, 20).round(3)
    first = np.datetime64(start, "s").astype(int)
    rows = zip((first + 3600 * np.arange(n_hours)).tolist(), rain.tolist(), soil.tolist(), level.tolist(), (np.roll(rain, 3) * 0.8).round(3).tolist(), strict=True)
    df = spark.createDataFrame(list(rows), "t long, rainfall_mm_hr double, soil_moisture_pct double, water_level_m double, upstream_rainfall_mm_hr double")
    return df.select(F.timestamp_seconds("t").alias("timestamp"), "rainfall_mm_hr", "soil_moisture_pct", "water_level_m", "upstream_rainfall_mm_hr")


#: Susceptibility of the stations of the events view. Fixed values.
TERRAIN = {"ST0": 0.2, "ST1": 0.45, "ST2": 0.6, "ST3": 0.8}


def sensor_view(events: DataFrame) -> DataFrame:
    """Hourly series of four stations from the events table: station_id, ts,
    rainfall_mm_hr, upstream_rainfall_mm_hr, soil_moisture_pct, water_level_m,
    terrain_susceptibility.

    Events are summed by station and hour in whole cents (map-side first), so sums don't
    depend on their order; from there on a row is a station-hour.
    """
    cents = F.round(F.col("value") * 100).cast("long")

    def total(*kinds: str):
        return F.sum(F.when(F.col("event_type").isin(*kinds), cents))

    def number(kind: str):
        return F.count(F.when((F.col("event_type") == kind) & F.col("value").isNotNull(), F.lit(1)))

    hourly = (
        events.where(F.col("ts").isNotNull() & F.col("user_id").isNotNull())
        .groupBy(F.concat(F.lit("ST"), F.pmod("user_id", F.lit(4)).cast("string")).alias("station_id"), F.date_trunc("hour", "ts").alias("ts"))
        .agg(
            total("click", "view").alias("rain"), total("error").alias("up"),
            total("signup").alias("soil"), number("signup").alias("n_soil"),
            total("purchase").alias("level"), number("purchase").alias("n_level"),
        )
    )
    hourly = hourly.select(
        "station_id", "ts", (F.col("rain") / F.lit(1000.0)).alias("rainfall_mm_hr"), (F.col("up") / F.lit(1000.0)).alias("upstream_rainfall_mm_hr"),
        # least() skips nulls: an hour without a reading has to stay null
        F.when(F.col("n_soil") > 0, F.least(F.try_divide(F.col("soil").cast("double"), 100.0 * F.col("n_soil")), F.lit(100.0))).alias("soil_moisture_pct"),
        F.try_divide(F.col("level").cast("double"), 2000.0 * F.col("n_level")).alias("water_level_m"),
    )
    grid = hourly_grid(hourly, "ts", ["station_id"])
    dense = grid.join(hourly, ["station_id", "ts"], "left").fillna(0.0, ["rainfall_mm_hr", "upstream_rainfall_mm_hr"])
    dense = fill_both_ways(dense, ["soil_moisture_pct", "water_level_m"], "ts", ["station_id"])
    terrain = F.create_map(*[F.lit(x) for kv in TERRAIN.items() for x in kv])
    return dense.select(
        "station_id", "ts", "rainfall_mm_hr", "upstream_rainfall_mm_hr", "soil_moisture_pct", "water_level_m",
        F.try_element_at(terrain, F.col("station_id")).alias("terrain_susceptibility"),
    )
