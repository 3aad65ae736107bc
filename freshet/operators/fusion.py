"""Joining rainfall and water level: on an hourly UTC grid, behind guards, or as of each reading."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet.errors import CWCJoinError
from freshet.operators.ranges import time_number
from freshet.operators.temporal import resample_mean

log = logging.getLogger(__name__)


def _bounds(df: DataFrame, name: str, time_col: str):
    if time_col not in df.columns or not isinstance(df.schema[time_col].dataType, (T.TimestampType, T.TimestampNTZType)):
        raise CWCJoinError(f"Cannot join: {name} has no time column like a DatetimeIndex ('{time_col}'). Parse timestamps first.")
    return df.agg(F.min(time_col).alias("a"), F.max(time_col).alias("b")).first()  # one row


def validate_cwc_join(rain: DataFrame, level: DataFrame, min_overlap_hours: float = 720, station_col: str = "station_code", time_col: str = "timestamp_utc") -> None:
    """An error unless both are in time, overlap long enough and share a station. Reads two
    one-row aggregates and at most one row of a semi join."""
    r, w = _bounds(rain, "rainfall", time_col), _bounds(level, "water_level", time_col)
    if None in (r["a"], w["a"]) or max(r["a"], w["a"]) >= min(r["b"], w["b"]):
        raise CWCJoinError(f"Cannot join: no temporal overlap between rainfall ({r['a']} to {r['b']}) and water level ({w['a']} to {w['b']}).")
    hours = (min(r["b"], w["b"]) - max(r["a"], w["a"])).total_seconds() / 3600
    if hours < min_overlap_hours:
        raise CWCJoinError(f"Cannot join: temporal overlap is only {hours:.0f} hours, fewer than the required {min_overlap_hours}.")
    if station_col in rain.columns and station_col in level.columns:
        common = rain.select(station_col).distinct().join(level.select(station_col).distinct(), station_col, "left_semi")
        if not common.limit(1).collect():
            raise CWCJoinError(f"Cannot join: no common station codes in '{station_col}'.")
    else:
        log.warning("no column '%s' on both sides: joined by time only", station_col)


def join_cwc_data(
    rain: DataFrame, level: DataFrame, resample_freq: str = "1h", min_overlap_hours: float = 720, station_filter: str | None = None,
    time_col: str = "timestamp_utc", keys: Sequence[str] = (),
) -> DataFrame:
    """Full outer join of hourly means, without rows that lack both measures. Not sorted:
    ``in_time_order`` does that for what leaves Spark.

    ``station_filter`` keeps one station's rows (an error if there are none). A level column
    that rainfall has too gets ``_wl``. ``keys`` joins many stations at once; without them
    all rows of a side share one series.
    """
    if station_filter is not None:
        sides = []
        for name, df in (("rainfall", rain), ("water_level", level)):
            one = df.where(F.col("station_code") == station_filter) if "station_code" in df.columns else df
            if not one.limit(1).collect():
                raise CWCJoinError(f"Cannot join: no {name} rows of station '{station_filter}'.")
            sides.append(one)
        rain, level = sides
    validate_cwc_join(rain, level, min_overlap_hours, time_col=time_col)

    def numeric(df: DataFrame) -> list[str]:
        return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in keys]

    a = resample_mean(rain, numeric(rain), resample_freq, time_col, keys)
    b = resample_mean(level, numeric(level), resample_freq, time_col, keys)
    b = b.withColumnsRenamed({c: f"{c}_wl" for c in b.columns if c in a.columns and c != time_col and c not in keys})
    out = a.join(b, [*keys, time_col], "full_outer")
    has = [F.col(c).isNotNull() for c in ("rainfall_mm_hr", "water_level_m") if c in out.columns]
    keep = F.lit(False)
    for c in has:
        keep = keep | c
    return out.where(keep)


def as_of_join(
    left: DataFrame, right: DataFrame, columns: Sequence[str], tolerance_seconds: float, keys: Sequence[str] = (), time_col: str = "ts", ties: Sequence[str] = (), age_col: str | None = None,
) -> DataFrame:
    """``left`` with ``columns`` of the last row of ``right`` of the same keys at or before its time, at most
    ``tolerance_seconds`` older; null where there is none. ``age_col`` names a column for the age in seconds.

    Of right rows of one time the last by ``ties`` counts, then by the values themselves. Rows
    without a time, or with a null key, match nothing; such left rows stay. Columns of ``left`` of those names are replaced.

    At scale: time is dealt into buckets as long as the tolerance, so what a row may match lies in its own bucket or in the
    one before, of which only the last right row of each key counts: that is one aggregation that combines map-side. Both sides
    meet by key and bucket in one exchange and are merged there in the order of time; a hot station is as many groups as
    it has buckets, and there is no range join.
    """
    new = [*columns, *([age_col] if age_col else [])]
    if tolerance_seconds < 0 or set(new) & {*keys, time_col}:
        raise ValueError("the tolerance isn't negative, and keys and time aren't among the columns that come from the right")
    kept = [c for c in left.columns if c not in new]
    named, width = [f"_k{i}" for i in range(len(keys))], max(int(tolerance_seconds * 1_000_000) + 1, 1)
    whole = F.floor(F.col("_t") / F.lit(width))

    def placed(df: DataFrame, **more) -> DataFrame:
        return df.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, named, strict=True)], time_number(df, time_col).alias("_t"), *[v.alias(n) for n, v in more.items()])

    rows = placed(left, _l=F.struct(*[F.col(f"`{c}`") for c in kept]))
    order = [F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(ties)]
    values = placed(right, _r=F.struct(time_number(right, time_col).alias("t"), *order, *[F.col(f"`{c}`").alias(f"v{i}") for i, c in enumerate(columns)]))
    fit = F.lit(True)
    for c in (*named, "_t"):
        fit = fit & F.col(c).isNotNull()
    readings = values.where(fit).withColumn("_b", whole)
    last = readings.groupBy(*named, "_b").agg(F.max("_r").alias("_r")).withColumn("_b", F.col("_b") + 1).withColumn("_t", F.col("_r")["t"])
    none = F.lit(None).cast(rows.schema["_l"].dataType)
    both = rows.where(fit).withColumn("_b", whole).withColumn("_r", F.lit(None).cast(values.schema["_r"].dataType)).unionByName(readings.unionByName(last).withColumn("_l", none))
    merged = Window.partitionBy(*named, "_b").orderBy("_t", F.col("_l").isNotNull(), "_r").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_found", F.last("_r", True).over(merged)).where("_l IS NOT NULL")
    near = F.col("_t") - F.col("_found")["t"] <= F.lit(int(tolerance_seconds * 1_000_000))
    out = found.select("_l", "_t", F.when(near, F.col("_found")).alias("_found"))
    apart = rows.where(~fit).select("_l", "_t", F.lit(None).cast(values.schema["_r"].dataType).alias("_found"))
    age = [((F.col("_t") - F.col("_found")["t"]) / 1_000_000).alias(age_col)] if age_col else []
    return out.unionByName(apart).select(*[F.col("_l")[c].alias(c) for c in kept], *[F.col("_found")[f"v{i}"].alias(c) for i, c in enumerate(columns)], *age)
