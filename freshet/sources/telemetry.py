"""Agency telemetry: column names, UTC time index, rainfall and water-level files."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.errors import CWCSchemaError
from freshet.sources.sensor import require_local_file

log = logging.getLogger(__name__)

#: Names that raw files use for each canonical column. Fixed values.
RAW_NAMES = {
    "station_code": ("Station_Code", "StationCode", "STATION_CODE"),
    "station_name": ("Station_Name", "Station Name", "StationName", "STATION_NAME"),
    "river": ("River", "RIVER"),
    "basin": ("Basin", "BASIN"),
    "state": ("State", "STATE"),
    "district": ("District", "DISTRICT"),
    "timestamp": ("Observation_DateTime", "Date_Time", "DateTime", "Datetime", "date_time", "ObsDateTime", "OBS_DATETIME"),
    "rainfall_mm_hr": ("Rainfall_mm", "Rainfall_Mm", "Rainfall(mm)", "RAINFALL_MM", "rainfall_mm"),
    "water_level_m": ("Water_Level_m", "Water_Level(m)", "WaterLevel_m", "WATER_LEVEL_M", "water_level_mMSL", "WL_m"),
    "discharge_cumecs": ("Discharge_cumecs", "Discharge(cumecs)", "DISCHARGE_CUMECS", "discharge_m3s"),
    "warning_level_m": ("Warning_Level_m", "Warning_Level(m)", "WL_Threshold_m"),
    "danger_level_m": ("Danger_Level_m", "Danger_Level(m)", "DL_Threshold_m"),
    "hfl_m": ("HFL_m", "HFL(m)", "Highest_Flood_Level_m"),
}
COLUMN_MAP = {raw: name for name, raws in RAW_NAMES.items() for raw in raws}
MEASURES = ("rainfall_mm_hr", "water_level_m", "discharge_cumecs", "warning_level_m", "danger_level_m", "hfl_m")
#: Formats tried in turn where the default reading of a timestamp fails.
FORMATS = ("yyyy-MM-dd HH:mm:ss", "dd-MM-yyyy HH:mm:ss", "dd-MM-yyyy HH:mm", "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm")


def normalize_cwc_columns(df: DataFrame) -> DataFrame:
    """Rename known raw columns; unknown ones stay (with a warning). One rename, no data read."""
    unknown = [c for c in df.columns if c not in COLUMN_MAP]
    if unknown:
        log.warning("columns kept as they are: %s", unknown)
    return df.withColumnsRenamed({c: COLUMN_MAP[c] for c in df.columns if c in COLUMN_MAP})


def utc_timestamp(c: Column, tz: str = "Asia/Kolkata", formats: Sequence[str] = FORMATS) -> Column:
    """A text as UTC timestamp: with an offset as it says, without one as local time of
    ``tz``; null if it doesn't parse. The session's time zone must be UTC."""
    text = F.trim(c.cast("string"))
    parsed = F.coalesce(F.try_to_timestamp(text), *[F.try_to_timestamp(text, F.lit(f)) for f in formats])
    aware = text.rlike(r"(Z|UTC|[+-]\d{2}:?\d{2})$") & text.rlike(r"\d:\d{2}")
    return F.when(aware, parsed).otherwise(F.to_utc_timestamp(parsed, tz))


def parse_cwc_timestamp(df: DataFrame, timestamp_col: str = "timestamp", tz: str = "Asia/Kolkata") -> DataFrame:
    """Replace ``timestamp_col`` by ``timestamp_utc``; unparsed times are null. Nothing is sorted:
    ``in_time_order`` does that for what leaves Spark."""
    if timestamp_col not in df.columns:
        raise CWCSchemaError(f"Timestamp column '{timestamp_col}' not found. Available: {df.columns}")
    return df.withColumn("timestamp_utc", utc_timestamp(F.col(f"`{timestamp_col}`"), tz)).drop(timestamp_col)


def _load(spark: SparkSession, path: str, measure: str) -> DataFrame:
    try:
        require_local_file(path)
    except FileNotFoundError:
        raise FileNotFoundError(f"Telemetry file not found: {path}. Such data is released on formal request only.") from None
    df = parse_cwc_timestamp(normalize_cwc_columns(spark.read.csv(path, header=True)))
    if measure not in df.columns:
        raise CWCSchemaError(f"Column '{measure}' not found after normalisation. Available: {df.columns}")
    return df.withColumns({c: F.expr(f"try_cast(`{c}` AS DOUBLE)") for c in MEASURES if c in df.columns})


def load_cwc_rainfall(spark: SparkSession, path: str) -> DataFrame:
    return _load(spark, path, "rainfall_mm_hr")


def load_cwc_waterlevel(spark: SparkSession, path: str) -> DataFrame:
    return _load(spark, path, "water_level_m")
