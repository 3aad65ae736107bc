"""The declared sensor schema: types, ranges and what is required."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: column: (required, least, most); None where no range is declared. Fixed values.
SENSOR_COLUMNS = {
    "rainfall_mm_hr": (True, 0.0, 300.0),
    "cumulative_rainfall_1h_mm": (False, None, None),
    "cumulative_rainfall_3h_mm": (False, None, None),
    "cumulative_rainfall_6h_mm": (False, None, None),
    "cumulative_rainfall_24h_mm": (False, None, None),
    "soil_moisture_pct": (False, 0.0, 100.0),
    "water_level_m": (True, 0.0, 30.0),
    "discharge_cumec": (False, None, None),
    "upstream_rainfall_mm_hr": (False, None, None),
    "forecast_rainfall_3h_mm": (False, None, None),
    "forecast_rainfall_6h_mm": (False, None, None),
    "forecast_rainfall_24h_mm": (False, None, None),
}
SENSOR_SCHEMA = T.StructType(
    [T.StructField("timestamp", T.TimestampType(), False), T.StructField("station_id", T.StringType())]
    + [T.StructField(c, T.DoubleType(), not required) for c, (required, _, _) in SENSOR_COLUMNS.items()]
)
RANGES = {c: (lo, hi) for c, (_, lo, hi) in SENSOR_COLUMNS.items() if lo is not None}


def conform(df: DataFrame) -> DataFrame:
    """Declared columns in declared types; what doesn't cast is null, absent columns too, NaN too.
    Columns beyond the schema are left out."""
    out = []
    for f in SENSOR_SCHEMA.fields:
        x = F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})") if f.name in df.columns else F.lit(None).cast(f.dataType)
        out.append((F.nanvl(x, F.lit(None).cast("double")) if isinstance(f.dataType, T.DoubleType) else x).alias(f.name))
    return df.select(*out)
