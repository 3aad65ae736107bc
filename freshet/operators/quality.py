"""Quality reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

METADATA = ("station_code", "station_name", "river", "basin")
LEVELS = ("warning_level_m", "danger_level_m", "hfl_m")


def duplicate_timestamps(df: DataFrame, time_col: str = "timestamp_utc", by: Sequence[str] = ()) -> DataFrame:
    """n_duplicates: rows less distinct times; a null time counts as a value."""
    nulls = F.max(F.col(time_col).isNull().cast("long"))
    return df.groupBy(*by).agg((F.count("*") - F.count_distinct(time_col) - F.coalesce(nulls, F.lit(0))).alias("n_duplicates"))


def missing_values(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column_name, n_missing, pct_missing (2 places), in one pass; NaN counts as missing."""
    columns = list(columns or df.columns)
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def absent(c: str):
        x = F.col(f"`{c}`")
        return x.isNull() | F.isnan(x) if isinstance(kinds[c], (T.DoubleType, T.FloatType)) else x.isNull()

    one = df.agg(F.count("*").alias("n"), F.array(*[F.struct(F.lit(c).alias("column_name"), F.count_if(absent(c)).alias("n_missing")) for c in columns]).alias("x"))
    one = one.select("n", F.explode("x").alias("x"))
    return one.select("x.column_name", "x.n_missing", F.round(F.col("x.n_missing") * 100.0 / F.greatest("n", F.lit(1)), 2).alias("pct_missing"))


def inspect_cwc_dataframe(df: DataFrame, name: str = "dataset", time_col: str = "timestamp_utc", max_distinct: int = 100_000) -> DataFrame:
    """One row: name, n_rows, ts_min, ts_max, span_days, freq_seconds, n_duplicates and the
    distinct values of metadata and level columns present (sorted). An empty frame gives
    zeros and nulls. Distinct lists are those of station metadata: small by nature, and
    checked against ``max_distinct`` before they are collected into one row."""
    t = F.col(time_col)
    lists = [c for c in (*METADATA, *LEVELS) if c in df.columns]
    if lists:
        most = df.agg(*[F.approx_count_distinct(c).alias(c) for c in lists]).first()
        large = [c for c in lists if most[c] > max_distinct]
        if large:
            raise ValueError(f"more than {max_distinct} distinct values in {large}")
    # One row first: n different times in steps of (max - min) / (n - 1) are regular exactly
    # if each lies on that grid, so no order is needed.
    ends = df.agg(F.count(t).alias("n"), F.count_distinct(t).alias("d"), F.min(F.unix_timestamp(t)).alias("a"), F.max(F.unix_timestamp(t)).alias("b")).first()
    step = (ends["b"] - ends["a"]) // (ends["n"] - 1) if ends["n"] >= 3 and ends["n"] == ends["d"] else 0
    regular = step > 0 and step * (ends["n"] - 1) == ends["b"] - ends["a"]
    on_grid = F.count_if((F.unix_timestamp(t) - F.lit(ends["a"])) % F.lit(step) != 0) == 0 if regular else F.lit(False)
    return df.agg(
        F.count("*").alias("n_rows"), F.min(t).alias("ts_min"), F.max(t).alias("ts_max"),
        F.floor((F.unix_timestamp(F.max(t)) - F.unix_timestamp(F.min(t))) / 86400).alias("span_days"),
        F.when(on_grid, F.lit(step)).cast("long").alias("freq_seconds"),
        (F.count("*") - F.count_distinct(t) - F.coalesce(F.max(t.isNull().cast("long")), F.lit(0))).alias("n_duplicates"),
        *[F.sort_array(F.collect_set(c)).alias(f"{c}_values") for c in lists],
    ).select(F.lit(name).alias("name"), "*")


def out_of_range(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """column_name, n_below, n_above for the columns present (an addition of ours)."""
    present = {c: r for c, r in ranges.items() if c in df.columns}
    one = df.agg(F.array(*[F.struct(F.lit(c).alias("column_name"), F.count_if(F.col(c) < lo).alias("n_below"), F.count_if(F.col(c) > hi).alias("n_above")) for c, (lo, hi) in present.items()]).alias("x"))
    return one.select(F.explode("x").alias("x")).select("x.*")
