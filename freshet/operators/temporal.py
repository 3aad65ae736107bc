"""Temporal operators. Order is always explicit: a time column within optional keys.

With no keys a series is one window partition, as its order demands; give keys
(``["station_id"]``) for many stations, and ``rows_per_range`` (or :func:`in_time_ranges`) for
series that no task should hold. All window columns over one key and order share
one exchange and one sort.
"""

from __future__ import annotations

import logging
import math
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet.operators.ranges import OWN, joined_left, carried, cut_into_ranges, in_time_ranges

log = logging.getLogger(__name__)

AGGREGATES = {"sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min}
#: Rows over which the wetness index follows its recurrence step by step.
FOLDED = 64
_UNITS = {"s": 1, "min": 60, "t": 60, "h": 3600, "d": 86400}


def series(time_col: str = "ts", keys: Sequence[str] = (), ties: Sequence[str] = ()) -> WindowSpec:
    order = [F.col(time_col).asc_nulls_last(), *ties]
    return Window.partitionBy(*keys).orderBy(*order) if keys else Window.orderBy(*order)


def in_time_order(df: DataFrame, time_col: str = "ts", keys: Sequence[str] = ()) -> DataFrame:
    """Rows by keys and time, those without a time last. A range shuffle of all rows, meant for
    what leaves Spark: windows and joins order what they need themselves."""
    return df.orderBy(*keys, F.col(time_col).asc_nulls_last())


def _present(df: DataFrame, columns: Sequence[str]) -> list[str]:
    absent = [c for c in columns if c not in df.columns]
    if absent:
        log.warning("columns not found, skipped: %s", absent)
    return [c for c in columns if c in df.columns]


def add_lag_features(df: DataFrame, columns: Sequence[str], lag_steps: Sequence[int], time_col: str = "ts", keys: Sequence[str] = ()) -> DataFrame:
    """``{c}_lag_{n}``: the value n rows before (after, for negative n). Step 0, absent
    columns and names that exist already are skipped."""
    w = series(time_col, keys)
    new = {f"{c}_lag_{n}": F.lag(c, n).over(w) for c in _present(df, columns) for n in lag_steps if n and f"{c}_lag_{n}" not in df.columns}
    return df.withColumns(new) if new else df


def add_rolling_features(df: DataFrame, columns: Sequence[str], window_steps: Sequence[int], func: str = "sum", time_col: str = "ts", keys: Sequence[str] = ()) -> DataFrame:
    """``{c}_rolling_{func}_{n}`` over the last n rows, this one included; null only where all
    of them are. Names that exist already are skipped."""
    if func not in AGGREGATES:
        raise ValueError(f"Invalid aggregation function '{func}'. Choose from {sorted(AGGREGATES)}")
    w = series(time_col, keys)
    new = {f"{c}_rolling_{func}_{n}": AGGREGATES[func](c).over(w.rowsBetween(1 - n, 0)) for c in _present(df, columns) for n in window_steps if f"{c}_rolling_{func}_{n}" not in df.columns}
    return df.withColumns(new) if new else df


def add_rate_of_rise(df: DataFrame, level_col: str = "water_level_m", delta_windows: Sequence[int] = (1, 3, 6), time_col: str = "ts", keys: Sequence[str] = ()) -> DataFrame:
    """``{c}_delta_{n}``: the value less that n rows before. Replaces columns of that name."""
    if not _present(df, [level_col]):
        return df
    w = series(time_col, keys)
    return df.withColumns({f"{level_col}_delta_{n}": F.col(level_col) - F.lag(level_col, n).over(w) for n in delta_windows})


def add_antecedent_precipitation_index(
    df: DataFrame, rainfall_col: str = "rainfall_mm_hr", decay_factor: float = 0.9, new_col: str = "antecedent_precipitation_index",
    time_col: str = "ts", keys: Sequence[str] = (), null_as_zero: bool = False, method: str = "auto", rows_per_range: int | None = None,
) -> DataFrame:
    """a[0] = r[0], a[t] = decay * a[t-1] + r[t]. A null makes all later values null, or
    counts as no rain with ``null_as_zero``.

    ``scan``: in the JVM, of constant cost a row, for decays from -1 to 1. Running sums give
    a[j] = decay^j * sum of r[i] / decay^i within a block of rows in which the powers fit a double, and blocks hand on their
    last value; from every ``FOLDED`` rows on the recurrence itself is followed, so that digits are its own from the
    first rain on. With ``rows_per_range`` long series are cut into time ranges, each a task of its own: a range
    turns the value a before it into decay^n * a + b, and these maps, a row a range, are composed in order
    and carried back. ``grouped``: the recurrence itself over each key's rows, for any decay; the rows of a
    key pass through one task in order, in Arrow batches with one number carried on.
    ``auto`` scans where it can.
    """
    if not _present(df, [rainfall_col]):
        return df
    if method == "auto":
        method = "scan" if abs(decay_factor) <= 1 else "grouped"
    if method == "grouped":
        return _grouped_index(df, rainfall_col, decay_factor, new_col, time_col, keys, null_as_zero)
    if abs(decay_factor) > 1:
        raise ValueError("a decay beyond 1 grows without bound: method 'grouped' follows it")
    cut = cut_into_ranges(df, time_col, keys, rows_per_range) if rows_per_range else None
    by = list(keys) if cut is None else [*keys, "_range"]
    local = _local_index(df if cut is None else cut, F.col(rainfall_col).cast("double"), decay_factor, time_col, by)
    start, bad = F.col("_start"), F.col("_bad")
    if cut is not None:
        ends = local.groupBy(*by).agg(F.max("_n").alias("n"), F.max_by("_a", "_n").alias("b"), F.max("_bad").alias("bad"))
        ends = ends.withColumn("_most", F.max("_range").over(Window.partitionBy(*keys))).where("_most > 0").drop("_most")
        before = carried(ends, keys, lambda held, x: (decay_factor ** x[0] * (held[0] if held else 0.0) + x[1], x[2] or bool(held and held[1])), "_carry double, _was_bad boolean")
        local = joined_left(local, before, by, before.count())
        rows_before = F.col("_n") - F.size("_since")
        start = start + F.pow(F.lit(float(decay_factor)), rows_before.cast("double")) * F.coalesce("_carry", F.lit(0.0))
        bad = bad | F.coalesce("_was_bad", F.lit(False))
    value = F.aggregate("_since", start, lambda a, r: F.lit(float(decay_factor)) * a + r)
    out = local.withColumn(new_col, value if null_as_zero else F.when(~bad, value))
    return out.drop("_a", "_n", "_bad", "_start", "_since", "_carry", "_was_bad", *OWN)


def _local_index(df: DataFrame, rain: Column, decay: float, time_col: str, keys: Sequence[str]) -> DataFrame:
    """``_a``, the index of each series from 0 on with nulls as no rain; ``_n``, the number of the
    row; ``_bad``, whether a null came so far; ``_since``, the rain of the last rows, ``FOLDED`` at
    most, and ``_start``, the index before them."""
    so_far = (Window.unboundedPreceding, 0)
    out = df.withColumns({"_n": F.row_number().over(series(time_col, keys)), "_rain": F.coalesce(rain, F.lit(0.0)), "_null": rain.isNull()})
    in_order = Window.partitionBy(*keys).orderBy("_n")
    out = out.withColumn("_bad", F.max("_null").over(in_order.rowsBetween(*so_far))).drop("_null")
    before, d = in_order.rowsBetween(Window.unboundedPreceding, -1), F.lit(float(decay))
    if decay == 0:
        out = out.withColumn("_a", F.col("_rain"))
    else:
        # so many rows that decay^-rows is still a double: what lies two blocks back has vanished from one
        block = 2**31 - 1 if abs(decay) == 1 else max(int(600 / -math.log(abs(decay))), 1)
        at = F.pmod(F.col("_n") - 1, F.lit(block)).cast("double")
        out = out.withColumns({"_block": F.floor((F.col("_n") - 1) / block), "_at": at})
        within = F.sum(F.col("_rain") * F.pow(d, -F.col("_at"))).over(Window.partitionBy(*keys, "_block").orderBy("_n").rowsBetween(*so_far))
        out = out.withColumn("_a", F.pow(d, "_at") * within)
        handed_on, full = F.coalesce(F.last("_end", True).over(before), F.lit(0.0)), F.col("_at") == block - 1
        out = out.withColumn("_end", F.when(full, F.col("_a")))
        out = out.withColumn("_end", F.when(full, F.col("_a") + F.pow(d, F.lit(float(block))) * handed_on))
        out = out.withColumn("_a", F.col("_a") + F.pow(d, F.col("_at") + 1) * handed_on).drop("_block", "_at", "_end")
    last = F.when(F.pmod("_n", F.lit(FOLDED)) == 0, F.col("_a"))
    out = out.withColumns({"_start": F.coalesce(F.last(last, True).over(before), F.lit(0.0)), "_block": F.floor((F.col("_n") - 1) / FOLDED)})
    since = F.collect_list("_rain").over(Window.partitionBy(*keys, "_block").orderBy("_n").rowsBetween(*so_far))
    return out.withColumn("_since", since).drop("_rain", "_block")


def _grouped_index(df: DataFrame, rainfall_col: str, decay: float, new_col: str, time_col: str, keys: Sequence[str], null_as_zero: bool) -> DataFrame:
    base = df.drop(new_col)
    schema = T.StructType([*base.schema.fields, T.StructField(new_col, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        series_now, a, begun = None, None, False
        for batch in batches:
            out = []
            names = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True)) if keys else [()] * batch.num_rows
            for name, r in zip(names, batch.column(rainfall_col).to_pylist(), strict=True):
                if not begun or name != series_now:
                    series_now, a, begun = name, 0.0, True
                r = 0.0 if r is None and null_as_zero else r
                a = None if r is None or a is None else decay * a + r
                out.append(a)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*batch.schema.names, new_col])

    dealt = base.repartition(*[F.col(k) for k in keys]) if keys else base.repartition(1)
    return dealt.sortWithinPartitions(*keys, F.col(time_col).asc_nulls_last()).mapInArrow(run, schema)


def frequency_seconds(freq: str) -> int:
    m = re.fullmatch(r"(\d*)\s*(s|min|t|h|d)", freq.strip().lower())
    if not m or m[1] == "0":
        raise ValueError(f"Unknown frequency '{freq}'")
    return int(m[1] or 1) * _UNITS[m[2]]


def hourly_grid(df: DataFrame, time_col: str = "ts", keys: Sequence[str] = (), step_seconds: int = 3600) -> DataFrame:
    """Keys and every step from each key's first to last time (bins already). A key's span is dealt
    out in stretches of 4096 steps, so that no array and no task holds a long one."""
    ends = df.groupBy(*keys).agg(F.min(time_col).alias("_a"), F.max(time_col).alias("_b")).where("_a IS NOT NULL")
    stretch = F.expr(f"INTERVAL {4096 * step_seconds} SECONDS")
    parts = ends.select(*keys, "_b", F.explode(F.sequence("_a", "_b", stretch)).alias("_a"))
    last = F.least("_b", F.col("_a") + F.expr(f"INTERVAL {4095 * step_seconds} SECONDS"))
    return parts.repartition(*keys, "_a").select(*keys, F.explode(F.sequence("_a", last, F.expr(f"INTERVAL {step_seconds} SECONDS"))).alias(time_col))


def resample_mean(df: DataFrame, columns: Sequence[str], freq: str = "1h", time_col: str = "ts", keys: Sequence[str] = ()) -> DataFrame:
    """Means per time bin (left-closed, named by its start) on a dense grid; empty bins are null,
    rows without a time are left out. Bins start at midnight UTC."""
    step = frequency_seconds(freq)
    binned = (
        df.where(F.col(time_col).isNotNull())
        .groupBy(*keys, F.timestamp_seconds(F.floor(F.unix_timestamp(time_col) / step) * step).alias(time_col))
        .agg(*[F.avg(c).alias(c) for c in columns])
    )
    return hourly_grid(binned, time_col, keys, step).join(binned, [*keys, time_col], "left")


def fill_both_ways(df: DataFrame, columns: Sequence[str], time_col: str = "ts", keys: Sequence[str] = ()) -> DataFrame:
    """Nulls take the last value before them, leading ones the first after, which is the first of the series."""
    w = series(time_col, keys)
    before, all_rows = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumns({c: F.coalesce(F.last(c, True).over(before), F.first(c, True).over(all_rows)) for c in columns})


def infer_frequency(df: DataFrame, time_col: str = "ts", keys: Sequence[str] = ()) -> DataFrame:
    """freq_seconds per key: the one distance between times, or null if there are several, or
    fewer than three rows."""
    gaps = df.where(F.col(time_col).isNotNull()).withColumn("_gap", F.unix_timestamp(time_col) - F.lag(F.unix_timestamp(time_col)).over(series(time_col, keys)))
    return gaps.groupBy(*keys).agg(F.when((F.count("*") >= 3) & (F.min("_gap") == F.max("_gap")) & (F.min("_gap") > 0), F.min("_gap")).alias("freq_seconds"))


def split_column(time_col: str, train_end: str, val_end: str | None = None) -> Column:
    """'train' up to train_end, 'val' up to val_end, then 'test'. A date is its midnight."""
    if train_end is None:
        raise ValueError("split.train_end is null: set it to a date within the data")
    t, end = F.col(time_col), F.to_timestamp(F.lit(str(train_end)))
    out = F.when(t <= end, "train")
    if val_end is not None:
        out = out.when(t <= F.to_timestamp(F.lit(str(val_end))), "val")
    return out.when(t.isNotNull(), "test")


def chronological_split(df: DataFrame, train_end: str, val_end: str | None = None, time_col: str = "ts") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(train, val, test) as filters on the time column; val is empty without val_end."""
    if not isinstance(df.schema[time_col].dataType, (T.TimestampType, T.TimestampNTZType)):
        raise TypeError(f"'{time_col}' is not a timestamp")
    marked = df.withColumn("_split", split_column(time_col, train_end, val_end))
    return tuple(marked.where(F.col("_split") == s).drop("_split") for s in ("train", "val", "test"))


def positional_split(df: DataFrame, fraction: float = 0.8, time_col: str = "ts", keys: Sequence[str] = ()) -> DataFrame:
    """``is_train``: whether a row is among the first floor(fraction * n) of its series."""
    w = series(time_col, keys)
    n = F.count("*").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return df.withColumn("is_train", F.row_number().over(w) <= F.floor(n * F.lit(fraction)))


def extract_xy(
    df: DataFrame, target_col: str = "water_level_m", forecast_horizon: int = 1, drop_na: bool = True, time_col: str = "ts", keys: Sequence[str] = (), rows_per_range: int | None = None,
) -> DataFrame:
    """``label`` is the target ``forecast_horizon`` rows on; the target itself goes; rows with a
    null in any column go too with ``drop_na``. With ``rows_per_range`` long series are cut into time ranges."""
    if target_col not in df.columns:
        raise ValueError(f"Target column '{target_col}' not found. Available: {df.columns}")

    def label(rows: DataFrame, by: list[str]) -> DataFrame:
        return rows.withColumn("label", F.lead(target_col, forecast_horizon).over(series(time_col, by))).drop(target_col)

    out = _over_ranges(df, label, time_col, keys, rows_per_range, ahead=max(forecast_horizon, 0), back=max(-forecast_horizon, 0))
    return out.na.drop(subset=[c for c in out.columns if c not in keys and c != time_col]) if drop_na else out


def forecast_frame(
    df: DataFrame, target_col: str = "water_level_m", horizons: Sequence[int] = (1, 3, 6, 12), drop_na: bool = True, time_col: str = "ts", keys: Sequence[str] = (), rows_per_range: int | None = None,
) -> DataFrame:
    """A row for every row and forecast horizon: ``horizon`` in rows and ``label``, the target that many rows on. All
    leads come from one window; with ``drop_na`` rows without a label go. The target stays as a feature."""
    if target_col not in df.columns:
        raise ValueError(f"Target column '{target_col}' not found. Available: {df.columns}")
    if not horizons or min(horizons) < 1:
        raise ValueError(f"Horizons are positive numbers of rows, not {list(horizons)}")

    def leads(rows: DataFrame, by: list[str]) -> DataFrame:
        w = series(time_col, by)
        return rows.withColumn("_leads", F.array(*[F.struct(F.lit(int(h)).alias("horizon"), F.lead(target_col, h).over(w).alias("label")) for h in horizons]))

    wide = _over_ranges(df.drop("horizon", "label"), leads, time_col, keys, rows_per_range, ahead=max(horizons))
    out = wide.withColumn("_lead", F.explode("_leads")).withColumns({"horizon": F.col("_lead")["horizon"], "label": F.col("_lead")["label"]}).drop("_leads", "_lead")
    return out.where("label IS NOT NULL") if drop_na else out


def _over_ranges(df: DataFrame, compute, time_col: str, keys: Sequence[str], rows_per_range: int | None, back: int = 0, ahead: int = 0) -> DataFrame:
    return in_time_ranges(df, compute, time_col, keys, rows_per_range, back, ahead) if rows_per_range else compute(df, list(keys))


def build_features(df: DataFrame, cfg: dict, time_col: str = "ts", keys: Sequence[str] = (), decay_factor: float = 0.9, rows_per_range: int | None = None) -> DataFrame:
    """Lags, rainfall sums, deltas and the wetness index as ``cfg['features']`` names them. With
    ``rows_per_range`` long series are cut into time ranges."""
    spec, target = cfg.get("features", {}), cfg.get("data", {}).get("target_col", "water_level_m")
    dynamic = [c for c in spec.get("dynamic_sensor_cols", []) if c in df.columns]
    rain = [c for c in ("rainfall_mm_hr", "upstream_rainfall_mm_hr") if c in df.columns]
    lags, sums, deltas = spec.get("lag_hours", [1, 3, 6, 12, 24]), spec.get("rolling_sum_windows", [3, 6, 12, 24]), spec.get("delta_features", [])

    def windowed(rows: DataFrame, by: list[str]) -> DataFrame:
        out = add_rolling_features(add_lag_features(rows, dynamic, lags, time_col, by), rain, sums, "sum", time_col, by)
        for delta in deltas:
            out = add_rate_of_rise(out, delta.get("col", target), delta.get("windows", [1, 3, 6]), time_col, by)
        return out

    steps = [*lags, *sums, *[n for delta in deltas for n in delta.get("windows", [1, 3, 6])]]
    out = _over_ranges(df, windowed, time_col, keys, rows_per_range, max([0, *steps]), -min([0, *steps]))
    if "rainfall_mm_hr" in df.columns:
        out = add_antecedent_precipitation_index(out, "rainfall_mm_hr", decay_factor, time_col=time_col, keys=keys, rows_per_range=rows_per_range)
    return out.drop(*[c for c in spec.get("drop_cols") or [] if c in out.columns])


def engineer_flood_features(
    df: DataFrame, lag_hours: Sequence[int] | None = None, rolling_windows: Sequence[int] | None = None, time_col: str = "ts", keys: Sequence[str] = (), rows_per_range: int | None = None,
) -> DataFrame:
    """Features of the flood comparison: rainfall sums and wetness index, level lags and deltas. With
    ``rows_per_range`` long series are cut into time ranges."""
    lags, sums = lag_hours or [1, 3, 6, 12, 24], rolling_windows or [1, 3, 6, 12, 24]

    def windowed(rows: DataFrame, by: list[str]) -> DataFrame:
        out = add_rolling_features(rows, ["rainfall_mm_hr"], sums, "sum", time_col, by) if "rainfall_mm_hr" in df.columns else rows
        if "water_level_m" in df.columns:
            out = add_rate_of_rise(add_lag_features(out, ["water_level_m"], lags, time_col, by), "water_level_m", (1, 3, 6), time_col, by)
        return out

    out = _over_ranges(df, windowed, time_col, keys, rows_per_range, max([6, *lags, *sums]), -min([0, *lags]))
    if "rainfall_mm_hr" in df.columns:
        out = add_antecedent_precipitation_index(out, "rainfall_mm_hr", time_col=time_col, keys=keys, rows_per_range=rows_per_range)
    return out
