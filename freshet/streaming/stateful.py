"""Structured Streaming: hourly means behind a watermark, and the wetness index, over rows as they come with one number
of state a key, or in time order behind a watermark."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def hourly_means(stream: DataFrame, columns: Sequence[str], time_col: str = "ts", keys: Sequence[str] = (), late: str = "2 hours", width: str = "1 hour") -> DataFrame:
    """Means per key and hour; rows later than ``late`` behind the newest are left out. State is
    one partial mean a key and open hour."""
    windowed = stream.withWatermark(time_col, late).groupBy(*keys, F.window(time_col, width).alias("_w")).agg(*[F.avg(c).alias(c) for c in columns])
    return windowed.select(*keys, F.col("_w.start").alias(time_col), *columns)


def antecedent_index(stream: DataFrame, rainfall_col: str = "rainfall_mm_hr", decay: float = 0.9, time_col: str = "ts", key: str = "station_id") -> DataFrame:
    """a[t] = decay * a[t-1] + r[t] per key over arriving rows, in time order within a batch.

    State is the last value and time of a key. A row not after the last time of the batches
    before is too late for a recurrence and left out; rows of one time within a batch are
    all applied, as by the batch operator. A null rainfall makes all later values null.
    """

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value, poisoned, last = state.get if state.exists else (0.0, False, None)
        before = last
        data = pd.concat(list(frames)).sort_values("t", kind="stable")
        times, out = [], []
        for t, r in zip(data["t"], data["r"], strict=True):
            if before is not None and t <= before:
                continue
            poisoned = poisoned or pd.isna(r)
            value = value if poisoned else (decay * value + r)
            last = int(t)
            times.append(last)
            out.append(None if poisoned else value)
        state.update((float(value), bool(poisoned), last))
        yield pd.DataFrame({"key": [name[0]] * len(times), "t": times, "a": pd.Series(out, dtype="float64")})

    rows = stream.select(F.col(key).alias("key"), F.unix_micros(time_col).alias("t"), F.col(rainfall_col).cast("double").alias("r")).where("t IS NOT NULL")
    done = rows.groupBy("key").applyInPandasWithState(
        step, outputStructType=f"key {dict(stream.dtypes)[key]}, t long, a double", stateStructType="a double, p boolean, t long", outputMode="append", timeoutConf=GroupStateTimeout.NoTimeout,
    )
    return done.select(F.col("key").alias(key), F.timestamp_micros("t").alias(time_col), F.col("a").alias("antecedent_precipitation_index"))


def ordered_antecedent_index(stream: DataFrame, rainfall_col: str = "rainfall_mm_hr", decay: float = 0.9, time_col: str = "ts", key: str = "station_id", late: str = "2 hours") -> DataFrame:
    """a[t] = decay * a[t-1] + r[t] per key in the order of time, whatever order rows come in, as the batch operator gives it.

    A row is held until the watermark, ``late`` behind the newest time of the stream, has passed it; a timer gives
    it out even if its key has no new rows. Rows of one time are applied from the smallest rainfall on, nulls
    first. A null (NaN) rainfall makes all later values null. Rows without a time or a key, and rows from before 1970, are left out;
    so are rows behind the watermark of the batch before, as hourly means leave them out, and those from before what their key has
    given out already.

    State a key is its rows of the last ``late``, one number and one timer, whatever the length of the stream. It is one
    value, which comes and goes with the key's rows: calls to the store from Python, a time held each, cost more than the rows.
    """

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value, poisoned, upto, times, rain = state.get if state.exists else (0.0, False, None, [], [])
        held = list(zip(times, rain, strict=True))
        for frame in frames:
            held += [(t, r) for t, r in zip(frame["t"].tolist(), frame["r"].tolist(), strict=True) if upto is None or t > upto]
        # rows of one time in the order of their values, so that the result doesn't hang on how they came
        held.sort(key=lambda row: (row[0], row[1] == row[1], row[1] if row[1] == row[1] else 0.0))
        passed = state.getCurrentWatermarkMs() * 1000
        n = bisect_right(held, passed, key=lambda row: row[0])
        out = []
        for _, r in held[:n]:
            poisoned = poisoned or r != r
            value = value if poisoned else decay * value + r
            out.append(None if poisoned else value)
        state.update((value, poisoned, passed if n else upto, [t for t, _ in held[n:]], [r for _, r in held[n:]]))
        if n < len(held):
            # goes off in the first batch whose watermark is beyond it, so at the whole millisecond not before the first time held
            state.setTimeoutTimestamp(max(-(-held[n][0] // 1000) - 1, 1))
        if n:
            yield pd.DataFrame({"key": [name[0]] * n, "t": [t for t, _ in held[:n]], "a": pd.Series(out, dtype="float64")})

    kind = dict(stream.dtypes)[key]
    rows = stream.withWatermark(time_col, late).where(F.col(time_col).isNotNull() & F.col(key).isNotNull())
    rows = rows.select(F.col(key).alias("key"), F.unix_micros(F.col(time_col).cast("timestamp")).alias("t"), F.coalesce(F.col(rainfall_col).cast("double"), F.lit(float("nan"))).alias("r"), F.col(time_col).alias("seen")).where("t >= 0")
    done = rows.groupBy("key").applyInPandasWithState(
        step, outputStructType=f"key {kind}, t long, a double", stateStructType="value double, poisoned boolean, upto long, t array<long>, r array<double>",
        outputMode="append", timeoutConf=GroupStateTimeout.EventTimeTimeout,
    )
    return done.select(F.col("key").alias(key), F.timestamp_micros("t").alias(time_col), F.col("a").alias("antecedent_precipitation_index"))
