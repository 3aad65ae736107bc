"""Long series cut into time ranges, so that one key, or a table without keys, uses many tasks.

A key of more than ``rows_per_range`` rows is cut at times: its span is dealt into equal cells,
cells are counted, and neighbouring cells make ranges of about that many rows. What looks
back n rows works on each range with a *halo*, the rows of the cells that hold the last n rows
before it, and gives the result for the range's own rows. What looks back without limit
goes by the ranges' ends: a row a range is scanned in order and its outcome joined back.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Cells a range: the more, the evener the ranges of a series with bursts.
CELLS = 16
#: Rows of a table of cells that are sent to every task; a larger one is joined by key.
SENT = 500_000
#: The cell of rows without a time, which come last.
_UNTIMED = 2**62
OWN = ("_range", "_own")


def time_number(df: DataFrame, time_col: str) -> Column:
    """A long that orders like the time column: microseconds, days or the number itself."""
    kind, t = df.schema[time_col].dataType, F.col(f"`{time_col}`")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(t)
    if isinstance(kind, T.TimestampNTZType):  # by date and time of day: no time zone has a say
        seconds = (F.hour(t) * 3600 + F.minute(t) * 60).cast("long")
        return F.unix_date(F.to_date(t)) * F.lit(86_400_000_000) + seconds * F.lit(1_000_000) + (F.date_part(F.lit("SECOND"), t) * 1_000_000).cast("long")
    if isinstance(kind, T.DateType):
        return F.unix_date(t).cast("long")
    if isinstance(kind, T.IntegralType):
        return t.cast("long")
    raise TypeError(f"'{time_col}' is a {kind.simpleString()}: neither a time nor a whole number")


def _sent(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SENT else df


def joined_left(df: DataFrame, small: DataFrame, by: Sequence[str], rows: int) -> DataFrame:
    """``df`` with the columns of ``small`` (one row a key, nulls are keys), by a left join."""
    names = {c: f"_j{k}" for k, c in enumerate(by)}
    right = small.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in small.columns])
    same = [F.col(f"`{c}`").eqNullSafe(F.col(n)) for c, n in names.items()]
    return df.join(_sent(right, rows), same, "left").drop(*names.values())


def cut_into_ranges(df: DataFrame, time_col: str, keys: Sequence[str], rows_per_range: int, back: int = 0, ahead: int = 0) -> DataFrame | None:
    """The rows with ``_range``, the number of a range within its key, and ``_own``: every row once as
    its range's own, and again in every range whose halo it belongs to (``back`` rows before the range
    and ``ahead`` rows after it, or more, whole cells). None where no key is long enough to be cut.

    Rows of one time stay together, those without a time are one cell. The tables that are joined
    have a row a long key (at most rows / rows_per_range) and a row a cell (about ``CELLS`` times as
    many); by that bound they are sent to tasks or joined by key.
    """
    if rows_per_range < 1 or {c.lower() for c in df.columns} & set(OWN):
        raise ValueError("rows_per_range is 1 at least, and no column may be named _range or _own")
    single = not keys
    by = list(keys) if keys else ["_one"]
    rows = df.withColumn("_one", F.lit(0)) if single else df
    at = time_number(df, time_col)
    sizes = rows.groupBy(*by).agg(F.min(at).alias("_t0"), F.max(at).alias("_t1"), F.count("*").alias("_n")).where(F.col("_n") > rows_per_range)
    n_long, n_rows = sizes.agg(F.count("*"), F.coalesce(F.sum("_n"), F.lit(0))).first()
    if not n_long:
        return None
    n_cells = (CELLS + 1) * (n_rows // rows_per_range + n_long) + n_long
    wide = F.greatest(F.lit(1), F.ceil((F.col("_t1") - F.col("_t0") + 1) / (CELLS * F.ceil(F.col("_n") / rows_per_range)))).cast("long")
    long_keys = sizes.select(*by, "_t0", F.coalesce(wide, F.lit(1)).alias("_width"))
    placed = joined_left(rows, long_keys, by, n_long).withColumn(
        "_cell", F.when(F.col("_width").isNotNull(), F.coalesce(((at - F.col("_t0")) / F.col("_width")).cast("long"), F.lit(_UNTIMED)))
    ).drop("_t0", "_width")

    order = Window.partitionBy(*by).orderBy("_cell")
    cells = placed.where(F.col("_cell").isNotNull()).groupBy(*by, "_cell").agg(F.count("*").alias("_c"))
    cells = cells.withColumn("_before", F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")).withColumn("_through", F.col("_before") + F.col("_c"))
    cells = cells.withColumn("_r", F.floor(F.col("_before") / rows_per_range).cast("long"))
    begins, ends = F.col("_r") != F.lag("_r").over(order), F.col("_r") != F.lead("_r").over(order)
    cells = cells.select("*", F.when(begins, F.col("_r")).alias("_begin"), F.when(ends, F.col("_r")).alias("_end"))
    # the ranges that begin within `back` rows after a cell, and those that end within `ahead` rows before it
    after = F.collect_list("_begin").over(Window.partitionBy(*by).orderBy("_before").rangeBetween(0, max(back - 1, 0)))
    until = F.collect_list("_end").over(Window.partitionBy(*by).orderBy("_through").rangeBetween(-max(ahead - 1, 0), 0))
    cells = cells.withColumns({"_after": after if back else F.array().cast("array<bigint>"), "_until": until if ahead else F.array().cast("array<bigint>")})
    none = F.array().cast("array<bigint>")
    cells = cells.select(*by, "_cell", "_r", F.array_distinct(F.concat(F.array("_r"), F.coalesce(F.lead("_after").over(order), none), F.coalesce(F.lag("_until").over(order), none))).alias("_to"))
    out = joined_left(placed, cells, [*by, "_cell"], n_cells).drop("_cell")
    out = out.withColumn("_r", F.coalesce("_r", F.lit(0))).withColumn("_range", F.explode(F.coalesce("_to", F.array(F.lit(0).cast("bigint")))))
    return out.withColumn("_own", F.col("_range") == F.col("_r")).drop("_r", "_to", *(["_one"] if single else []))


def in_time_ranges(
    df: DataFrame, compute: Callable[[DataFrame, list[str]], DataFrame], time_col: str = "ts", keys: Sequence[str] = (),
    rows_per_range: int = 1_000_000, back: int = 0, ahead: int = 0,
) -> DataFrame:
    """``compute(rows, keys)`` over series of any length, one task a time range.

    ``compute`` adds columns (or drops rows) by windows that reach ``back`` rows back and ``ahead`` rows on at
    most, and passes all columns on; it gets the keys with the range among them. The result is that of
    ``compute(df, keys)``; where rows of one key share a time, each range may order them in its own way, as
    any two runs may. A key with as many rows as ``rows_per_range`` or fewer, and a table where all have, goes
    through as it is.
    """
    cut = cut_into_ranges(df, time_col, keys, rows_per_range, back, ahead)
    if cut is None:
        return compute(df, list(keys))
    return compute(cut, [*keys, "_range"]).where("_own").drop(*OWN)


def carried(ends: DataFrame, keys: Sequence[str], step: Callable[[tuple | None, tuple], tuple], values: str) -> DataFrame:
    """For each range, what its predecessors within the key hand on: ``ends`` has keys, ``_range`` and
    the range's own outcome; ``step`` takes what was handed on so far (None at a key's first range) and that
    outcome. Gives keys, ``_range`` and the columns of the schema ``values``.

    The ranges of long keys pass through the driver in order, one at a time: at most twice the
    long keys' rows over ``rows_per_range``.
    """
    spark = ends.sparkSession
    out, last, held = [], object(), None
    for row in ends.orderBy(*[F.col(f"`{k}`") for k in keys], "_range").toLocalIterator():
        key, outcome = tuple(row[k] for k in keys), tuple(row[c] for c in ends.columns if c not in keys and c != "_range")
        held = None if key != last else held
        if held is not None:
            out.append((*key, row["_range"], *held))
        held, last = step(held, outcome), key
    fields = [ends.schema[k] for k in keys] + [ends.schema["_range"]] + T._parse_datatype_string(values).fields
    return spark.createDataFrame(out, T.StructType([T.StructField(f.name, f.dataType) for f in fields]))
