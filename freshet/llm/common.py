"""Shared helpers of the corpus operators: scratch tables, word patterns, column hygiene."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a maximal run of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
#: The same white space as characters.
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

_written: list[tuple[SparkSession, str]] = []


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session leaves it unset, a local run (a test) gets a temporary folder, set as
    the checkpoint folder of the session; on a cluster that is an error, since executors
    wouldn't see each other's files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir is not set: {master} needs a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="freshet-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared scratch folder and read it back.

    Cuts lineage and survives lost executors, unlike a cached or locally
    checkpointed frame. The folder goes with :func:`discard` or :func:`release`, or when
    the Python process ends.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/freshet-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone already; the folder is only scratch
        pass


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables, as :func:`materialise` returned them, that nothing will read again:
    what was made of them must have been written."""
    for df in tables:
        path = df._scratch_path
        _delete(df.sparkSession, path)
        _written[:] = [x for x in _written if x[1] != path]


def release() -> None:
    """Delete every scratch table of this process."""
    while _written:
        _delete(*_written.pop())


atexit.register(release)


def extras(df: DataFrame, own: list[str]) -> list[str]:
    """Columns of df that don't clash (in any letter case) with an operator's own output columns."""
    low = {c.lower() for c in own}
    return [c for c in df.columns if c.lower() not in low]


def stowed(df: DataFrame, needed: list[str], own: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """The columns that an operator reads, and all others but those that its own results replace under
    names that no operator uses; with what those were called. :func:`restored` names them again."""
    back = {f"_kept{i}": c for i, c in enumerate(extras(df, own)) if c not in needed}
    return df.select(*[F.col(f"`{c}`") for c in needed], *[F.col(f"`{c}`").alias(k) for k, c in back.items()]), back


def restored(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in df.columns])


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def count_words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
