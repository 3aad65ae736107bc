"""A table's files as a stream: what a streaming operator gives for data that is there already."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from freshet.sources.shared import shared_folder
from freshet.streaming.stateful import ROCKSDB

_STORE = "spark.sql.streaming.stateStore.providerClass"


def _readable(spark: SparkSession, path: str) -> str:
    """The path as a stream can read it: a folder as it is, a single file as a pattern that matches only it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    single = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile()
    return f"{path[:-1]}[{path[-1]}]" if single else path


def replay(spark: SparkSession, path: str, build: Callable[[DataFrame], DataFrame], files_per_trigger: int | None = None) -> DataFrame:
    """Run ``build`` over the Parquet table at ``path`` as a stream, to its end, and return the rows that it gave.

    Rows still within the watermark's delay at the end stay with the state, as they would in a stream that goes on.
    Files are taken in the order of their times of change: with ``files_per_trigger`` a row may come behind the
    watermark of files before it and is then left out, as in any stream; without it all files are one batch, no
    row is late and the result doesn't hang on how the table is cut, but state holds whatever the operator
    keeps of the whole table (RocksDB, on the executors' disks). State, offsets and rows are in the shared folder, so a lost
    executor costs a repeated batch. An empty table gives no rows.
    """
    source = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger is not None:
        source = source.option("maxFilesPerTrigger", files_per_trigger)
    result = build(source.parquet(_readable(spark, path)))
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, ROCKSDB)
    folder = shared_folder(spark, "replay")
    try:
        query = result.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/rows").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(_STORE)
        else:
            spark.conf.set(_STORE, before)
    return spark.read.schema(result.schema).parquet(f"{folder}/rows")
