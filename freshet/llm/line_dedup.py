"""Line dedup: explode normalised lines, hash them, count distinct documents per hash,
drop the lines over the threshold and reassemble the rest by position."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet.llm.common import LOWER, SPACES, UPPER, ascii_lower, materialise, restored, stowed

_FOLD = str.maketrans(UPPER, LOWER)


def line_key(line: Column) -> Column:
    """The normalised line: white space stripped at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def _digest(key: Column) -> Column:
    return F.unhex(F.md5(key.cast("binary")))


def drop_repeated_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 20,
    min_docs: int = 3,
) -> DataFrame:
    """Drop lines whose key stands in at least ``min_docs`` documents.

    A key shorter than ``min_chars`` code points never counts. The largest id that
    holds a frequent key keeps all its lines of that key, all other documents lose
    theirs; decisions rest on the input, not on what is left. The result has the
    columns of ``docs`` with the kept lines, joined by ``\\n``, in ``text_col``, and
    ``n_lines`` and ``n_dropped`` (long) which replace columns of those names.

    Edge cases: a null or empty text is one empty line (the kept text of a null is
    the empty string). Rows with a null id are not counted and keep every line.
    Rows that repeat an id are one document for the counts, and each such row is
    cleaned by itself. An empty table gives an empty table.

    At scale: one row per line and document goes into a two-level distinct count
    with map-side combine, so a line that a third of all documents hold is a partial
    sum in every task. Only keys over the threshold are written and joined back (a
    plain shuffle join, which adaptive execution splits on a hot line or turns into
    a broadcast below Spark's own size limit). Texts are shuffled once, by id.
    """
    docs, back = stowed(docs, [id_col, text_col], [id_col, text_col, "n_lines", "n_dropped"])
    spark_docs = docs.withColumnsRenamed({id_col: "_id", text_col: "_text"})
    lines = (
        spark_docs.where(F.col("_id").isNotNull())
        .select("_id", F.explode(F.split("_text", "\n", -1)).alias("_line"))
        .select("_id", line_key(F.col("_line")).alias("_key"))
        .where(F.length("_key") >= min_chars)
        .select("_id", _digest(F.col("_key")).alias("_h"))
    )
    lines = materialise(lines, "lines")
    frequent = (
        lines.groupBy("_h")
        .agg(F.count_distinct("_id").alias("_n"), F.max("_id").alias("_keeper"))
        .where(F.col("_n") >= min_docs)
        .select("_h", "_keeper")
    )
    frequent = materialise(frequent, "frequent")
    drops = (
        lines.join(frequent, "_h")
        .where(F.col("_id") < F.col("_keeper"))
        .groupBy("_id")
        .agg(F.collect_set("_h").alias("_drop"))
        .withColumnRenamed("_id", "_drop_id")
    )
    joined = spark_docs.select("_id", *back, "_text").join(
        drops, F.col("_id") == F.col("_drop_id"), "left"
    ).drop("_drop_id")
    fields = [f for f in joined.schema.fields if f.name != "_drop"]
    schema = T.StructType([*fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, totals, dropped = [], [], []
            for text, drop in zip(batch.column("_text").to_pylist(), batch.column("_drop").to_pylist(), strict=True):
                text = text or ""
                if not drop:
                    texts.append(text)
                    totals.append(text.count("\n") + 1)
                    dropped.append(0)
                    continue
                gone, all_lines = set(drop), text.split("\n")
                kept = []
                for line in all_lines:
                    key = line.strip(SPACES).translate(_FOLD)
                    if len(key) < min_chars or hashlib.md5(key.encode()).digest() not in gone:
                        kept.append(line)
                texts.append("\n".join(kept))
                totals.append(len(all_lines))
                dropped.append(len(all_lines) - len(kept))
            columns = {f.name: batch.column(f.name) for f in fields}
            columns["_text"] = pa.array(texts, pa.string())
            columns["n_lines"] = pa.array(totals, pa.int64())
            columns["n_dropped"] = pa.array(dropped, pa.int64())
            yield pa.RecordBatch.from_pydict(columns)

    out = joined.mapInArrow(reassemble, schema)
    return restored(out, {"_id": id_col, "_text": text_col, **back})
