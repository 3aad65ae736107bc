"""A training-data pipeline of five operators over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; its
result is written as Parquet and read again as the next one's docs. All but the last
return the columns of ``documents``, with ``n_chars`` brought up to date where the text
changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm.chosen_path import near_duplicates
from freshet.llm.common import materialise
from freshet.llm.decision_list import keep_good
from freshet.llm.line_dedup import drop_repeated_lines
from freshet.llm.mixing import mix_sources
from freshet.llm.packing import Capacities, pack_documents
from freshet.llm.queries import tokenizer_path


def _packed(docs: DataFrame, *needed: str) -> DataFrame:
    """The columns that an operator reads, and all others in one struct, where no name clashes
    with a column that the operator adds."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in needed]
    return docs.select(*needed, *([F.struct(*rest).alias("_rest")] if rest else []))


def _unpacked(out: DataFrame, docs: DataFrame, *needed: str) -> DataFrame:
    """The columns of ``docs`` from what an operator made of :func:`_packed`."""
    return out.select(*[F.col(c) if c in needed else F.col("_rest")[c].alias(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the decision list learned from ``labels`` reject go.

    Each row is judged by its own text: rows of a null or repeated id too, which only aren't
    or are more than once labelled. A null or empty text has no words and goes. Other columns
    pass as they are, whatever their names. An empty table gives an empty table.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return keep_good(docs, labels)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 characters or more in three documents or more stay in one of them.

    Every row comes out. Rows of a null id keep all lines and don't count; rows that repeat an
    id are one document for the counts. A null text becomes empty. ``n_chars`` is brought up to
    date; other columns pass as they are, whatever their names. An empty table gives an empty table.
    """
    needed = ("doc_id", "text")
    out = _unpacked(drop_repeated_lines(_packed(docs, *needed), min_chars=20, min_docs=3), docs, *needed)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: that of the smallest id.

    Word shingles of five words and a similarity of 0.8: a copy in which one word of n was
    changed differs in up to five shingles, so near copies of up to about one change in 45 words
    go. Shorter shingles would catch more of them, but also texts that share their phrases
    and not their order. A row of a null id or without words is linked with nothing and stays;
    rows that repeat a kept id all stay. Other columns pass as they are, whatever their names. An
    empty table gives an empty table.
    """
    needed = ("doc_id", "text")
    return _unpacked(near_duplicates(_packed(docs, *needed), shingle=5, percent=80).where("kept"), docs, *needed)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed 5:2:1 in turn: a document used e times becomes e equal rows, an unused one none.

    A null source is a source of its own, named null, and the last. Rows of null or repeated ids
    are documents of their own; a text without words has size 0 and its row stays where its
    source is used whole, as it takes nothing. Other columns pass as they are, whatever
    their names. An empty table gives an empty table.
    """
    needed = ("doc_id", "text", "source")
    mixed = mix_sources(_packed(docs, *needed), F.array("source"), weights=(5, 2, 1), max_epochs=3)
    used = mixed.where("epochs > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("epochs"))))
    return _unpacked(used, docs, *needed)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of every row, placed in sequences of 4096 tokens.

    Rows that repeat an id (copies of the stage before) are pieces of their own; a null or empty
    text is its end token. Only id and text are read. An empty table gives an empty table.
    """
    return pack_documents(docs, tokenizer_path(), Capacities(tokens=4096))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: Learned rules, seeded choices and token ids are beyond SQL; tests hold each stage
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the placed pieces of the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
