"""Connected components by alternating stars, and connecting members of groups block by block."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet.llm.common import discard, materialise

#: Members of a group that one task compares with each other; a larger group is dealt into
#: blocks of about half of it, with so many members of the group (pivots) in every block.
BLOCK, PIVOTS = 128, 16


def components(edges: DataFrame, id_type: T.DataType) -> DataFrame:
    """Smallest reachable id for every id in ``edges`` (a, b): columns id, component.

    Alternates the large star (every neighbour above me to my least neighbour) and the
    small star (every neighbour below me, and I, to the least) until every id has one
    parent that has none, which takes about log^2 rounds. Every step is a map-side
    combined minimum and a plain shuffle join, which adaptive execution splits at a hub;
    each round is written to the shared folder twice, and the one before it deleted. Loops are dropped.
    """

    def ordered(df: DataFrame) -> DataFrame:
        return df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    now = materialise(ordered(edges), "edges")
    while True:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        below = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        seen = materialise(both.join(below, "a"), "seen")
        # settled: the lower end of every edge is a root, and the least neighbour of the upper end
        if not seen.where("(b < a AND m <> b) OR (b > a AND m <> a)").limit(1).count():
            discard(seen)
            break
        large = seen.where("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        after = materialise(ordered(small), "edges")
        discard(now, seen)
        now = after
    up = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return up.union(roots).select(F.col("id").cast(id_type), F.col("component").cast(id_type))


def _labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least reachable index of each of n, by links i-j."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        after = label.copy()
        np.minimum.at(after, i, low)
        np.minimum.at(after, j, low)
        after = after[after]
        if (after == label).all():
            break
        label = after
    return label


def connect_blocks(rows: DataFrame, compare: Callable[[np.ndarray, list, np.ndarray], np.ndarray], id_type: T.DataType) -> DataFrame:
    """Edges (a, b) that connect within every block what ``compare`` links.

    ``rows``: block (long), id, size (long), payload (binary), at most a few hundred rows
    a block. ``compare(sizes, payloads, first)`` gets whole blocks, rows ``first[k]`` to
    ``first[k + 1]`` being the k-th, and returns all linked pairs as an array of row
    indices (n, 2). What is linked comes out as a star, so edges never outnumber rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: list[pa.RecordBatch] = []

        def flush(table: pa.Table) -> pa.RecordBatch:
            block = table.column("block").to_numpy()
            first = np.append(np.flatnonzero(np.append(True, block[1:] != block[:-1])), len(block))
            pairs = compare(table.column("size").to_numpy(), table.column("payload").to_pylist(), first)
            label = _labels(len(block), pairs[:, 0], pairs[:, 1])
            member = np.flatnonzero(label != np.arange(len(label)))
            ids = table.column("id").combine_chunks()
            return pa.RecordBatch.from_arrays([ids.take(pa.array(member)), ids.take(pa.array(label[member]))], names=["a", "b"])

        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                block = batch.column("block").to_numpy()
                last = int(np.searchsorted(block == block[-1], True)) if len(block) else 0
                if last == 0 and tail and tail[-1].column("block")[-1].as_py() == block[-1]:
                    tail.append(batch)
                    continue
                done = [*tail, batch.slice(0, last)]
                table = pa.Table.from_batches(done)
                tail = [batch.slice(last)]
                if table.num_rows:
                    yield flush(table)
        if tail:
            yield flush(pa.Table.from_batches(tail))

    schema = T.StructType([T.StructField("a", id_type), T.StructField("b", id_type)])
    return rows.select("block", "id", "size", "payload").repartition(F.col("block")).sortWithinPartitions("block", "id").mapInArrow(run, schema)


def deal_blocks(members: DataFrame) -> DataFrame:
    """``members``: grp (long), id, n (members of the group). Adds block: a small group is one
    block; a larger one is dealt by the hash of ids, and its pivots (one for each of
    PIVOTS slots of that hash, the least) go to every block of it."""
    parts = F.ceil(F.col("n") / F.lit(BLOCK // 2)).cast("int")
    small = members.where(F.col("n") <= BLOCK).select(F.col("grp").alias("block"), "id")
    large = members.where(F.col("n") > BLOCK).withColumn("_h", F.xxhash64("id", "grp"))
    dealt = large.select(F.xxhash64("grp", F.pmod("_h", parts).cast("int")).alias("block"), "id")
    pivots = (
        large.groupBy("grp", F.pmod(F.shiftright("_h", 32), F.lit(PIVOTS)).alias("_slot"))
        .agg(F.min(F.struct("_h", "id", "n")).alias("_p"))
        .select("grp", F.col("_p.id").alias("id"), F.col("_p.n").alias("n"))
        .withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
        .select(F.xxhash64("grp", "_part").alias("block"), "id")
    )
    return small.union(dealt).union(pivots)  # a pivot may be twice in its own block
