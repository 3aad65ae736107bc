"""Exact top-k inner-product search: ball-tree branch and bound per shard.

A shallow ball tree over a bounded sample gives *cells*; every vector goes to the cell of
the nearest centre, and each shard, a cell or a part of a large one, becomes one ball tree.
A query meets the cells in the order of their upper bounds of the inner product,
q.c + |q| r: first the best, then a few, then all whose bound still reaches its k-th score.
Queries are sent to trees, and walk a tree best-first by the same bound. After every wave
the k-th scores of all shards so far go with the queries into the next.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from freshet.llm.common import materialise

#: Vectors of a shard and of a leaf, about; queries that meet a shard in one group, about.
SHARD, LEAF, QUERIES = 8192, 64, 4096
#: Bounds of what goes through the driver and to all tasks: cells of one length of vectors, and
#: sampled vectors a cell.
MAX_CELLS, SAMPLE = 4096, 16
#: Cells that a query has met after each wave but the last, which meets the rest.
WAVES = (1, 4)
_LOW = np.iinfo(np.int64).min
#: Integer components stay below this.
LARGEST = 2.0**62


def quantise(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """id and v = floor(scale * x) of every component, as long; rows of a null id or vector
    or with a null or non-finite component are left out. A component of ``LARGEST`` or more is
    an error. An empty table gives an empty table."""
    x = F.col(f"`{vector_col}`")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < F.lit(float("inf"))))
    return vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & F.coalesce(finite, F.lit(False))).select(
        F.col(id_col).cast("long").alias("id"), F.transform(x, lambda e: F.when(F.abs(e.cast("double") * scale) < F.lit(LARGEST), F.floor(e.cast("double") * scale).cast("long")).otherwise(F.raise_error(F.lit("a component is too large for integer scores")))).alias("v")
    )


def build_tree(ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF) -> dict[str, np.ndarray]:
    """A ball tree as arrays: reordered ids and vectors, and per node start, end, left child
    (the right one follows it; 0 for a leaf), centre and radius."""
    order, nodes = np.arange(len(ids)), [(0, len(ids))]
    left, centres, radii = [], [], []
    data, at = vectors.astype(float), 0
    while at < len(nodes):
        a, b = nodes[at]
        x = data[order[a:b]]
        centre = x.mean(0)
        gap = np.sqrt(((x - centre) ** 2).sum(1))
        centres.append(centre)
        radii.append(gap.max() * (1 + 1e-9))
        if b - a > leaf and radii[-1] > 0:
            far = x[np.argmax(gap)]
            other = x[np.argmax(((x - far) ** 2).sum(1))]
            order[a:b] = order[a:b][np.argsort(x @ (other - far), kind="stable")]
            middle = (a + b) // 2
            left.append(len(nodes))
            nodes += [(a, middle), (middle, b)]
        else:
            left.append(0)
        at += 1
    start, end = np.array(nodes, np.int64).T
    return {"ids": ids[order], "vectors": vectors[order], "start": start, "end": end, "left": np.array(left, np.int64), "centres": np.array(centres), "radii": np.array(radii)}


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in floating point while no sum can reach 2^53."""
    a, b = a.astype(np.int64, copy=False), b.astype(np.int64, copy=False)
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] >= 2**62:
        exact = a.astype(object) @ b.astype(object).T
        if np.abs(exact).max() >= 2**63:
            raise OverflowError("an inner product is beyond a long")
        return exact.astype(np.int64)
    return a @ b.T


def upper_bound(queries: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """Bounds of the inner products of queries with what lies in balls: (queries, balls)."""
    norm = np.sqrt((queries**2).sum(1))
    return queries @ centres.T + norm[:, None] * radii[None, :] * (1 + 1e-9) + 1e-3


def search(tree: dict[str, np.ndarray], queries: np.ndarray, query_ids: np.ndarray, kth: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query index, id, score) of the candidates that may belong to a query's k best, given
    that its k-th score elsewhere is ``kth`` already, and how many products were computed.
    Best-first over nodes."""
    score = np.full((len(queries), k), _LOW)
    ident = np.full((len(queries), k), np.iinfo(np.int64).max)
    floor, real, scored = kth.copy(), queries.astype(float), 0
    everyone = np.arange(len(queries))
    bound = lambda node, who: upper_bound(real[who], tree["centres"][node : node + 1], tree["radii"][node : node + 1])[:, 0]
    first = bound(0, everyone)
    heap = [(-float(first.max(initial=0)), 0, everyone, first)]
    while heap:
        _, node, who, upper = heapq.heappop(heap)
        who = who[upper >= floor[who]]
        if not len(who):
            continue
        if child := int(tree["left"][node]):
            for c in (child, child + 1):
                b = bound(c, who)
                in_it = b >= floor[who]
                if in_it.any():
                    heapq.heappush(heap, (-float(b[in_it].max()), c, who[in_it], b[in_it]))
            continue
        a, b = tree["start"][node], tree["end"][node]
        ids = tree["ids"][a:b]
        got = _product(queries[who], tree["vectors"][a:b])
        scored += got.size
        got = np.where(ids[None, :] == query_ids[who][:, None], _LOW, got)
        better = (got >= floor[who][:, None]).any(1)
        who, got = who[better], got[better]
        if not len(who):
            continue
        both = np.concatenate([score[who], got], 1)
        names = np.concatenate([ident[who], np.broadcast_to(ids, got.shape)], 1)
        order = np.lexsort((names, -both.astype(float) if np.abs(got).max() < 2**52 else -(both + 1)), axis=1)[:, :k]
        score[who], ident[who] = np.take_along_axis(both, order, 1), np.take_along_axis(names, order, 1)
        floor[who] = np.maximum(floor[who], score[who, -1])
    query, place = np.nonzero((score > _LOW) & (score >= kth[:, None]))
    return query, ident[query, place], score[query, place], scored


def _matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), np.int64).reshape(rows, -1)


def _narrow(x: np.ndarray) -> np.ndarray:
    """The same integers in the narrowest type that holds them."""
    for kind in (np.int8, np.int16, np.int32):
        if not x.size or (x.min() >= np.iinfo(kind).min and x.max() <= np.iinfo(kind).max):
            return x.astype(kind)
    return x


def _cells(slim: DataFrame, shard_size: int) -> dict[int, np.ndarray]:
    """Cell centres by length of vectors: the leaves of a ball tree over a sample of ``SAMPLE``
    vectors a cell, at most SAMPLE * MAX_CELLS of a length."""
    sizes = {r["dim"]: r["n"] for r in slim.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # a row a length
    cells = {d: min(MAX_CELLS, -(-n // shard_size)) for d, n in sizes.items()}
    out = {d: np.zeros((1, d)) for d in sizes}
    for d, c in cells.items():
        if c == 1:
            continue
        share = max(1, sizes[d] // (2 * SAMPLE * c))
        rows = slim.where((F.col("dim") == d) & (F.pmod(F.xxhash64("id", "v"), F.lit(share)) == 0)).select("v").distinct().limit(SAMPLE * c).toArrow()
        if rows.num_rows:
            x = _matrix(rows.column("v"), rows.num_rows)
            tree = build_tree(np.arange(len(x)), x, max(1, len(x) // c))
            out[d] = tree["centres"][tree["left"] == 0][:MAX_CELLS]
    return out


def top_k(vectors: DataFrame, is_query, k: int = 20, shard_size: int = SHARD, group_size: int = QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k candidates of largest integer inner
    product with each query, ties to the smaller id.

    ``vectors``: id (long), v (array of long). ``is_query``: a condition over id. Candidates
    of a query are all rows of other ids with vectors of the same length; fewer than k
    give fewer rows. A repeated row is a candidate each time. A query id that repeats with
    different vectors is one query, by the shortest and then the least of them. Scores must
    fit a long. A null or empty vector takes no part. An empty table, or one without
    queries, gives an empty table.

    At scale: vectors are shuffled once, into shards of about ``shard_size``; a cell that is
    larger, of equal vectors too, is dealt by row over several shards. Cells (at most
    MAX_CELLS a length) are all that is broadcast or passes the driver. A wave sends each
    query (one small row) to the shards of cells whose bound reaches its k-th score, in
    groups of about ``group_size`` queries, each with a copy of that shard's tree. Where bounds
    rule out nothing, as for directions without clusters in many dimensions, every query
    meets every shard: that is the stated query set against all rows, in blocks.
    """
    return _top_k(vectors, is_query, k, shard_size, group_size)[0]


def _top_k(vectors: DataFrame, is_query, k: int, shard_size: int, group_size: int) -> tuple[DataFrame, list[DataFrame]]:
    """The result, and what every wave found with the number of products computed."""
    spark = vectors.sparkSession
    slim = materialise(vectors.select("id", "v", F.size("v").alias("dim")).where("dim > 0"), "vectors")
    centres = _cells(slim, shard_size)
    schema = "query_id long, vec_id long, score long, scored long"
    if not centres:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long"), []
    held = spark.sparkContext.broadcast(centres)  # at most MAX_CELLS vectors a length

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                dims = batch.column("dim").to_numpy()
                for d in np.unique(dims):
                    part = batch.take(pa.array(np.flatnonzero(dims == d)))
                    x = _matrix(part.column("v"), part.num_rows).astype(float)
                    c = held.value[int(d)]
                    cell = np.argmin((c**2).sum(1)[None, :] - 2 * (x @ c.T), 1)
                    gap = np.sqrt(((x - c[cell]) ** 2).sum(1))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell, pa.int32()), pa.array(gap)], names=["id", "v", "dim", "cell", "gap"])

    # The place in the written table deals rows of a large cell, of one id or vector too.
    dealt = materialise(slim.mapInArrow(assign, "id long, v array<long>, dim int, cell int, gap double").withColumn("deal", F.monotonically_increasing_id()), "cells")
    balls = dealt.groupBy("dim", "cell").agg(F.max("gap").alias("radius"), F.count("*").alias("n")).collect()  # a row a cell
    subs = F.broadcast(spark.createDataFrame([(r["dim"], r["cell"], -(-r["n"] // (2 * shard_size))) for r in balls], "dim int, cell int, subs long"))
    table = {}
    for d in centres:
        mine = [r for r in balls if r["dim"] == d]
        at = [r["cell"] for r in mine]
        table[d] = (np.array(at), centres[d][at], np.array([r["radius"] for r in mine]) * (1 + 1e-9))
    bounds = spark.sparkContext.broadcast(table)
    parts = {"ids": np.int64, "vectors": None, "start": np.int64, "end": np.int64, "left": np.int64, "centres": float, "radii": float}

    def plant(rows: pa.Table) -> pa.Table:
        tree = build_tree(rows.column("id").to_numpy(), _matrix(rows.column("v"), rows.num_rows))
        tree["vectors"] = _narrow(tree["vectors"])
        one = {c: rows.column(c)[:1] for c in ("dim", "cell", "sub")}
        return pa.table({**one, "kind": [tree["vectors"].dtype.str], **{p: pa.array([np.ascontiguousarray(tree[p]).tobytes()], pa.binary()) for p in parts}})

    shape = "dim int, cell int, sub long"
    shards = dealt.join(subs, ["dim", "cell"]).withColumn("sub", F.pmod(F.xxhash64("deal"), F.col("subs"))).select("dim", "cell", "sub", "id", "v")
    trees = materialise(shards.groupBy("dim", "cell", "sub").applyInArrow(plant, f"{shape}, kind string, " + ", ".join(f"{p} binary" for p in parts)), "trees")
    queries = materialise(
        slim.where(is_query).groupBy("id").agg(F.min(F.struct("dim", "v")).alias("q")).select("id", F.col("q.dim").alias("dim"), F.col("q.v").alias("v")), "queries")

    def meet(begin: int, end: int | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 256):
                    batch = whole.slice(at, 256)
                    dims, kth = batch.column("dim").to_numpy(), batch.column("kth").fill_null(_LOW).to_numpy()
                    for d in np.unique(dims):
                        rows = np.flatnonzero(dims == d)
                        part = batch.take(pa.array(rows))
                        cells, c, r = bounds.value[int(d)]
                        upper = upper_bound(_matrix(part.column("v"), part.num_rows).astype(float), c, r)
                        order = np.argsort(-upper, 1, kind="stable")[:, begin:end]
                        row, place = np.nonzero(np.take_along_axis(upper, order, 1) >= kth[rows][:, None])
                        for a in range(0, len(row), 2048):
                            i, j = row[a : a + 2048], place[a : a + 2048]
                            sent = part.take(pa.array(i))
                            yield pa.RecordBatch.from_arrays([sent.column("id"), sent.column("dim"), sent.column("v"), sent.column("kth"), pa.array(cells[order[i, j]], pa.int32())], names=["id", "dim", "v", "kth", "cell"])

        return run

    def visit(tree_rows: pa.Table, sent: pa.Table) -> pa.Table:
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * 4
        if tree_rows.num_rows and sent.num_rows:
            row = tree_rows.to_pylist()[0]
            dim = row["dim"]
            tree = {p: np.frombuffer(row[p], kind or row["kind"]) for p, kind in parts.items()}
            tree["vectors"], tree["centres"] = tree["vectors"].reshape(-1, dim), tree["centres"].reshape(-1, dim)
            ids, q = sent.column("id").to_numpy(), _matrix(sent.column("v"), sent.num_rows)
            kth = sent.column("kth").fill_null(_LOW).to_numpy()
            found = [(b, *search(tree, q[b : b + 256], ids[b : b + 256], kth[b : b + 256], k)) for b in range(0, len(ids), 256)]
            out = [np.concatenate([ids[f[1] + f[0]] for f in found]), np.concatenate([f[2] for f in found]), np.concatenate([f[3] for f in found])]
            count = np.zeros(len(out[0]), np.int64)
            count[:1] = sum(f[4] for f in found)
            out.append(count)
        return pa.table(dict(zip(("query_id", "vec_id", "score", "scored"), map(pa.array, out), strict=True)))

    best, waves, begin = None, [], 0
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    most = max(len(c) for c in centres.values())
    for end in (*WAVES, None):
        if begin >= most:
            break
        known = queries.withColumn("kth", F.lit(None).cast("long"))
        if best is not None:
            known = queries.join(best.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("kth")), "id", "left")
        sent = materialise(known.select("id", "dim", "v", "kth").mapInArrow(meet(begin, end), "id long, dim int, v array<long>, kth long, cell int"), "sent")
        counts = [(r["dim"], r["cell"], -(-r["n"] // group_size)) for r in sent.groupBy("dim", "cell").agg(F.count("*").alias("n")).collect()]  # a row a cell
        begin = end or most
        if not counts:
            continue
        groups = F.broadcast(spark.createDataFrame(counts, "dim int, cell int, groups long"))
        left = trees.join(groups, ["dim", "cell"]).withColumn("grp", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")
        right = sent.join(groups, ["dim", "cell"]).join(subs, ["dim", "cell"]).withColumn("sub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("subs") - 1)))
        right = right.withColumn("grp", F.pmod(F.xxhash64("id"), F.col("groups"))).select("dim", "cell", "sub", "grp", "id", "v", "kth")
        keys = ("dim", "cell", "sub", "grp")
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(visit, schema)
        waves.append(found)
        found = found.select("query_id", "vec_id", "score")
        found = found.union(best.select("query_id", "vec_id", "score")) if best is not None else found
        best = materialise(found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k), "best")
    if best is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long"), waves
    return best.select("query_id", "rank", "vec_id", "score"), waves
