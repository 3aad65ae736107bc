"""Masks of areas (basins): which areas hold which points, by the cells of a grid.

An area is a set of closed rings under the even-odd rule: an outer ring, holes, several parts. A point is
inside if a ray from it to greater x crosses an odd number of edges, where an edge from (x1, y1) to (x2, y2) is crossed if
(y1 > y) <> (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1). Tables of edges and cells are built-in functions;
no area is compared with a point outside the cells it covers. Where a border has many edges in a row of cells, its
points meet them in Arrow groups, by searches in the order of edges that don't cross.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: By this share of its distance in cells an edge's cells are widened, so that rounding can't leave one out.
SLACK = 1e-9
#: Clusters of more edges are searched in groups rather than tested edge by edge.
FEW = 64
#: About so many points of a cluster are searched by one group.
BLOCK = 200_000
_EDGE = "struct<x1:double,y1:double,x2:double,y2:double>"


def _finite(*values: Column) -> Column:
    out = F.lit(True)
    for v in values:
        out = out & v.isNotNull() & (F.abs(v) < F.lit(float("inf")))
    return out


def ring_edges(vertices: DataFrame, id_col: str = "area_id", ring_col: str = "ring", order_col: str = "seq", x_col: str = "x", y_col: str = "y") -> DataFrame:
    """Edges ``(id_col, x1, y1, x2, y2)`` of rings given as a row a vertex; the last vertex of a ring is joined to
    the first, whether or not it repeats it. Vertices without an area, a place in the ring or finite coordinates
    are left out, as are edges from a vertex to itself; of vertices of one place the smaller x, then y, comes first.
    """
    x, y = F.col(f"`{x_col}`").cast("double"), F.col(f"`{y_col}`").cast("double")
    rows = vertices.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{ring_col}`").alias("_ring"), F.col(f"`{order_col}`").alias("_seq"), x.alias("x1"), y.alias("y1"))
    rows = rows.where(F.col("_id").isNotNull() & F.col("_seq").isNotNull() & _finite(F.col("x1"), F.col("y1")))
    ring = Window.partitionBy("_id", "_ring").orderBy("_seq", "x1", "y1")
    first = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    here = F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"))
    ends = rows.withColumn("_to", F.coalesce(F.lead(here).over(ring), F.first(here).over(first)))
    edges = ends.select(F.col("_id").alias(id_col), "x1", "y1", F.col("_to.x").alias("x2"), F.col("_to.y").alias("y2"))
    return edges.where("x1 <> x2 OR y1 <> y2")


def _crosses(edge, y: Column) -> Column:
    return (edge["y1"] > y) != (edge["y2"] > y)


def _to_the_right(edge, x: Column, y: Column) -> Column:
    return x < edge["x1"] + (y - edge["y1"]) * (edge["x2"] - edge["x1"]) / (edge["y2"] - edge["y1"])


def _cells(low: Column, high: Column) -> tuple[Column, Column]:
    """First and last cell of a stretch given in cells, widened."""
    def wide(v: Column) -> Column:
        return F.greatest(F.abs(v), F.lit(1.0)) * SLACK

    return F.floor(low - wide(low)), F.floor(high + wide(high))


def cover_areas(edges: DataFrame, cell: float, id_col: str = "area_id") -> DataFrame:
    """Cells of side ``cell`` that areas cover: ``(id_col, _row, _col, _before, _edges, _cluster, _many)``. Cells wholly
    inside have no edges. A cell on the border has the edges of its *cluster*, a maximal run of border cells of its area in its
    row, and ``_before``: whether what lies left of the cluster is inside. A cluster of more than ``FEW`` edges has them once,
    as ``_many`` of its first cell, whose column is the ``_cluster`` of all its cells; their ``_edges`` are empty.

    Each edge is clipped to the rows it passes. Within an area's row, sorted by first column, a running maximum of
    the last columns finds the gaps between clusters, and the running count of edges that cross the row's middle tells
    whether a gap is inside: an edge lies wholly left or right of a gap, and a vertex in the row has both
    its edges in one cluster, so the count's parity holds for every height in the row. That is one window over (area, row),
    linear in the edges. The number of rows is that of the cells covered: ``cell`` should be about the length of a few edges.
    """
    if not cell > 0:
        raise ValueError("the side of a cell is positive")
    side = F.lit(float(cell))
    rows = edges.where(F.col(f"`{id_col}`").isNotNull() & _finite(*[F.col(c) for c in ("x1", "y1", "x2", "y2")])).select(F.col(f"`{id_col}`").alias("_id"), "x1", "y1", "x2", "y2")
    bottom, top = _cells(F.least("y1", "y2") / side, F.greatest("y1", "y2") / side)
    rows = rows.withColumn("_row", F.explode(F.sequence(bottom, top)))

    def x_at(y: Column) -> Column:
        low, high = F.least("x1", "x2"), F.greatest("x1", "x2")
        at = F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
        return F.greatest(low, F.least(high, at))

    def clipped(y: Column) -> Column:
        return F.greatest(F.least("y1", "y2"), F.least(F.greatest("y1", "y2"), y))

    # the stretch in this row and, for the same reason as SLACK, a little of the rows beside it
    spare = F.greatest(F.abs(F.col("_row")), F.lit(1)) * SLACK * 2
    a, b = x_at(clipped((F.col("_row") - spare) * side)), x_at(clipped((F.col("_row") + 1 + spare) * side))
    level = F.col("y1") == F.col("y2")
    low, high = F.when(level, F.least("x1", "x2")).otherwise(F.least(a, b)), F.when(level, F.greatest("x1", "x2")).otherwise(F.greatest(a, b))
    first, last = _cells(low / side, high / side)
    middle = (F.col("_row") + 0.5) * side
    edge = F.struct("x1", "y1", "x2", "y2").cast(_EDGE)
    rows = rows.select("_id", "_row", first.alias("_from"), last.alias("_to"), edge.alias("_edge"), ((F.col("y1") > middle) != (F.col("y2") > middle)).cast("long").alias("_crosses"))

    order = Window.partitionBy("_id", "_row").orderBy("_from", "_to", "_edge")
    so_far, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"_reach": F.max("_to").over(so_far), "_left": F.max("_to").over(before), "_count": F.sum("_crosses").over(so_far), "_next": F.lead("_from").over(order)})
    opens = F.col("_left").isNull() | (F.col("_from") > F.col("_left") + 1)
    rows = rows.withColumns({"_opens": opens.cast("long"), "_inside_left": F.pmod(F.col("_count") - F.col("_crosses"), F.lit(2)) == 1})
    rows = rows.withColumn("_cluster", F.sum("_opens").over(so_far))

    clusters = rows.groupBy("_id", "_row", "_cluster").agg(
        F.min("_from").alias("_from"), F.max("_to").alias("_to"), F.max("_next").alias("_next"), F.max("_count").alias("_count"),
        F.min_by("_inside_left", F.struct(-F.col("_opens"), "_from")).alias("_before"), F.collect_list("_edge").alias("_edges"),
    )
    # a cluster is followed by its gap, if that is inside; at the last row of a cluster _next and _count are largest
    filled = (F.col("_next") > F.col("_to") + 1) & (F.pmod("_count", F.lit(2)) == 1)
    cells = clusters.withColumn("_col", F.explode(F.sequence("_from", F.when(filled, F.col("_next") - 1).otherwise(F.col("_to")))))
    border, many = F.col("_col") <= F.col("_to"), F.size("_edges") > FEW
    return cells.select(
        F.col("_id").alias(id_col), "_row", "_col", F.when(border, F.col("_before")).otherwise(True).alias("_before"),
        F.when(border & many, F.array().cast(f"array<{_EDGE}>")).when(border, F.col("_edges")).alias("_edges"),
        F.when(border & many, F.col("_from")).alias("_cluster"), F.when(many & (F.col("_col") == F.col("_from")), F.col("_edges")).alias("_many"),
    )


def _increasing(a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """Places of lines from ``a`` to ``b`` in as few chains as can be, both ends rising in each."""
    tails, chains = [], []
    for k in np.lexsort((b, a)):
        at = bisect_right(tails, b[k]) - 1
        if at < 0:
            tails.insert(0, b[k])
            chains.insert(0, [k])
        else:
            tails[at] = b[k]
            chains[at].append(k)
    return [np.array(c) for c in chains]


def _odd_left(x: np.ndarray, y: np.ndarray, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> np.ndarray:
    """Whether an odd number of edges crosses a point's height not to the right of it, a point.

    Points are halved by height. Edges that cross all heights of a part are put in the order of their places there, in
    chains of edges that don't cross, and each point is searched in a chain; places nearer than rounding can tell are
    tested by the rule. The other edges end within the part and go on to its halves: at most two parts of each level.
    """
    low, high = np.minimum(y1, y2), np.maximum(y1, y2)
    near = 1e-12 * max(np.abs(x1).max(initial=0.0), np.abs(x2).max(initial=0.0))
    by_height = np.argsort(y, kind="stable")
    px, py, n = x[by_height], y[by_height], np.zeros(len(x), dtype=np.int64)

    def at(e, h):
        return x1[e] + (h - y1[e]) * (x2[e] - x1[e]) / (y2[e] - y1[e])

    def search(a, b, e, first, last):
        h, v = py[a:b], px[a:b]
        t = (h - h[0]) / (h[-1] - h[0]) if h[-1] > h[0] else np.zeros(b - a)
        below, above = np.zeros(b - a, dtype=np.int64), np.full(b - a, len(e))
        for _ in range(len(e).bit_length()):
            mid = np.minimum((below + above) // 2, len(e) - 1)
            left = (first[mid] * (1 - t) + last[mid] * t < v - near) & (below < above)
            below, above = np.where(left, mid + 1, below), np.where(left, above, np.minimum(mid, above))
        n[a:b] += below
        unsure = np.arange(b - a)
        while len(unsure := unsure[below[unsure] < len(e)]):
            k = below[unsure]
            unsure = unsure[first[k] * (1 - t[unsure]) + last[k] * t[unsure] <= v[unsure] + near]
            k = below[unsure]
            n[a + unsure] += ~(v[unsure] < at(e[k], h[unsure]))
            below[unsure] += 1

    parts = [(0, len(x), np.nonzero(low < high)[0])] if len(x) else []
    while parts:
        a, b, e = parts.pop()
        bottom, top = py[a], py[b - 1]
        e = e[(low[e] <= top) & (high[e] > bottom)]
        if (b - a) * len(e) <= 16_384:
            h = py[a:b, None]
            with np.errstate(invalid="ignore", over="ignore"):
                n[a:b] += ((low[e] <= h) & (high[e] > h) & ~(px[a:b, None] < at(e, h))).sum(axis=1)
            continue
        across = (low[e] <= bottom) & (high[e] > top)
        through, e = e[across], e[~across]
        if len(through):
            first, last = at(through, bottom), at(through, top)
            order = np.argsort(first + last, kind="stable")
            up_first, up_last = np.maximum.accumulate(first[order]), np.maximum.accumulate(last[order])
            if (up_first - first[order]).max() <= near and (up_last - last[order]).max() <= near:
                search(a, b, through[order], up_first, up_last)
            else:
                for c in _increasing(first, last):
                    search(a, b, through[c], first[c], last[c])
        if len(e):
            middle = (a + b) // 2
            parts += [(a, middle, e), (middle, b, e)]
    odd = np.empty(len(x), dtype=bool)
    odd[by_height] = n % 2 == 1
    return odd


def _inside_cluster(points: pa.Table, cluster: pa.Table) -> pa.Table:
    """Of points in cells of one cluster those inside its area."""
    edges = cluster["_many"].combine_chunks().flatten()
    odd = _odd_left(points["_x"].to_numpy(), points["_y"].to_numpy(), *[edges.field(c).to_numpy() for c in ("x1", "y1", "x2", "y2")])
    return points.filter(pa.array(odd != cluster["_before"][0].as_py())).select(["_point", "_id"])


def points_in_areas(points: DataFrame, cover: DataFrame, cell: float, x_col: str = "x", y_col: str = "y", id_col: str = "area_id") -> DataFrame:
    """``points`` with ``id_col``, a row a point and area that holds it. ``cover`` comes from :func:`cover_areas` with
    the same ``cell``. Points without finite coordinates are in no area; repeated points stay repeated;
    a column of ``points`` named ``id_col`` is replaced.

    One equi-join on cells. Only points in border cells are tested, against the edges of one cluster. Points are never
    gathered by area: of a cell that many points share, the cover's side is a row an area, so the skew join can split it,
    and a small cover is broadcast by its size. Points in cells of clusters of many edges are dealt by cluster, in blocks of about
    ``BLOCK`` of them, and each block is searched with the cluster's edges in one Arrow group; that reads ``cover`` and
    ``points`` a second time, so a cover of many edges is better stored first.
    """
    side, kept = F.lit(float(cell)), [c for c in points.columns if c != id_col]
    x, y = F.col("_x"), F.col("_y")
    placed = points.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_point"), F.col(f"`{x_col}`").cast("double").alias("_x"), F.col(f"`{y_col}`").cast("double").alias("_y"))
    placed = placed.where(_finite(x, y)).withColumns({"_col": F.floor(x / side), "_row": F.floor(y / side)})
    left = F.aggregate("_edges", F.lit(0), lambda n, e: n + F.when(_crosses(e, y) & ~_to_the_right(e, x, y), 1).otherwise(0))
    inside = F.col("_edges").isNull() | ((F.pmod(left, F.lit(2)) == 1) != F.col("_before"))
    cover = cover.withColumnRenamed(id_col, "_id")
    few = placed.join(cover.where("_cluster IS NULL").drop("_cluster", "_many"), ["_row", "_col"]).where(inside).select("_point", "_id")

    cluster = ["_id", "_row", "_cluster"]
    to_search = placed.join(cover.where("_cluster IS NOT NULL").select(*cluster, "_col"), ["_row", "_col"])
    blocks = to_search.groupBy(*cluster).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("_blocks"))
    many = cover.where("_many IS NOT NULL").select(*cluster, "_before", "_many").join(blocks, cluster)
    # whichever rows come together in a block, each is judged alone
    dealt = to_search.withColumn("_any", F.monotonically_increasing_id()).join(blocks, cluster).withColumn("_block", F.pmod("_any", "_blocks"))
    by = [*cluster, "_block"]
    many = many.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    theirs = [f"{c}_of" for c in by]  # names of its own, since both sides come from the cover
    many = many.select("_before", "_many", *[F.col(c).alias(n) for c, n in zip(by, theirs, strict=True)])
    found = dealt.select("_point", "_x", "_y", *by).groupBy(*by).cogroup(many.groupBy(*theirs)).applyInArrow(_inside_cluster, few.schema)
    return few.unionAll(found).select(*[F.col("_point")[c].alias(c) for c in kept], F.col("_id").alias(id_col))


def area_means(points: DataFrame, cover: DataFrame, cell: float, columns: Sequence[str], x_col: str = "x", y_col: str = "y", id_col: str = "area_id", keys: Sequence[str] = ()) -> DataFrame:
    """``{c}_mean`` over the points in each area and group of ``keys`` (such as the hour), with ``n_points``; combined
    map-side, so an area that holds most points is no hot group."""
    read = dict.fromkeys([x_col, y_col, *columns, *keys])
    held = points_in_areas(points.select(*[F.col(f"`{c}`") for c in read]), cover, cell, x_col, y_col, id_col)
    return held.groupBy(id_col, *keys).agg(F.count(F.lit(1)).alias("n_points"), *[F.avg(c).alias(f"{c}_mean") for c in columns])
