"""Mixing sources to target weights: a min-cost flow routes the token capacity of
membership patterns to source quotas under convex repetition costs; seeded documents
then fill what each pattern was routed."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.llm.common import count_words, extras, materialise

#: Seeded order of documents is cut at one of so many buckets, then by rank inside that bucket.
BUCKETS = 4096


def fill_targets(sizes: Sequence[int], weights: Sequence[float], ceiling: float, total: float | None = None) -> list[float]:
    """Share ``total`` (by default ``sum(sizes)``) by weight; no share goes above ``ceiling`` times its own size,
    and what is above is shared again by weight among the others."""
    total, capped, n = float(sum(sizes) if total is None else total), set(), len(sizes)
    while True:
        rest = total - sum(ceiling * sizes[i] for i in capped)
        weight = sum(weights[i] for i in range(n) if i not in capped)
        share = [ceiling * sizes[i] if i in capped else (rest * weights[i] / weight if weight else 0.0) for i in range(n)]
        over = {i for i in range(n) if i not in capped and share[i] > ceiling * sizes[i]}
        if not over:
            return share
        capped |= over


def route(capacity: dict[str, int], members: dict[str, list], quota: dict, epochs: int) -> dict[str, dict]:
    """Min-cost flow: pattern -> source -> tokens.

    Each pattern offers its capacity ``epochs`` times; the e-th time costs e a token,
    so all first uses go before any second use. Successive shortest paths with
    potentials; every augmentation fills an edge, so the number of steps follows the
    number of patterns and sources, never that of documents.
    """
    names = ["S", "T", *(("p", p) for p in capacity), *(("q", s) for s in quota)]
    at = {x: i for i, x in enumerate(names)}
    graph: list[list[int]] = [[] for _ in names]
    to, left, cost = [], [], []

    def edge(a, b, cap, price):
        for u, v, c, w in ((at[a], at[b], cap, price), (at[b], at[a], 0, -price)):
            graph[u].append(len(to))
            to.append(v), left.append(c), cost.append(w)

    back = {}
    for p in sorted(capacity):
        for e in range(epochs):
            edge("S", ("p", p), capacity[p], e)
        for s in sorted({x for x in members[p] if x in quota}, key=str):
            back[p, s] = len(to)
            edge(("p", p), ("q", s), capacity[p] * epochs, 0)
    for s in sorted(quota, key=str):
        edge(("q", s), "T", quota[s], 0)

    potential = [0] * len(names)
    while True:
        dist, via = [float("inf")] * len(names), [-1] * len(names)
        dist[at["S"]], heap = 0, [(0, at["S"])]
        while heap:
            d, u = heapq.heappop(heap)
            if d > dist[u]:
                continue
            for k in graph[u]:
                nd = d + cost[k] + potential[u] - potential[to[k]]
                if left[k] > 0 and nd < dist[to[k]]:
                    dist[to[k]], via[to[k]] = nd, k
                    heapq.heappush(heap, (nd, to[k]))
        if dist[at["T"]] == float("inf"):
            break
        potential = [p + d if d < float("inf") else p for p, d in zip(potential, dist, strict=True)]
        step, v = float("inf"), at["T"]
        while v != at["S"]:
            step, v = min(step, left[via[v]]), to[via[v] ^ 1]
        v = at["T"]
        while v != at["S"]:
            left[via[v]] -= step
            left[via[v] ^ 1] += step
            v = to[via[v] ^ 1]
    flows: dict[str, dict] = defaultdict(dict)
    for (p, s), k in back.items():
        if left[k ^ 1]:
            flows[p][s] = left[k ^ 1]
    return flows


#: Documents up to size ``upto`` are used as far as row ``last`` of bucket ``cut``.
_CUTS = "array<struct<upto:long,cut:long,last:long>>"


def _chosen() -> Column:
    """Whether one of a pattern's ``_cuts`` takes a document."""
    return F.exists("_cuts", lambda c: (F.col("_size") <= c["upto"]) & ((F.col("_bucket") < c["cut"]) | F.coalesce((F.col("_bucket") == c["cut"]) & (F.col("_u") <= c["last"]), F.lit(False))))


def _fill(slim: DataFrame, still: dict[str, int]) -> tuple[dict[str, list], dict[str, int]]:
    """Cuts of every pattern, and the ``_u`` of one more document, that fill what is ``still`` open.

    A round goes through the unused documents of at most half of what is open, in seeded
    order. It uses all of them or more than half of what is open, so rounds follow the
    logarithm of that. Then only one of the unused can fit: the one of the nearest size
    is added if it brings the sum nearer.
    """
    spark, still = slim.sparkSession, dict(still)
    cuts: dict[str, list] = {p: [] for p in still}
    extra: dict[str, int] = {}

    def unused() -> DataFrame:
        state = spark.createDataFrame([(p, n, cuts[p]) for p, n in still.items()], f"_pattern string, _open long, _cuts {_CUTS}")
        return slim.join(F.broadcast(state), "_pattern").where(~_chosen())

    by_bucket = Window.partitionBy("_pattern").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    by_row = Window.partitionBy("_pattern").orderBy("_u", "_id", "_size").rowsBetween(Window.unboundedPreceding, 0)
    by_place = Window.partitionBy("_pattern").orderBy("_u").rangeBetween(Window.unboundedPreceding, 0)
    while still:
        fits = unused().where(2 * F.col("_size") <= F.col("_open"))
        over = F.col("_upto") > F.col("_open")
        found = (
            fits.groupBy("_pattern", "_bucket").agg(F.sum("_size").alias("_n"), F.first("_open").alias("_open"))
            .withColumn("_upto", F.sum("_n").over(by_bucket))
            .groupBy("_pattern").agg(F.min(F.when(over, F.col("_bucket"))).alias("cut"), F.coalesce(F.max(F.when(~over, F.col("_upto"))), F.lit(0)).alias("before"))
            .collect()
        )
        at = spark.createDataFrame([(r["_pattern"], r["cut"], still[r["_pattern"]] - r["before"]) for r in found if r["cut"] is not None], "_pattern string, _cut long, _left long")
        ends = (
            fits.join(F.broadcast(at), "_pattern").where(F.col("_bucket") == F.col("_cut"))
            .withColumn("_run", F.sum("_size").over(by_row)).withColumn("_all", F.sum("_size").over(by_place))
            .where(F.col("_run") <= F.col("_left")).groupBy("_pattern").agg(F.max("_u").alias("last"), F.max("_all").alias("filled"))
        )
        ends = {r["_pattern"]: r for r in ends.collect()} if any(r["cut"] is not None for r in found) else {}
        for r in found:
            p, end = r["_pattern"], ends.get(r["_pattern"])
            cuts[p].append((still[p] // 2, BUCKETS if r["cut"] is None else r["cut"], end["last"] if end else None))
            still[p] -= r["before"] + (end["filled"] if end else 0)
        still = {p: n for p, n in still.items() if n > 0}
        if not still:
            break
        gap = F.abs(F.col("_size") - F.col("_open"))
        left = unused().groupBy("_pattern").agg(
            F.min(F.when(gap < F.col("_open"), F.struct(gap.alias("gap"), F.col("_u").alias("u")))).alias("x"),
            F.max((F.col("_size") > 0) & (2 * F.col("_size") <= F.col("_open"))).alias("more"),
        )
        left = {r["_pattern"]: r for r in left.collect()}
        for p in list(still):
            r = left.get(p)
            if r is None or not r["more"] or r["x"]["gap"] == 0:
                if r is not None and r["x"] is not None:
                    extra[p] = r["x"]["u"]
                del still[p]
    return cuts, extra


def mix_sources(
    docs: DataFrame,
    sources: Column,
    weights: Sequence[float] = (5, 2, 1),
    max_epochs: int = 3,
    size: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 17,
    max_patterns: int = 100_000,
) -> DataFrame:
    """Decide how often each document is used so that every source nears its target.

    ``sources`` is an array column: the sources a document belongs to (a null element
    is a source of its own, named null). Sources are ordered by code point, null last,
    and weigh ``weights`` in turn; the targets share the sum of all documents' sizes, none
    above ``max_epochs`` times its source. Returns the columns of ``docs`` and
    ``size``, ``source_size``, ``target`` (of the first source), ``epochs`` (whole uses
    of the document, 0 to ``max_epochs``) and ``taken = size * epochs``; columns of
    those names in ``docs`` are replaced. The choice is a function of ``seed``, id and
    size alone, so reruns and other partitionings agree.

    Edge cases: a null text has size 0; a source of such documents alone has target 0; a document without sources is never taken.
    Rows that repeat an id are documents of their own with one place in the seeded
    order. An empty table gives an empty table.

    At scale: the driver sees one row per membership pattern (checked against
    ``max_patterns``, an error beyond it) and solves the flow on those. Documents are
    chosen by their seeded bucket: a histogram of ``BUCKETS`` sums a pattern, summed
    map-side, gives the bucket in which a quota ends, and only the documents of that
    one bucket are ranked. A hot source is spread over all its buckets. Documents too long
    for what is open are passed over, and the cut is repeated on what remains.
    """
    spark = docs.sparkSession
    own = ["size", "source_size", "target", "epochs", "taken"]
    back = {f"_kept{i}": c for i, c in enumerate(extras(docs, own))}
    sized = docs.select(
        *[F.col(f"`{c}`").alias(k) for k, c in back.items()], F.col(f"`{id_col}`").alias("_id"),
        (count_words(F.col(text_col)) if size is None else size).cast("long").alias("_size"),
        F.array_sort(F.array_distinct(sources)).alias("_members"),
    ).withColumn("_pattern", F.to_json(F.struct("_members")))
    slim = sized.select("_id", "_size", "_members", "_pattern").withColumn(
        "_u", F.xxhash64(F.lit(seed), F.col("_id"), F.col("_size"))
    ).withColumn("_bucket", F.pmod("_u", F.lit(BUCKETS)))
    slim = materialise(slim, "sizes")

    found = slim.groupBy("_pattern").agg(F.first("_members").alias("m"), F.sum("_size").alias("n")).limit(max_patterns + 1).collect()
    if len(found) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    capacity = {r["_pattern"]: int(r["n"]) for r in found}
    members = {r["_pattern"]: list(r["m"] or []) for r in found}
    by_source: dict = defaultdict(int)
    for p, names in members.items():
        for s in names:
            by_source[s] += capacity[p]
    order = sorted(by_source, key=lambda s: (s is None, s or ""))
    goal = fill_targets([by_source[s] for s in order], [weights[i % len(weights)] for i in range(len(order))], max_epochs, sum(n for p, n in capacity.items() if members[p]))
    target = dict(zip(order, goal, strict=True))
    flows = route(capacity, members, {s: round(t) for s, t in target.items()}, max_epochs)

    whole, still = {}, {}
    for p in members:
        whole[p], rest = divmod(sum(flows.get(p, {}).values()), capacity[p]) if capacity[p] else (0, 0)
        if rest:
            still[p] = rest
    cuts, extra = _fill(slim, still)

    rows = []
    for p, names in members.items():
        first = names[0] if names else None
        rows.append((p, int(whole[p]), by_source[first] if names else 0, float(target[first]) if names else 0.0, cuts.get(p, []), extra.get(p)))
    # One row a pattern, at most max_patterns: small by the check above.
    plan = F.broadcast(spark.createDataFrame(rows, f"_pattern string, _whole int, source_size long, target double, _cuts {_CUTS}, _extra long"))
    decided = (
        sized.withColumn("_u", F.xxhash64(F.lit(seed), "_id", "_size")).withColumn("_bucket", F.pmod("_u", F.lit(BUCKETS)))
        .join(plan, "_pattern")
        .withColumn("_more", _chosen() | F.coalesce(F.col("_u") == F.col("_extra"), F.lit(False)))
        .withColumn("epochs", F.least(F.col("_whole") + F.col("_more").cast("int"), F.lit(max_epochs)))
    )
    return decided.select(
        *[F.col(k).alias(c) for k, c in back.items()],
        F.col("_size").alias("size"), "source_size", "target", "epochs",
        (F.col("_size") * F.col("epochs")).alias("taken"),
    )
