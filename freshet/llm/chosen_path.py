"""Near-duplicate documents by a chosen-path set similarity join.

Every document is a set of word shingles. In each of several independent trees,
documents branch by their minwise tokens: at every level a document goes to the child of
the least (at the first levels: the two least) of its tokens under that level's hash; below
those levels a node that is still large, and isn't one family of near copies, is branched by
several subtrees, so that recall doesn't fall with depth.
Two sets of similarity s share the least token with probability s, so similar documents
go down together. A node that is small enough is not branched further but compared
exhaustively, by one-permutation sketches; what may be linked is then confirmed on full
sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet.llm import wordhash as wh
from freshet.llm.common import discard, materialise, restored, stowed
from freshet.llm.components import BLOCK, components, connect_blocks, deal_blocks

#: Independent trees, and how many least tokens are followed at each of their levels.
#: At the threshold 0.8 a pair stays together over both levels with a probability of 0.953 in
#: one tree, so five trees miss it with 2.4e-7; closer pairs far more seldom.
TREES, FOLLOWED = 5, (2, 2)
#: A node that is still large is branched by so many independent subtrees, one token a level.
#: A pair at 0.8 stays together in one of six over all three levels with 0.987, so that five
#: trees miss it with 2.4e-7 in leaves of level 3 and 8e-7 in those of level 5.
SUBTREES, DEEPER = 6, 3
#: Hash functions of a tree: its own levels, then those of its subtrees one after the other.
_OF_TREE = (*FOLLOWED, *[1] * (SUBTREES * DEEPER))
#: Bins of a sketch (a power of two), and the share of equal ones from which full sets are
#: compared; that is six standard deviations below a similarity of 0.8.
BINS, MAYBE = 128, 0.58
#: Documents outside the main component of a large group that are compared with all of it, which
#: takes up to FEW / BLOCK rows of each member; with more of them, members meet by their rarest
#: tokens, which takes a row for every fifth token.
FEW = 2048
#: Buckets in which the tokens of such members are counted: a bound of what goes through the driver.
COUNTED = 1 << 20
_MULTIPLIERS = np.random.default_rng(6).integers(1, 2**63, TREES * len(_OF_TREE) + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(column: pa.Array, a: int, b: int, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, first): distinct shingle hashes of rows a..b, ascending within a row.

    A text of fewer words than a shingle is one token; one without words is empty.
    """
    hashes, first = wh.word_hashes(column, a, b, lower=True)
    words = np.diff(first)
    row = np.repeat(np.arange(b - a), words)
    grams = wh.runs(hashes, shingle)
    fits = np.flatnonzero(row[: len(grams)] == row[shingle - 1 : shingle - 1 + len(grams)]) if len(grams) else np.zeros(0, np.int64)
    short = np.flatnonzero((words > 0) & (words < shingle))
    rest = [wh.runs(hashes[first[r] : first[r + 1]], int(words[r]))[0] for r in short]
    tokens = np.concatenate([grams[fits], np.array(rest, np.uint64)])
    rows = np.concatenate([row[fits], short])
    order = np.lexsort((tokens, rows))
    tokens, rows = tokens[order], rows[order]
    new = np.ones(len(tokens), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (rows[1:] != rows[:-1])
    tokens, rows = tokens[new], rows[new]
    return tokens, np.searchsorted(rows, np.arange(b - a + 1))


def _minwise(tokens: np.ndarray, at: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Followed tokens of every (not empty) set, per tree and level: (sets, TREES * sum(_OF_TREE))."""
    out = []
    for t in range(TREES):
        for k, n in enumerate(_OF_TREE):
            m = _MULTIPLIERS[t * len(_OF_TREE) + k]
            value = (tokens ^ (m >> np.uint64(7))) * m
            least = np.minimum.reduceat(value, at)
            out.append(least)
            if n == 2:
                value[value == least[row]] = np.uint64(2**64 - 1)
                second = np.minimum.reduceat(value, at)
                out.append(np.where(second == np.uint64(2**64 - 1), least, second))
    return (np.stack(out, 1) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _sketches(tokens: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """One-permutation sketches: the least token of each bin as a byte from 1 to 255, 0 for an empty bin."""
    value = tokens * _MULTIPLIERS[-1]
    least = np.full(n * BINS, np.uint64(2**64 - 1))
    bits = BINS.bit_length() - 1
    np.minimum.at(least, row * BINS + (value >> np.uint64(64 - bits)).astype(np.int64), value << np.uint64(bits))
    code = (wh.mix(least) % np.uint64(255) + np.uint64(1)).astype(np.uint8)
    code[least == np.uint64(2**64 - 1)] = 0
    return code.reshape(n, BINS)


def _all_pairs(first: np.ndarray) -> np.ndarray:
    """Index pairs i < j within each block."""
    size = np.diff(first)
    left = np.arange(first[-1])
    after = np.repeat(first[1:], size) - left - 1
    i = np.repeat(left, after)
    j = np.arange(len(i)) - np.repeat(np.cumsum(after) - after, after) + i + 1
    return np.stack([i, j], 1)


def _fits(sizes: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(sizes[i], sizes[j]) >= percent * np.maximum(sizes[i], sizes[j])


def likely(percent: int):
    """Compare sketches: pairs whose sizes allow a link and whose sketches may belong to one."""

    def compare(sizes: np.ndarray, payloads: list, first: np.ndarray) -> np.ndarray:
        codes = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BINS)
        pairs = _all_pairs(first)
        pairs = pairs[_fits(sizes, pairs[:, 0], pairs[:, 1], percent)]
        found = []
        for at in range(0, len(pairs), 50_000):
            p = pairs[at : at + 50_000]
            x, y = codes[p[:, 0]], codes[p[:, 1]]
            same, used = ((x == y) & (x > 0)).sum(1), ((x > 0) | (y > 0)).sum(1)
            found.append(p[same >= MAYBE * percent / 80 * used])
        return np.concatenate(found) if found else np.zeros((0, 2), np.int64)

    return compare


def confirmed(percent: int):
    """Compare full sets: pairs with 100 * intersection >= percent * union."""

    def compare(sizes: np.ndarray, payloads: list, first: np.ndarray) -> np.ndarray:
        found = []
        for a, b in zip(first[:-1], first[1:], strict=True):
            own = sizes[a:b]
            pairs = _all_pairs(np.array([0, b - a]))
            pairs = pairs[_fits(own, pairs[:, 0], pairs[:, 1], percent)]
            if not len(pairs):
                continue
            sets = [np.frombuffer(x, np.uint64) for x in payloads[a:b]]
            if len(sets) == 2:
                both = np.array([len(np.intersect1d(*sets, assume_unique=True))])
            else:
                tokens, member = np.concatenate(sets), np.repeat(np.arange(b - a), own)
                order = np.argsort(tokens, kind="stable")
                tokens, member = tokens[order], member[order]
                column = np.cumsum(np.append(False, tokens[1:] != tokens[:-1]))
                shared = np.bincount(column) > 1
                keep = shared[column]
                member, column = member[keep], (np.cumsum(shared) - 1)[column[keep]]
                count = np.zeros((b - a, b - a), np.float32)
                cut = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else -1) + 4097, 4096))
                for c, d in zip(cut[:-1], cut[1:], strict=True):
                    hit = np.zeros((b - a, 4096), np.float32)
                    hit[member[c:d], column[c:d] % 4096] = 1
                    count += hit @ hit.T
                both = count[pairs[:, 0], pairs[:, 1]].astype(np.int64)
            union = own[pairs[:, 0]] + own[pairs[:, 1]] - both
            found.append(pairs[100 * both >= percent * union] + a)
        return np.concatenate(found) if found else np.zeros((0, 2), np.int64)

    return compare


def _describe(docs: DataFrame, shingle: int) -> DataFrame:
    """id, size, two hashes of the whole set, followed tokens, sketch; one row a document."""
    kind = docs.schema["id"].dataType
    schema = T.StructType([
        T.StructField("id", kind), T.StructField("size", T.LongType()), T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()),
        T.StructField("path", T.ArrayType(T.IntegerType())), T.StructField("sketch", T.BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = TREES * sum(_OF_TREE)
        for batch in batches:
            column, ids = wh.fill(batch.column("text")), batch.column("id")
            for a, b in wh.slices(column):
                tokens, first = shingle_sets(column, a, b, shingle)
                size = np.diff(first)
                full = np.flatnonzero(size)
                at, row = first[full], np.repeat(np.arange(len(full)), size[full])
                k1, k2 = np.zeros(b - a, np.int64), np.zeros(b - a, np.int64)
                path, sketch = np.zeros((b - a, wide), np.int32), np.zeros((b - a, BINS), np.uint8)
                if len(full):
                    k1[full] = np.add.reduceat(wh.mix(tokens), at).view(np.int64)
                    k2[full] = np.add.reduceat(wh.mix(tokens ^ np.uint64(0x5851F42D4C957F2D)), at).view(np.int64)
                    path[full] = _minwise(tokens, at, row)
                    sketch[full] = _sketches(tokens, row, len(full))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array(size, pa.int64()), pa.array(k1), pa.array(k2),
                     pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * wide, pa.int32()), pa.array(path.ravel())),
                     pa.array([x.tobytes() for x in sketch], pa.binary())],
                    names=["id", "size", "k1", "k2", "path", "sketch"],
                )

    return docs.mapInArrow(run, schema)


def _counted(rows: DataFrame) -> DataFrame:
    """``rows`` with n, the members of their node, for nodes of two documents at least."""
    sizes = materialise(rows.groupBy("grp").agg(F.count("*").alias("n")).where("n > 1"), "nodes")
    return materialise(rows.join(sizes, "grp"), "branch")


def _nodes(reps: DataFrame) -> DataFrame:
    """Branch the trees by the tokens followed: grp (node), id, tree and n."""
    wide = sum(_OF_TREE)
    rows = reps.select("id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.slice("path", t * wide + 1, F.lit(sum(FOLLOWED))))).alias("tree", "rest"))
    rows = rows.select("id", "tree", F.xxhash64("tree").alias("grp"), "rest")
    for n in FOLLOWED:
        rows = rows.select("id", "tree", "grp", F.explode(F.array_distinct(F.slice("rest", 1, n))).alias("token"), F.slice("rest", n + 1, wide).alias("rest"))
        rows = rows.select("id", "tree", F.xxhash64("grp", "token").alias("grp"), "rest")
    return _counted(rows.drop("rest"))


def _leaves(large: DataFrame, reps: DataFrame) -> DataFrame:
    """Branch nodes (grp, id, tree) by subtrees: grp, id and n of their leaves."""
    wide = sum(_OF_TREE)
    # the tokens of subtrees are fetched for these nodes alone
    rows = large.join(reps.select("id", "path"), "id").select(
        "id", "grp", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(SUBTREES - 1)), lambda r: F.slice("path", F.col("tree") * wide + sum(FOLLOWED) + r * DEEPER + 1, F.lit(DEEPER)))).alias("sub", "rest")
    )
    known = _counted(rows.select("id", F.xxhash64("grp", "sub", F.col("rest")[0]).alias("grp"), F.slice("rest", 2, DEEPER).alias("rest")))
    leaves = known.where(F.col("n") <= BLOCK).select("grp", "id", "n")
    known = _counted(known.where(F.col("n") > BLOCK).select("id", F.xxhash64("grp", "rest").alias("grp")))
    return leaves.union(known.select("grp", "id", "n"))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of near-duplicate documents: the columns of ``docs`` with ``n_shingles``
    (long), ``component_id`` (the smallest id reachable by links) and ``kept`` (the id is
    its component's). Columns of those names in ``docs`` are replaced.

    Two documents are linked if 100 * |intersection| >= percent * |union| of their sets of
    distinct ``shingle``-word shingles, A-Z lower-cased; a shorter text is one shingle.

    Edge cases: a null or empty text, or one without words, has an empty set, is linked
    with nothing and kept. A row with a null id is linked with nothing, has a null
    component and is kept. Rows that repeat an id share its component; if their texts
    differ, any of them may stand for it. An empty table gives an empty table.

    At scale: equal sets fold into one class first (map-side combined). Trees carry ids
    and tokens only. A node of more than ``BLOCK`` documents is dealt into blocks that share
    pivots, and if few members are outside its main component then, these are compared with all
    of it: a family of near copies is done without branching it further. Any other large node
    is branched to the last level. Full sets are built once for the documents of candidate
    clusters alone; large last-level nodes and clusters are dealt and completed likewise. Where
    more than ``FEW`` stay outside (pages of one template, say, alike to few others), the members
    join on full sets by an exact prefix filter: only documents that share one of their
    rarest tokens meet. Either way no link between different components is lost, and nothing is
    collected.
    """
    docs, back = stowed(docs, [id_col, text_col], [id_col, text_col, "n_shingles", "component_id", "kept"])
    base = docs.withColumnsRenamed({id_col: "_id", text_col: "_text"})
    kind = base.schema["_id"].dataType
    texts = base.where(F.col("_id").isNotNull()).select(F.col("_id").alias("id"), F.col("_text").alias("text"))
    described = materialise(_describe(texts, shingle), "sets")
    full = described.where("size > 0")
    classes = materialise(full.groupBy("k1", "k2").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "classes")
    reps = materialise(full.join(classes.select("k1", "k2", F.col("id").alias("rep")), ["k1", "k2"]).where("id = rep").select("id", "size", "path", "sketch").dropDuplicates(["id"]), "reps")

    # candidates: nodes compared by sketches, clusters of what may be linked
    sketch = reps.select("id", "size", F.col("sketch").alias("payload"))
    nodes = _nodes(reps)
    maybe = materialise(connect_blocks(deal_blocks(nodes).join(sketch, "id"), likely(percent), kind), "maybe")
    maybe, large = _complete(nodes, sketch, maybe, kind, likely(percent), SUBTREES * BLOCK // 2)
    hard = None
    if large is not None:
        leaves = materialise(_leaves(nodes.join(large.select("grp").distinct(), "grp").select("grp", "id", "tree"), reps), "leaves")
        more = connect_blocks(deal_blocks(leaves).join(sketch, "id"), likely(percent), kind)
        maybe, hard = _complete(leaves, sketch, materialise(maybe.union(more), "maybe"), kind, likely(percent), FEW)
    clusters = components(maybe, kind)
    sizes = materialise(clusters.groupBy("component").agg(F.count("*").alias("n")), "sizes")
    members = materialise(clusters.join(sizes, "component").select("id", F.xxhash64("component").alias("grp"), "n"), "members")
    wanted = members.select("id") if hard is None else members.select("id").union(hard.select("id")).distinct()

    # confirmation on full sets, each built once
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = wh.fill(batch.column("text"))
            for a, b in wh.slices(column):
                tokens, first = shingle_sets(column, a, b, shingle)
                sets = [tokens[x:y].tobytes() for x, y in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.array(np.diff(first), pa.int64()), pa.array(sets, pa.binary())], names=["id", "size", "payload"])

    schema = T.StructType([T.StructField("id", kind), T.StructField("size", T.LongType()), T.StructField("payload", T.BinaryType())])
    # members grow with the data: a merge join at every size
    payload = materialise(texts.join(wanted.hint("merge"), "id").select("id", "text").mapInArrow(build, schema), "full")
    edges = materialise(connect_blocks(deal_blocks(members).join(payload, "id"), confirmed(percent), kind), "links")
    edges, more = _complete(members, payload, edges, kind, confirmed(percent), FEW)
    for found in (hard, more):
        if found is not None:
            edges = edges.union(_meet_by_rare_tokens(found.groupBy("id").agg(F.max("out").alias("out")), payload, kind, percent))
    found = components(edges, kind)

    label = materialise(
        classes.join(found, "id", "left").where((F.col("copies") > 1) | F.col("component").isNotNull())
        .select("k1", "k2", F.coalesce("component", "id").alias("component")), "labels"
    )
    result = described.where(F.col("size") > 0).join(label, ["k1", "k2"], "left").select("id", F.col("size").alias("n_shingles"), "component")
    result = result.union(described.where(F.col("size") == 0).select("id", "size", F.lit(None).cast(kind))).dropDuplicates(["id"])
    result = result.select(F.col("id").alias("_rid"), F.col("n_shingles").alias("_n"), F.col("component").alias("_c"))
    out = base.join(result, F.col("_id") == F.col("_rid"), "left")
    component = F.coalesce("_c", "_id")
    return out.select(
        F.col("_id").alias(id_col), F.col("_text").alias(text_col), *[F.col(k).alias(c) for k, c in back.items()],
        F.coalesce("_n", F.lit(0)).cast("long").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(component == F.col("_id"), F.lit(True)).alias("kept"),
    )


def _complete(
    groups: DataFrame, payload: DataFrame, edges: DataFrame, kind: T.DataType, compare: Callable[[np.ndarray, list, np.ndarray], np.ndarray], few: int | None,
) -> tuple[DataFrame, DataFrame | None]:
    """Complete the edges of groups (nodes or clusters: grp, id, n) beyond BLOCK, which were
    dealt: members outside the main component of a group are compared with all its members. Groups of
    more such members than ``few`` (None: any number) are left to the caller: the second result
    has their grp and id, with ``out`` for those outside; it is None if there are none. Edges
    that come back connect what they connected, as stars."""
    large = groups.where(F.col("n") > BLOCK).select("grp", "id", "n")
    if not large.limit(1).count():
        return edges, None
    found = components(edges, kind)
    labelled = materialise(large.join(found, "id", "left").select("id", "grp", "n", F.coalesce("component", "id").alias("c")), "labelled")
    main = labelled.groupBy("grp", "c").agg(F.count("*").alias("m")).groupBy("grp").agg(F.max(F.struct("m", "c")).alias("x")).select("grp", F.col("x.c").alias("main"))
    marked = materialise(labelled.join(main, "grp").withColumn("out", F.col("c") != F.col("main")), "marked")
    counted = materialise(marked.where("out").groupBy("grp").agg(F.count("*").alias("r")), "rest")
    discard(labelled)
    if few is not None:
        many = materialise(marked.join(counted.where(F.col("r") > few), "grp").select("grp", "id", "out"), "hard")
        counted = counted.where(F.col("r") <= few)
    chunk = BLOCK  # two chunks a block: pairs are as many at any size, rows half as many at twice the size
    parts, chunks = F.ceil(F.col("n") / chunk).cast("int"), F.ceil(F.col("r") / chunk).cast("int")
    block = lambda part, of: F.xxhash64("grp", part, of, F.lit(2)).alias("block")
    both = marked.join(counted, "grp")
    queries = (
        both.where("out").withColumn("_of", F.pmod(F.xxhash64("id"), chunks).cast("int"))
        .withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).select(block("_part", "_of"), "id")
    )
    against = (
        both.withColumn("_part", F.pmod(F.xxhash64("id", "grp"), parts).cast("int"))
        .withColumn("_of", F.explode(F.sequence(F.lit(0), chunks - 1))).select(block("_part", "_of"), "id")
    )
    stars = found.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b"))
    edges = materialise(stars.union(connect_blocks(queries.union(against).join(payload, "id"), compare, kind)), "completed")
    return edges, (many if few is not None and many.limit(1).count() else None)


def _bucket(tokens: np.ndarray) -> np.ndarray:
    return (wh.mix(tokens) % np.uint64(COUNTED)).astype(np.int64)


def _meet_by_rare_tokens(hard: DataFrame, payload: DataFrame, kind: T.DataType, percent: int) -> DataFrame:
    """Edges between the documents of ``hard`` (id, out), by an exact prefix filter on full sets.

    Tokens are ordered by how often they stand in these documents. Two sets of a link share
    at least percent / 100 of each, so they share one of the first size - ceil(size * percent / 100)
    + 1 tokens of both. Documents meet at every such token that one outside a main component
    has (two inside are connected already). Any order is exact; counts are taken by bucket,
    so that their table (at most ``COUNTED`` numbers) has a bound. Tokens at which the same documents
    meet count once; where more than ``BLOCK`` meet, they are dealt and completed like a cluster.
    """
    spark = payload.sparkSession
    rows = materialise(payload.where("size > 0").join(hard, "id"), "hardsets")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTED, np.int64)
        for batch in batches:
            for x in batch.column("payload").to_pylist():
                np.add.at(total, _bucket(np.frombuffer(x, np.uint64)), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int32()), "n": pa.array(total[at], pa.int64())})

    sums = rows.mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(COUNTED, np.int64)
    often[sums.column("bucket").to_numpy()] = sums.column("n").to_numpy()
    held = spark.sparkContext.broadcast(often)

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                first = []
                for x in batch.column("payload").to_pylist():
                    tokens = np.frombuffer(x, np.uint64)
                    n = len(tokens) + (-len(tokens) * percent) // 100 + 1
                    first.append(tokens[np.lexsort((tokens, held.value[_bucket(tokens)]))[:n]])
                row = pa.array(np.repeat(np.arange(batch.num_rows), [len(x) for x in first]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(first).view(np.int64), pa.int64()), batch.column("id").take(row), batch.column("out").take(row)], names=["grp", "id", "out"])

    schema = T.StructType([T.StructField("grp", T.LongType()), T.StructField("id", kind), T.StructField("out", T.BooleanType())])
    prefixes = materialise(rows.mapInArrow(rarest, schema), "prefixes")
    groups = prefixes.groupBy("grp").agg(F.count("*").alias("n"), F.max("out").alias("out"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("who")).where("n > 1 AND out")
    groups = materialise(groups.groupBy("n", "who").agg(F.min("grp").alias("grp")), "tokens")
    members = materialise(prefixes.join(groups, "grp").select("grp", "id", "n"), "meetings")
    sets = rows.select("id", "size", "payload")
    edges = materialise(connect_blocks(deal_blocks(members).join(sets, "id"), confirmed(percent), kind), "links")
    return _complete(members, sets, edges, kind, confirmed(percent), few=None)[0]
