"""Second-order boosting of regression trees, with one aggregation a level, and attributions.

Features become bins of at most ``max_bin`` values. For every level of a tree each task sums gradients
and rows by (node, feature, bin) and one Spark aggregation adds the tasks' sums up; the driver, which
sees at most nodes x features x bins of them whatever the rows, picks the split of each node. Gradients are
summed as integers, so a model doesn't depend on how its rows were dealt out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows whose values set the bins: all of them up to this many, else those of the smallest hashes.
BIN_ROWS = 100_000
#: The bin of a missing value; trees that rows carry along before their sums are written anew.
MISSING, CARRIED = 65535, 16


@dataclass(frozen=True)
class Boosting:
    """Parameters, by the names and meanings that XGBoost and scikit-learn give them.

    A leaf weighs -t(G) / (H + reg_lambda) times ``learning_rate``, where G and H are the sums of its gradients and
    hessians (of squared error: residuals and rows) and t shrinks G towards 0 by ``reg_alpha``. A split's gain is
    t(G)^2 / (H + reg_lambda) of both sides less that of the node; it must be positive and ``gamma`` at least, with
    ``min_child_weight`` of hessians and ``min_samples_leaf`` rows on either side and ``min_samples_split`` rows in the node.
    Each tree sees ``subsample`` of the rows and ``colsample_bytree`` of the features. With validation rows, boosting ends
    after ``early_stopping_rounds`` trees that didn't lower their squared error, and the model keeps the best number of trees.
    """

    n_estimators: int = 100
    max_depth: int = 6
    learning_rate: float = 0.3
    subsample: float = 1.0
    colsample_bytree: float = 1.0
    min_child_weight: float = 1.0
    gamma: float = 0.0
    reg_alpha: float = 0.0
    reg_lambda: float = 1.0
    min_samples_split: int = 2
    min_samples_leaf: int = 1
    max_bin: int = 256
    early_stopping_rounds: int = 50
    random_state: int = 0

    def __post_init__(self):
        if not (self.max_depth >= 1 and 0 < self.subsample <= 1 and 0 < self.colsample_bytree <= 1 and 2 <= self.max_bin < MISSING and self.n_estimators >= 1):
            raise ValueError(f"parameters out of range: {self}")


#: A row of a table of tree nodes: ``feature`` is -1 for a leaf; a value below ``threshold`` goes left, a missing one as ``default_left`` says.
NODE = "tree int, node int, feature int, cut int, threshold double, default_left boolean, left int, right int, value double, gain double, cover long"
_NAMES = [part.split()[0] for part in NODE.split(", ")]


class Tree:
    """The nodes of one tree as arrays."""

    def __init__(self, nodes: list[dict]):
        self.nodes = nodes
        for name in _NAMES[2:]:
            setattr(self, name, np.array([n[name] for n in nodes]))

    def leaves(self, x: np.ndarray, binned: bool) -> np.ndarray:
        """The leaf of every row of a matrix of bins or of values."""
        at, split = np.zeros(len(x), np.int64), self.cut if binned else self.threshold
        while (inner := np.flatnonzero(self.feature[at] >= 0)).size:
            node = at[inner]
            value = x[inner, self.feature[node]]
            gone = value == MISSING if binned else np.isnan(value)
            left = np.where(gone, self.default_left[node], value < split[node])
            at[inner] = np.where(left, self.left[node], self.right[node])
        return at

    def predict(self, x: np.ndarray, binned: bool = False) -> np.ndarray:
        return self.value[self.leaves(x, binned)]


def bin_edges(values: np.ndarray, max_bin: int) -> np.ndarray:
    """Places between values at which a feature is cut: between all distinct ones, or where they make up
    even parts of the rows."""
    values = np.sort(values[~np.isnan(values)])
    distinct, first = np.unique(values, return_index=True)
    if len(distinct) > max_bin:
        wanted = np.unique(np.searchsorted(first, np.arange(1, max_bin) * len(values) / max_bin, "left"))
        wanted = wanted[(wanted > 0) & (wanted < len(distinct))]
    else:
        wanted = np.arange(1, len(distinct))
    return (distinct[wanted - 1] + distinct[wanted]) / 2


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """Uniform numbers in [0, 1) from 64-bit hashes and a salt."""
    x = x.view(np.uint64) ^ np.uint64((salt * 0x9E3779B97F4A7C15) % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / 2**53


def find_splits(g: np.ndarray, n: np.ndarray, p: Boosting) -> list[tuple[float, int, int, bool] | None]:
    """For each node, from its sums by (node, feature, bin; the last bin holds missing values): (gain, feature, cut,
    whether missing values go left) of the best split, the first of equal ones; None if none is allowed."""
    total_g, total_n = g[:, 0].sum(-1), n[:, 0].sum(-1)

    def score(gs: np.ndarray, hs: np.ndarray) -> np.ndarray:
        t = np.sign(gs) * np.maximum(np.abs(gs) - p.reg_alpha, 0)
        return t * t / np.maximum(hs + p.reg_lambda, 1e-300)

    left_g, left_n = (np.cumsum(a[:, :, :-1], -1) for a in (g, n))  # the last cut leaves missing values alone on the right
    both = []
    for missing_left in (True, False):
        lg, ln = (a + (m[:, :, -1:] if missing_left else 0) for a, m in ((left_g, g), (left_n, n)))
        rg, rn = total_g[:, None, None] - lg, total_n[:, None, None] - ln
        gain = score(lg, ln) + score(rg, rn) - score(total_g, total_n)[:, None, None]
        allowed = (np.minimum(ln, rn) >= max(p.min_samples_leaf, p.min_child_weight, 1)) & (total_n >= p.min_samples_split)[:, None, None]
        both.append(np.where(allowed & (gain > 1e-12) & (gain >= p.gamma), gain, -np.inf))
    gains = np.stack(both, -1)
    out: list = []
    for node in gains:
        k = int(np.argmax(node)) if node.size else 0
        if not node.size or node.flat[k] == -np.inf:
            out.append(None)
            continue
        f, cut, right = np.unravel_index(k, node.shape)
        out.append((float(node.flat[k]), int(f), int(cut) + 1, right == 0))
    return out


class BoostedTrees:
    """A fitted model: the mean that it starts from and its trees."""

    def __init__(self, base: float, trees: list[Tree], features: Sequence[str]):
        self.base, self.trees, self.features = base, trees, list(features)

    def nodes(self, spark: SparkSession) -> DataFrame:
        """The table of tree nodes."""
        return spark.createDataFrame([(k, *(n[c] for c in _NAMES[1:])) for k, t in enumerate(self.trees) for n in t.nodes], NODE)

    @classmethod
    def from_nodes(cls, base: float, nodes: DataFrame, features: Sequence[str]) -> BoostedTrees:
        trees: dict[int, list] = {}
        for r in nodes.orderBy("tree", "node").collect():  # a row a node
            trees.setdefault(r["tree"], []).append(r.asDict())
        return cls(base, [Tree(t) for t in trees.values()], features)

    def importances(self, mean: bool = False) -> np.ndarray:
        """Parts of all gain (or of the mean gain of a split) by feature."""
        out, times = np.zeros(len(self.features)), np.zeros(len(self.features))
        for t in self.trees:
            inner = t.feature >= 0
            np.add.at(out, t.feature[inner], t.gain[inner])
            np.add.at(times, t.feature[inner], 1)
        out = out / np.maximum(times, 1) if mean else out
        return out / out.sum() if out.sum() > 0 else out

    def _appended(self, df: DataFrame, columns: list[T.StructField], compute) -> DataFrame:
        """``df`` with columns that ``compute`` gives for the matrix of features of a batch."""
        kept = [c for c in df.columns if c not in {f.name for f in columns}]
        rest = F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.lit(0)
        slim, n = df.select(rest.alias("_rest"), _values(self.features).alias("_x")), len(self.features)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), *compute(_matrix(batch.column(1), n))], names=["_rest", *(f.name for f in columns)])

        out = slim.mapInArrow(run, T.StructType([slim.schema["_rest"], *columns]))
        return out.select(*[F.col("_rest")[c].alias(c) for c in kept], *[f.name for f in columns])

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        """``df`` with the model's value; features that are null or NaN go where training rows without them went."""
        base, trees = self.base, self.trees
        return self._appended(df, [T.StructField(name, T.DoubleType())], lambda x: [pa.array(base + sum((t.predict(x) for t in trees), np.zeros(len(x))), pa.float64())])

    def attribute(self, df: DataFrame, name: str = "attributions", expected: str = "expected") -> DataFrame:
        """``df`` with the Shapley value of every feature (a map) and the value that they start from.

        Path-dependent: a feature that isn't known follows both branches in proportion to the training rows
        that did. ``expected`` and the values of a row sum to its prediction.
        """
        base, trees, names = self.base, self.trees, self.features
        mean = base + sum(expectation(t) for t in trees)

        def compute(x: np.ndarray) -> list[pa.Array]:
            values = sum((tree_attributions(t, x) for t in trees), np.zeros((len(x), len(names))))
            offsets = np.arange(len(x) + 1, dtype=np.int32) * len(names)
            return [pa.MapArray.from_arrays(offsets, pa.array(names * len(x), pa.string()), pa.array(values.ravel(), pa.float64())), pa.array(np.full(len(x), mean), pa.float64())]

        return self._appended(df, [T.StructField(name, T.MapType(T.StringType(), T.DoubleType())), T.StructField(expected, T.DoubleType())], compute)


def _values(features: Sequence[str]) -> Column:
    """The features of a row as one array of doubles, missing ones null. (One column: Spark derives what it knows of
    each alias of each column, which grows fast with their number.)"""
    return F.array(*[F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")) for c in features]).cast("array<double>")


def _matrix(values: pa.Array, n: int) -> np.ndarray:
    """Arrays of n numbers as a matrix, nulls as NaN."""
    return values.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(values), n)


def _paths(tree: Tree) -> list[tuple[int, list[tuple[int, int, bool, float]]]]:
    """Of each leaf: the splits above it as (node, feature, whether it lies left, part of the node's training rows on that side)."""
    out, work = [], [(0, [])]
    while work:
        node, path = work.pop()
        if tree.feature[node] < 0:
            out.append((node, path))
            continue
        for child, left in ((tree.left[node], True), (tree.right[node], False)):
            work.append((int(child), [*path, (node, int(tree.feature[node]), left, tree.cover[child] / tree.cover[node])]))
    return out


def expectation(tree: Tree) -> float:
    return float(sum(tree.value[leaf] * math.prod(p[3] for p in path) for leaf, path in _paths(tree)))


def tree_attributions(tree: Tree, x: np.ndarray) -> np.ndarray:
    """Shapley values of one tree, rows by features.

    Of a leaf with m features on its path, feature i has (o - z) times the weighted coefficients of the product of
    (z + o t) over the other features: z is the part of training rows that its splits let through, o whether they let this row.
    """
    out = np.zeros(x.shape)
    for leaf, path in _paths(tree):
        passed: dict[int, list] = {}
        for node, f, left, part in path:
            value = x[:, f]
            goes = np.where(np.isnan(value), tree.default_left[node], value < tree.threshold[node]) == left
            held = passed.setdefault(f, [1.0, np.ones(len(x), bool)])
            held[0] *= part
            held[1] = held[1] & goes
        m = len(passed)
        weights = [math.factorial(k) * math.factorial(m - 1 - k) / math.factorial(m) for k in range(m)]
        for f, (z, o) in passed.items():
            product = [np.ones(len(x))]
            for other, (zo, oo) in passed.items():
                if other != f:
                    product = [(product[k] * zo if k < len(product) else 0.0) + (product[k - 1] * oo if k else 0.0) for k in range(len(product) + 1)]
            out[:, f] += tree.value[leaf] * (o - z) * sum(w * c for w, c in zip(weights, product, strict=True))
    return out


_STATE = "bins binary, label double, base double, hash long, held boolean"


def _carried(state: DataFrame, trees: list[Tree], width: int) -> DataFrame:
    """The rows with the trees' values added to what they carry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _bins(batch, width)
            value = batch.column("base").to_numpy()
            for t in trees:
                value = value + t.predict(x, True)
            yield pa.RecordBatch.from_arrays([pa.array(value, pa.float64()) if c == "base" else batch.column(c) for c in batch.schema.names], names=batch.schema.names)

    return state.mapInArrow(run, _STATE)


def _bins(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint16).reshape(batch.num_rows, width)


def _sums(state: DataFrame, trees: list[Tree], growing: Tree, nodes: list[int], columns: list[int], width: int, bins: int, scale: float, squares: float, p: Boosting, number: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Gradients and rows by (node, feature, bin) of the open ``nodes`` of a growing tree, over the rows that the tree
    sees, and the summed squared error of the held rows without it."""
    place = np.full(len(growing.nodes), -1)
    place[nodes] = np.arange(len(nodes))
    shape = (len(nodes), len(columns), bins + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, n, error = np.zeros(shape, np.int64), np.zeros(shape, np.int64), 0
        for batch in (b.slice(a, 8192) for b in batches for a in range(0, b.num_rows, 8192)):
            x, label, value = _bins(batch, width), batch.column("label").to_numpy(), batch.column("base").to_numpy()
            for t in trees:
                value = value + t.predict(x, True)
            held = batch.column("held").to_numpy(zero_copy_only=False)
            error += sum(np.rint((value[held] - label[held]) ** 2 * squares).astype(np.int64).tolist())
            seen = np.flatnonzero(~held & (_mixed(batch.column("hash").to_numpy(), number * 1_000_003 + p.random_state) < p.subsample))
            at = place[growing.leaves(x[seen], True)]
            seen, at = seen[at >= 0], at[at >= 0]
            gradient = np.rint((value[seen] - label[seen]) * scale)
            if len(seen) and np.abs(gradient).max() >= 2**38:
                raise ArithmeticError("boosting diverges: lower the learning rate")
            for k, c in enumerate(columns):  # sums of integers below 2^53: exact as doubles
                key = at * (bins + 1) + np.minimum(x[seen, c], bins)
                g[:, k] += np.bincount(key, gradient, len(nodes) * (bins + 1)).astype(np.int64).reshape(len(nodes), -1)
                n[:, k] += np.bincount(key, minlength=len(nodes) * (bins + 1)).reshape(len(nodes), -1)
        where = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"k": pa.array(np.append(where, -1), pa.int64()), "g": pa.array([*g.flat[where].tolist(), error], pa.int64()), "n": pa.array(np.append(n.flat[where], 0), pa.int64())})

    found = state.mapInArrow(run, "k long, g long, n long").groupBy("k").agg(F.sum("g").alias("g"), F.sum("n").alias("n")).toArrow()
    g, n, error = np.zeros(shape), np.zeros(shape), 0
    for batch in found.to_batches():
        k = batch.column("k").to_numpy()
        inside = k >= 0
        g.flat[k[inside]], n.flat[k[inside]] = batch.column("g").to_numpy()[inside] / scale, batch.column("n").to_numpy()[inside]
        error += int(batch.column("g").to_numpy()[~inside].sum())
    return g, n, error


def fit_boosted_trees(train: DataFrame, features: Sequence[str], params: Boosting, label: str = "label", validation: DataFrame | None = None) -> BoostedTrees:
    """Boosted trees on all rows of ``train`` with a label.

    Nulls and NaN are missing values: each split sends them to the side where they gain more. Rows are
    told apart by a hash of features and label: it deals subsamples, so equal rows are in or out together, and
    picks the rows that set the bins. A table without rows is an error.

    At scale: features are binned once and kept as two bytes a feature (persisted; a lost executor's part is made
    again); a level of a tree is one pass, in which a task holds nodes x features x bins sums; every ``CARRIED`` trees
    the rows' values so far are written anew, so that a pass applies few trees.
    """
    width = len(features)

    def described(df: DataFrame, held: bool) -> DataFrame:
        y = F.nanvl(F.col(f"`{label}`").cast("double"), F.lit(None).cast("double"))
        return df.select(_values(features).alias("x"), y.alias("label")).where("label IS NOT NULL").select("x", "label", F.xxhash64("x", "label").alias("hash"), F.lit(held).alias("held"))

    rows = described(train, False)
    count, total = rows.agg(F.count("*"), F.sum(F.col("label").cast("decimal(38,10)"))).first()
    if not count:
        raise ValueError("no rows with a label to fit on")
    base = float(total / count)
    sample = rows.select("x", "hash").orderBy("hash", "x").limit(BIN_ROWS).toArrow().column("x").combine_chunks()
    edges = [bin_edges(v, params.max_bin) for v in _matrix(sample, width).T]
    bins = max([len(e) + 1 for e in edges], default=1)
    farthest = rows.agg(F.max(F.abs(F.col("label") - base))).first()[0] or 1.0
    bits = min(36, 60 - max(count - 1, 1).bit_length())
    scale, squares = 2.0 ** (bits - math.ceil(math.log2(farthest))), 2.0 ** (bits - 2 * math.ceil(math.log2(farthest)))
    every = rows if validation is None else rows.unionByName(described(validation, True))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.full((batch.num_rows, width), MISSING, np.uint16)
            for k, v in enumerate(_matrix(batch.column("x"), width).T):
                there = ~np.isnan(v)
                out[there, k] = np.searchsorted(edges[k], v[there], "right")
            rows = [r.tobytes() for r in out]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column("label"), pa.array(np.full(len(rows), base)), batch.column("hash"), batch.column("held")], names=["bins", "label", "base", "hash", "held"])

    state = every.mapInArrow(binned, _STATE).persist(StorageLevel.MEMORY_AND_DISK)
    trees: list[Tree] = []
    carried, best = 0, (math.inf, 0)
    rng = np.random.default_rng(params.random_state)
    leaf = lambda node, g, n: {"node": node, "feature": -1, "cut": 0, "threshold": 0.0, "default_left": True, "left": -1, "right": -1, "gain": 0.0, "cover": int(n), "value": _weight(g, n, params)}
    try:
        for number in range(params.n_estimators):
            columns = sorted(rng.choice(width, max(1, int(params.colsample_bytree * width)), replace=False).tolist()) if width else []
            nodes, level = [leaf(0, 0.0, 0)], [0]
            for depth in range(params.max_depth):
                g, n, error = _sums(state, trees[carried:], Tree(nodes), level, columns, width, bins, scale, squares, params, number)
                if depth == 0:
                    if columns:
                        nodes[0] = leaf(0, g[0, 0].sum(), n[0, 0].sum())
                    best = min(best, (error, len(trees)))
                following = []
                for node, split, gs, ns in zip(level, find_splits(g, n, params) if columns else [None], g, n, strict=True):
                    if split is None:
                        continue
                    gain, k, cut, missing_left = split
                    edge = edges[columns[k]]
                    left_g, left_n = (float(a[k, :cut].sum() + (a[k, -1] if missing_left else 0)) for a in (gs, ns))
                    nodes[node] |= {"feature": columns[k], "cut": cut, "threshold": float(edge[cut - 1]) if cut <= len(edge) else math.inf, "default_left": bool(missing_left), "left": len(nodes), "right": len(nodes) + 1, "gain": float(gain)}
                    nodes += [leaf(len(nodes), left_g, left_n), leaf(len(nodes) + 1, gs[k].sum() - left_g, ns[k].sum() - left_n)]
                    following += [len(nodes) - 2, len(nodes) - 1]
                if not (level := following):
                    break
            if validation is not None and len(trees) - best[1] >= params.early_stopping_rounds:
                break
            trees.append(Tree(nodes))
            if len(trees) - carried >= CARRIED:
                old, state = state, _carried(state, trees[carried:], width).persist(StorageLevel.MEMORY_AND_DISK)
                state.count()
                carried = len(trees)
                old.unpersist()
        if validation is not None:
            _, _, error = _sums(state, trees[carried:], Tree([leaf(0, 0.0, 0)]), [0], [], width, bins, scale, squares, params, 0)
            trees = trees[: min(best, (error, len(trees)))[1]]
    finally:
        state.unpersist()
    return BoostedTrees(base, trees, features)


def _weight(g: float, n: float, p: Boosting) -> float:
    t = math.copysign(max(abs(g) - p.reg_alpha, 0.0), g)
    return float(-t / (n + p.reg_lambda) * p.learning_rate) if n + p.reg_lambda > 0 else 0.0


def known_parameters(given: dict, start: Boosting) -> tuple[Boosting, list[str]]:
    """Parameters from a configuration over those of ``start``, and the names of those it doesn't have."""
    names = {f.name for f in fields(Boosting)}
    known = {k: v for k, v in given.items() if k in names and v is not None}
    return Boosting(**{**asdict(start), **known}), sorted(k for k in given if k not in names)
