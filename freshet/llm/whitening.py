"""Embedding whitening: streamed moments, merged over partitions, and a symmetric QR eigen-solve.

Every task runs Welford's rank-one update over its rows and gives one state (count, exact sums,
centred products); states are merged by the parallel update formula in two rounds of
tasks, so that only one state reaches the driver. There the covariance is brought to
tridiagonal form by reflections and diagonalised by implicitly shifted QR steps.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet.llm.common import materialise

#: States meet in so many groups before all of them do.
FAN = 64
#: Rows of a batch that are multiplied at once.
ROWS = 2048
#: An eigenvalue of less than this part of the trace is rounding, not a direction that data has.
FLAT = 1e-13
_LONG = 2**63


class Moments:
    """Count, exact sums and centred products of integer vectors of one length."""

    def __init__(self, size: int):
        self.n, self.sums = 0, [0] * size
        #: The mean of the rows streamed so far, from the first of them on: small numbers, whatever the offset.
        self.first, self.mean = None, np.zeros(size)
        self.products = np.zeros((size, size))

    def add(self, rows: np.ndarray) -> None:
        """Welford's update, a row at a time; the sums are kept apart as integers."""
        if not len(rows):
            return
        wide = np.abs(rows.astype(float)).max(initial=0.0) * len(rows) >= 2**61
        exact = rows.astype(object) if wide else rows
        self.sums = [a + b for a, b in zip(self.sums, exact.sum(0).tolist(), strict=True)]
        self.first = exact[0] if self.first is None else self.first
        outer = np.empty_like(self.products)
        for x in (exact - self.first).astype(float):
            self.n += 1
            before = x - self.mean
            self.mean += before / self.n
            np.multiply(before[:, None], (x - self.mean)[None, :], out=outer)
            self.products += outer

    def merge(self, other: Moments) -> None:
        """The parallel update formula, for two parts of the rows; the distance of their means comes from the exact sums."""
        if self.n and other.n:
            gap = np.array([(b * self.n - a * other.n) / (self.n * other.n) for a, b in zip(self.sums, other.sums, strict=True)])
            self.products += np.outer(gap, gap) * (self.n * other.n / (self.n + other.n))
        self.products += other.products
        self.n, self.sums = self.n + other.n, [a + b for a, b in zip(self.sums, other.sums, strict=True)]

    def covariance(self) -> np.ndarray:
        return (self.products + self.products.T) / (2 * self.n)


_STATE = "size int, part int, n long, sums array<string>, products binary"


def _pack(states: dict[int, Moments], part: int) -> pa.RecordBatch:
    """States as rows; of the products, which are symmetric, one half."""
    half = [((m.products + m.products.T) / 2)[np.triu_indices(d)] for d, m in states.items()]
    return pa.RecordBatch.from_pydict({
        "size": pa.array(list(states), pa.int32()), "part": pa.array([part] * len(states), pa.int32()), "n": pa.array([m.n for m in states.values()], pa.int64()),
        "sums": pa.array([[str(x) for x in m.sums] for m in states.values()], pa.list_(pa.string())),
        "products": pa.array([x.tobytes() for x in half], pa.binary()),
    })


def _unpack(rows: Iterable[dict]) -> Iterator[tuple[int, Moments]]:
    for r in rows:
        m = Moments(r["size"])
        m.n, m.sums = r["n"], [int(x) for x in r["sums"]]
        m.products[np.triu_indices(r["size"])] = np.frombuffer(r["products"])
        m.products += np.triu(m.products, 1).T
        yield r["size"], m


def _merged(rows: Iterable[dict]) -> dict[int, Moments]:
    states: dict[int, Moments] = {}
    for size, m in _unpack(rows):
        if size in states:
            states[size].merge(m)
        else:
            states[size] = m
    return states


def moments(vectors: DataFrame) -> dict[int, Moments]:
    """Moments of the long vectors ``x`` by length. A task keeps one state a length; what
    moves is one state a task, in two rounds, and what reaches the driver one a length."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        states: dict[int, Moments] = {}
        for batch in batches:
            for size, _, rows in _by_length(batch.column("x")):
                states.setdefault(size, Moments(size)).add(rows)
        yield _pack(states, TaskContext.get().partitionId() % FAN)

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states = _merged(r for batch in batches for r in batch.to_pylist())
        yield _pack(states, 0)

    once = vectors.select("x").mapInArrow(stream, _STATE).repartition(FAN, "part").mapInArrow(together, _STATE)
    return _merged(r.asDict() for r in once.repartition(1).mapInArrow(together, _STATE).collect())


def _by_length(x: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, matrix) of the vectors of a batch, by length; empty vectors are left out."""
    x = x.cast(pa.large_list(pa.int64()))
    lengths = np.diff(x.offsets.to_numpy())
    flat = x.values.to_numpy(zero_copy_only=False)
    for size in np.unique(lengths[lengths > 0]).tolist():
        at = np.flatnonzero(lengths == size)
        for a in range(0, len(at), ROWS):
            part = at[a : a + ROWS]
            yield size, part, flat[x.offsets.to_numpy()[part][:, None] + np.arange(size)]


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, the one beside it, Q by rows) with Q a Q^T tridiagonal, by reflections."""
    a, n = a.copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        length = np.linalg.norm(v)
        if length == 0 or not np.any(v[1:]):
            continue
        to = -math.copysign(length, v[0])
        v[0] -= to
        v /= np.linalg.norm(v)
        rest = a[k + 1 :, k + 1 :]
        w = rest @ v
        w -= (v @ w) * v
        rest -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1 :, k] = a[k, k + 1 :] = 0
        a[k + 1, k] = a[k, k + 1] = to
        q[k + 1 :] -= 2 * np.outer(v, v @ q[k + 1 :])
    return np.diag(a).copy(), np.diag(a, 1).copy(), q


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as rows, by QR steps with Wilkinson's shift."""
    unit = float(np.abs(a).max(initial=0.0)) or 1.0
    d, e, q = tridiagonal(np.asarray(a, float) / unit)
    hi, eps, left = len(d) - 1, np.finfo(float).eps, 60 * len(d)
    tiny = eps * eps * max(np.abs(d).max(initial=0.0), np.abs(e).max(initial=0.0))
    while hi > 0:
        if abs(e[hi - 1]) <= eps * (abs(d[hi - 1]) + abs(d[hi])) + tiny:
            e[hi - 1] = 0.0
            hi -= 1
            continue
        lo = hi - 1
        while lo > 0 and abs(e[lo - 1]) > eps * (abs(d[lo - 1]) + abs(d[lo])) + tiny:
            lo -= 1
        if not (left := left - 1):
            raise ArithmeticError("QR steps don't converge")
        half = (d[hi - 1] - d[hi]) / 2
        shift = d[hi] - e[hi - 1] ** 2 / (half + math.copysign(math.hypot(half, e[hi - 1]), half))
        x, z = d[lo] - shift, e[lo]
        for k in range(lo, hi):
            r = math.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > lo:
                e[k - 1] = r
            one, two, between = d[k], d[k + 1], e[k]
            d[k] = c * c * one + 2 * c * s * between + s * s * two
            d[k + 1] = s * s * one - 2 * c * s * between + c * c * two
            e[k] = c * s * (two - one) + (c * c - s * s) * between
            if k + 1 < hi:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
            q[k : k + 2] = np.array([[c, s], [-s, c]]) @ q[k : k + 2]
    order = np.argsort(-d, kind="stable")
    return d[order] * unit, q[order]


@dataclass
class Fit:
    """Of vectors of one length: count, sums, leading components (rows) with their eigenvalues, trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact: longs where the sum of their squares is one, else Python's integers."""
        far = float(np.abs(x.astype(float)).max(initial=0.0)) * self.n + max(map(abs, self.sums))
        if far * far * x.shape[1] < 2**62:
            return x * self.n - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened values of the rows of x; NaN along components without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = np.where(self.values > FLAT * self.trace, 1 / np.sqrt(self.values), np.nan)
        return (self.centred(x) / self.n).astype(float) @ self.components.T * scale

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n x - S)^2, exact."""
        gap = self.centred(x)
        out = (gap * gap).sum(1).tolist()
        if max(out, default=0) >= _LONG:
            raise OverflowError("a deviation is beyond a long: fewer vectors or a smaller scale")
        return out


def fit(vectors: DataFrame, components: int = 4) -> dict[int, Fit]:
    """A :class:`Fit` by length of the long vectors ``x``, each row counted."""
    out = {}
    for size, m in moments(vectors).items():
        values, directions = symmetric_qr(m.covariance())
        out[size] = Fit(m.n, m.sums, directions[:components], np.maximum(values[:components], 0.0), float(np.trace(m.covariance())))
    return out


def _identity_errors(distinct: DataFrame, fits: dict[int, Fit], components: int) -> dict[int, float | None]:
    """Largest entry of the whitened covariance less the identity, by length, from all fitted rows."""
    names = [f"w{k}" for k in range(components)]
    schema = T.StructType([T.StructField("size", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in names]])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, _, x in _by_length(batch.column("x")):
                w = fits[size].project(x)
                columns = {c: pa.array(w[:, k], pa.float64(), mask=np.isnan(w[:, k])) if k < w.shape[1] else pa.nulls(len(w), pa.float64()) for k, c in enumerate(names)}
                yield pa.RecordBatch.from_pydict({"size": pa.array([size] * len(w), pa.int32()), **columns})

    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    rows = distinct.select("x").mapInArrow(project, schema).groupBy("size").agg(*[F.covar_pop(names[i], names[j]).alias(f"c{i}_{j}") for i, j in pairs]).collect()  # a row a length
    errors = {}
    for r in rows:
        found = [abs(r[f"c{i}_{j}"] - (i == j)) for i, j in pairs if r[f"c{i}_{j}"] is not None]
        errors[r["size"]] = max(found) if found else None
    return errors


OWN = ("component", "n", "deviation", "whitened", "explained", "identity_error")


def whiten(vectors: DataFrame, vector_col: str = "embedding", scale: float = 256.0, components: int = 4) -> DataFrame:
    """A row for every vector and leading component: the columns of ``vectors`` but the vector, with
    component, n, deviation, whitened, explained and identity_error.

    Entries c become the integers x = floor(scale * c). The moments are those of the distinct x;
    ``n`` is their number, ``deviation`` the sum over dimensions of (n x - S)^2 for their sums S,
    ``whitened`` the projection of x - S / n on the component over the root of its eigenvalue,
    ``explained`` its part of the trace, ``identity_error`` the largest entry of the covariance of the whitened
    distinct vectors less the identity.

    Edge cases: a vector that is null, or holds a null or an entry that isn't finite, has no
    rows; nor has an empty one. Rows of a null or repeated id are rows like others. Vectors of
    another length are a space of their own, fitted by themselves, with as many components as
    dimensions at most. Along a component without variance (one distinct vector, say)
    ``whitened`` is null, ``explained`` 0 (null where no dimension varies) and the
    identity error takes the others (null if there are none). Equal eigenvalues share a space, in which
    any basis is one. An entry or deviation beyond a long is an error. Columns of the names above
    are replaced, others pass whatever their names. An empty table gives an empty table.

    At scale: distinct vectors are found by one shuffle that combines map-side, so copies
    collapse before they move; they are written once and read twice. A task's state is two
    squares of the length; projection is a narrow pass with ``components`` vectors.
    """
    keep = [c for c in vectors.columns if c != vector_col and c.lower() not in OWN]
    c = F.col(f"`{vector_col}`")
    finite = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    whole = F.transform(c, lambda v: F.when(F.abs(v.cast("double") * scale) < F.lit(2.0**63), F.floor(v.cast("double") * scale).cast("long")).otherwise(F.raise_error(F.lit("an entry is beyond a long"))))
    rest = F.struct(*[F.col(f"`{k}`") for k in keep]) if keep else F.lit(0)
    rows = vectors.where(c.isNotNull() & F.coalesce(finite, F.lit(False)) & (F.size(c) > 0)).select(rest.alias("rest"), whole.alias("x"))
    distinct = materialise(rows.select("x").distinct(), "distinct-vectors")
    fits = fit(distinct, components)
    errors = _identity_errors(distinct, fits, components)
    schema = T.StructType([
        rows.schema["rest"], T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()),
        T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, at, x in _by_length(batch.column("x")):
                f = fits[size]
                k, n = len(f.values), len(x)
                w = f.project(x).ravel()
                share = [float(v / f.trace) if f.trace else None for v in f.values]
                yield pa.RecordBatch.from_arrays([
                    batch.column("rest").take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1), n), pa.int32()), pa.array(np.full(n * k, f.n), pa.int64()),
                    pa.array(np.repeat(np.array(f.deviation(x), np.int64), k), pa.int64()), pa.array(w, pa.float64(), mask=np.isnan(w)),
                    pa.array(share * n, pa.float64()), pa.array([errors.get(size)] * (n * k), pa.float64()),
                ], names=schema.names)

    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col("rest")[k].alias(k) for k in keep], *OWN)
