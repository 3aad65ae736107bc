"""Second-order boosting and attributions against plain versions of their definitions."""

import itertools
import math
import random

import numpy as np
import pytest

from freshet.plans.boosting import Boosting, BoostedTrees, bin_edges, fit_boosted_trees, known_parameters, tree_attributions

FEATURES = ["a", "b", "c"]


def table(n=60, seed=2, missing=0.0):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        a, b, c = rng.randint(0, 9), round(rng.random(), 2), rng.choice([1.0, 2.0])
        rows.append((*(None if rng.random() < missing else float(v) for v in (a, b, c)), 3.0 * (a > 4) + 2 * b + rng.gauss(0, 0.3) + (0.0 if c == 1 else a / 5)))
    return rows


def grow(rows, residuals, p, depth=0):
    """A tree by trying every cut between values of the rows that are there, with missing values on either side."""
    g, n = sum(residuals), len(rows)
    shrunk = lambda x: math.copysign(max(abs(x) - p.reg_alpha, 0), x)
    score = lambda x, k: shrunk(x) ** 2 / (k + p.reg_lambda)
    leaf = -shrunk(g) / (n + p.reg_lambda) * p.learning_rate
    best = None
    for f in range(3) if depth < p.max_depth and n >= p.min_samples_split else ():
        values = sorted({r[f] for r in rows if r[f] is not None})
        for cut, first in itertools.product([(x + y) / 2 for x, y in zip(values, values[1:], strict=False)] + [math.inf], (True, False)):
            left = [k for k, r in enumerate(rows) if (first if r[f] is None else r[f] < cut)]
            lg, ln = sum(residuals[k] for k in left), len(left)
            if min(ln, n - ln) < max(p.min_samples_leaf, p.min_child_weight, 1):
                continue
            gain = score(lg, ln) + score(g - lg, n - ln) - score(g, n)
            if gain > 1e-12 and gain >= p.gamma and (best is None or gain > best[0] + 1e-9):
                best = (gain, f, cut, first, left)
    if best is None:
        return lambda r: leaf
    _, f, cut, first, left = best
    inside = set(left)
    sides = [[k for k in range(n) if (k in inside) == side] for side in (True, False)]
    a, b = (grow([rows[k] for k in side], [residuals[k] for k in side], p, depth + 1) for side in sides)
    return lambda r: (a if (first if r[f] is None else r[f] < cut) else b)(r)


def plain(rows, p):
    base = sum(r[-1] for r in rows) / len(rows)
    value, trees = [base] * len(rows), []
    for _ in range(p.n_estimators):
        trees.append(grow(rows, [v - r[-1] for v, r in zip(value, rows, strict=True)], p))
        value = [v + trees[-1](r) for v, r in zip(value, rows, strict=True)]
    return lambda r: base + sum(t(r) for t in trees)


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "a double, b double, c double, label double").repartition(parts)


CASES = [
    {}, {"max_depth": 1}, {"reg_lambda": 0.0}, {"reg_lambda": 20.0}, {"reg_alpha": 3.0}, {"gamma": 4.0}, {"min_child_weight": 9.0}, {"min_samples_split": 25}, {"min_samples_leaf": 12}, {"learning_rate": 1.0}, {"max_depth": 5, "reg_lambda": 0.0},
]


@pytest.mark.parametrize(("given", "missing"), [*((c, 0.15) for c in CASES), (CASES[0], 0.0), (CASES[-1], 0.0)], ids=str)
def test_trees_are_those_of_exact_splits(spark, given, missing):
    rows = table(missing=missing)
    p = Boosting(**{"n_estimators": 2, "max_depth": 3, **given})
    model, want = fit_boosted_trees(frame(spark, rows), FEATURES, p), plain(rows, p)
    got = {tuple(r[:3]): r["prediction"] for r in model.predict(frame(spark, rows)).collect()}
    assert all(got[r[:3]] == pytest.approx(want(r), abs=1e-6) for r in rows)


def test_each_parameter_changes_the_trees(spark):
    rows = table()
    values = {}
    for given in CASES + [{"subsample": 0.5}, {"colsample_bytree": 0.34}, {"max_bin": 4}, {"n_estimators": 2}]:
        model = fit_boosted_trees(frame(spark, rows), FEATURES, Boosting(**{"n_estimators": 3, "max_depth": 3, **given}))
        values[str(given)] = tuple(round(float(x), 9) for x in sum(t.predict(np.array([r[:3] for r in rows])) for t in model.trees))
        if "colsample_bytree" in given:
            assert all(len(set(t.feature[t.feature >= 0])) <= 1 for t in model.trees)
        if "max_bin" in given:
            assert all(len({n["threshold"] for t in model.trees for n in t.nodes if n["feature"] == f}) <= 3 for f in range(3))
    assert len(set(values.values())) == len(values)


def test_one_seed_one_model(spark):
    rows = table(200, missing=0.1)
    p = Boosting(n_estimators=20, max_depth=3, subsample=0.7, colsample_bytree=0.7, random_state=5)
    one, two, other = (fit_boosted_trees(frame(spark, rs, parts), FEATURES, q).nodes(spark).collect() for rs, parts, q in ((rows, 1, p), (rows[::-1], 7, p), (rows, 1, Boosting(**{**p.__dict__, "random_state": 6}))))
    assert one == two != other


def test_early_stopping_keeps_the_best_number_of_trees(spark):
    rng = random.Random(1)
    noise = lambda n: [(rng.random(), rng.random(), rng.random(), rng.gauss(0, 1)) for _ in range(n)]
    train, held = noise(80), noise(80)
    p = Boosting(n_estimators=40, max_depth=4, early_stopping_rounds=4)
    stopped, whole = (fit_boosted_trees(frame(spark, train), FEATURES, p, validation=v) for v in (frame(spark, held), None))
    errors = [sum((stopped.base + sum(t.predict(np.array([r[:3]]))[0] for t in whole.trees[:k]) - r[3]) ** 2 for r in held) for k in range(len(whole.trees) + 1)]
    first = next(k for k in range(len(errors)) if all(e >= errors[k] for e in errors[k + 1 : k + 5]) and errors[k] == min(errors[: k + 1]))
    assert len(whole.trees) == 40 and len(stopped.trees) == first < 40


def test_odd_tables(spark):
    assert [t.nodes[0]["feature"] for t in fit_boosted_trees(frame(spark, [(1.0, 1.0, 1.0, 2.0)]), FEATURES, Boosting(n_estimators=2)).trees] == [-1, -1]
    constant = fit_boosted_trees(frame(spark, [(float(k), None, 1.0, 7.0) for k in range(9)]), FEATURES, Boosting(n_estimators=2))
    out = constant.predict(frame(spark, [(None, None, None, None), (float("nan"), 1.0, 2.0, 0.0)]))
    assert [r["prediction"] for r in out.collect()] == [7.0, 7.0]
    assert constant.predict(frame(spark, table()).limit(0)).count() == 0
    with pytest.raises(ValueError):
        fit_boosted_trees(frame(spark, [(1.0, 1.0, 1.0, None)]), FEATURES, Boosting())
    with pytest.raises(ValueError):
        Boosting(subsample=0.0)
    assert known_parameters({"gamma": 2, "n_jobs": 3, "max_depth": None}, Boosting()) == (Boosting(gamma=2), ["n_jobs"])
    wide = spark.createDataFrame([(1.0, 2.0, 3.0, "old", 5)], "a double, b double, c double, prediction string, `x.y` int")
    assert constant.predict(wide).select("`x.y`", "prediction").first() == (5, 7.0)


def test_many_values_make_even_bins():
    values = np.concatenate([np.zeros(500), np.arange(500.0), [np.nan]])
    edges = bin_edges(values, 8)
    assert len(edges) <= 7 and (np.diff(edges) > 0).all()
    counts = np.bincount(np.searchsorted(edges, values[:-1], "right"))
    assert counts[0] >= 500 and counts[1:].max() < 300


def shapley(tree, x, features):
    """By its definition: over all sets of known features, the tree's value where unknown ones follow the rows' parts."""
    def value(known, node=0):
        f = int(tree.feature[node])
        if f < 0:
            return tree.value[node]
        left, right = int(tree.left[node]), int(tree.right[node])
        if f in known:
            goes = tree.default_left[node] if np.isnan(x[f]) else x[f] < tree.threshold[node]
            return value(known, left if goes else right)
        return (value(known, left) * tree.cover[left] + value(known, right) * tree.cover[right]) / tree.cover[node]

    out = []
    for f in range(features):
        others = [k for k in range(features) if k != f]
        out.append(sum(
            math.factorial(len(s)) * math.factorial(features - 1 - len(s)) / math.factorial(features) * (value({*s, f}) - value(set(s)))
            for n in range(features) for s in itertools.combinations(others, n)
        ))
    return out


def test_attributions_equal_enumeration(spark):
    rows = table(150, missing=0.1)
    model = fit_boosted_trees(frame(spark, rows), FEATURES, Boosting(n_estimators=4, max_depth=5))
    x = np.array([[np.nan if v is None else v for v in r[:3]] for r in rows[:12]])
    for tree in model.trees:
        got = tree_attributions(tree, x)
        for k in range(len(x)):
            assert got[k] == pytest.approx(shapley(tree, x[k], 3), abs=1e-12)
    for r in model.attribute(model.predict(frame(spark, rows))).collect():
        assert r["expected"] + sum(r["attributions"].values()) == pytest.approx(r["prediction"], abs=1e-9)
        assert list(r["attributions"]) == FEATURES


def test_nodes_make_the_model_again(spark):
    rows = table(80)
    model = fit_boosted_trees(frame(spark, rows), FEATURES, Boosting(n_estimators=18, max_depth=2))
    again = BoostedTrees.from_nodes(model.base, model.nodes(spark).repartition(4), FEATURES)
    both = [sorted(m.predict(frame(spark, rows)).collect()) for m in (model, again)]
    assert both[0] == both[1] and model.importances().sum() == pytest.approx(1)
