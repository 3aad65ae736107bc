"""The parameter search on functions with a known least value, and on a model."""

import math
import threading
import time

import pytest

from freshet.plans.search import Choice, Search, Span, Trial, propose, search, search_model

SPACE = {"x": Span(-5, 5), "y": Span(1e-4, 1e2, log=True), "k": Span(1, 9, whole=True), "kind": Choice(("a", "b", "c"))}


def bowl(p):
    return (p["x"] - 1.5) ** 2 + math.log10(p["y"] / 0.1) ** 2 + (p["k"] - 4) ** 2 / 4 + {"a": 2.0, "b": 0.0, "c": 1.0}[p["kind"]]


def test_seeded_reruns_agree():
    one, two, other = (search(bowl, SPACE, 40, seed=s) for s in (3, 3, 4))
    assert [t.params for t in one.trials] == [t.params for t in two.trials] != [t.params for t in other.trials]
    assert one.best.loss == min(t.loss for t in one.trials) and one.stopped == "max_evals"


def test_parameters_keep_to_the_space():
    for t in search(bowl, SPACE, 60, seed=1).trials:
        assert -5 <= t.params["x"] <= 5 and 1e-4 <= t.params["y"] <= 1e2 and t.params["kind"] in "abc"
        assert isinstance(t.params["k"], int) and 1 <= t.params["k"] <= 9
    for bad in ((1, 1, False), (0, 1, True)):
        with pytest.raises(ValueError):
            Span(*bad)


def test_better_than_random_search():
    """Of twenty seeds: the mean of the least losses, and how often the estimator ends lower."""
    found = [search(bowl, SPACE, 60, parallelism=2, seed=s).best.loss for s in range(20)]
    chance = [search(bowl, SPACE, 60, parallelism=2, seed=s, warm_up=10**9).best.loss for s in range(20)]
    assert sum(found) < 0.75 * sum(chance) and sum(a < b for a, b in zip(found, chance, strict=True)) >= 12


def test_budgets_and_concurrency():
    running, most, lock = [0], [0], threading.Lock()

    def slow(p):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        time.sleep(0.05)
        with lock:
            running[0] -= 1
        return p["x"]

    out = search(slow, {"x": Span(0, 1)}, 10, parallelism=4)
    assert len(out.trials) == 10 and 2 <= most[0] <= 4
    began = time.monotonic()
    out = search(slow, {"x": Span(0, 1)}, 10_000, timeout_seconds=0.5, parallelism=4)
    assert out.stopped == "timeout" and len(out.trials) < 200 and time.monotonic() - began < 2


def test_failures_are_kept_and_passed_over():
    def partly(p):
        if p["x"] < 0:
            raise RuntimeError("below")
        return math.nan if p["x"] < 1 else p["x"]

    out = search(partly, {"x": Span(-5, 5)}, 40, seed=2)
    assert {t.error for t in out.trials if t.params["x"] < 0} == {"below"} and out.best.params["x"] >= 1
    assert all(t.loss == math.inf for t in out.trials if t.params["x"] < 1)
    assert Search([Trial({}, 2.0), Trial({"a": 1}, 2.0)]).best.params == {}
    with pytest.raises(ValueError):
        search(partly, {}, 5)


def test_search_of_a_model(spark):
    import numpy as np

    rows = [(k, float(k % 11), float(k % 7), 2.0 * (k % 11 > 5) + (k % 7) / 7) for k in range(220)]
    df = spark.createDataFrame(rows, "k int, a double, b double, label double").repartition(2).cache()
    cfg = {"hyperopt": {"max_evals": 4, "timeout_seconds": 600}, "model": {"xgboost": {"n_estimators": 3, "learning_rate": 0.5}}, "experiment": {"seed": 7}}
    space = {"max_depth": Span(1, 3, whole=True)}
    one, two = (search_model(df.where("k % 3 > 0"), df.where("k % 3 = 0"), ["a", "b"], cfg, space=space, parallelism=2) for _ in range(2))
    assert [(t.params, t.loss) for t in one.trials] == [(t.params, t.loss) for t in two.trials] and all(np.isfinite(t.loss) for t in one.trials)
    assert propose(space, one.trials, np.random.default_rng(1), 2)["max_depth"] in (1, 2, 3)
    df.unpersist()
