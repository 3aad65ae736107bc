"""Parameter search by a tree-structured Parzen estimator, with trials as concurrent Spark jobs."""

from __future__ import annotations

import logging
import math
import time
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from freshet.functions.metrics import rmse
from freshet.plans.model import FloodModel

log = logging.getLogger(__name__)

#: Random trials before the estimator has its say, the part of trials that counts as good (and at most how
#: many), and candidates that are weighed for a proposal.
WARM_UP, GOOD, MOST_GOOD, CANDIDATES = 12, 0.25, 25, 24


@dataclass(frozen=True)
class Span:
    """Numbers from ``low`` to ``high``; ``log`` spreads them evenly by their logarithm, ``whole`` rounds them."""

    low: float
    high: float
    log: bool = False
    whole: bool = False

    def __post_init__(self):
        if not self.low < self.high or (self.log and self.low <= 0):
            raise ValueError(f"no such span: {self}")

    def inside(self, x: float) -> float:
        return math.log(x) if self.log else float(x)

    def outside(self, z: float) -> float:
        x = min(max(math.exp(z) if self.log else z, self.low), self.high)
        return int(round(x)) if self.whole else x


@dataclass(frozen=True)
class Choice:
    """One of some values."""

    values: tuple


@dataclass
class Trial:
    params: dict[str, Any]
    loss: float = math.inf
    error: str | None = None


@dataclass
class Search:
    """Trials in the order of their proposals; ``stopped`` says which budget ended them."""

    trials: list[Trial] = field(default_factory=list)
    stopped: str = ""

    @property
    def best(self) -> Trial:
        """The trial of the least loss, the first of equal ones."""
        return min(self.trials, key=lambda t: t.loss)


class _Kernels:
    """A mixture of normal kernels at observed values, cut off at the ends of a span, with one as wide as the span for what wasn't tried."""

    def __init__(self, seen: list[float], low: float, high: float):
        self.low, self.high = low, high
        self.centres = np.sort(np.array([*seen, (low + high) / 2]))
        gaps = np.diff(np.concatenate([[low], self.centres, [high]]))
        width = np.maximum(gaps[:-1], gaps[1:])
        self.widths = np.clip(width, (high - low) / min(100, 1 + len(self.centres)), high - low)
        self.widths[np.argmin(np.abs(self.centres - (low + high) / 2))] = high - low

    def draw(self, rng: np.random.Generator, n: int) -> np.ndarray:
        k = rng.integers(len(self.centres), size=n)
        out = rng.normal(self.centres[k], self.widths[k])
        while (bad := (out < self.low) | (out > self.high)).any():
            out[bad] = rng.normal(self.centres[k[bad]], self.widths[k[bad]])
        return out

    def log_density(self, x: np.ndarray) -> np.ndarray:
        z = (x[:, None] - self.centres) / self.widths
        below = lambda v: np.array([0.5 * (1 + math.erf(t / math.sqrt(2))) for t in v])
        mass = below((self.high - self.centres) / self.widths) - below((self.low - self.centres) / self.widths)
        return np.log((np.exp(-z * z / 2) / (self.widths * mass)).sum(1) / len(self.centres))


def propose(space: dict[str, Span | Choice], done: Sequence[Trial], rng: np.random.Generator, warm_up: int = WARM_UP) -> dict[str, Any]:
    """Parameters of the next trial: random at first, then, one by one, the candidate that is most likely among the good
    trials in comparison with the others."""
    ranked = sorted(done, key=lambda t: t.loss)
    n_good = min(math.ceil(GOOD * len(ranked)), MOST_GOOD)
    out = {}
    for name, kind in space.items():
        if isinstance(kind, Choice):
            weights = np.ones(len(kind.values))
            if len(ranked) >= warm_up:
                good, rest = (np.array([1.0 + sum(t.params[name] == v for t in part) for v in kind.values]) for part in (ranked[:n_good], ranked[n_good:]))
                drawn = rng.choice(len(weights), size=CANDIDATES, p=good / good.sum())
                weights = np.zeros(len(weights))
                weights[drawn[np.argmax(np.log(good / good.sum())[drawn] - np.log(rest / rest.sum())[drawn])]] = 1.0
            out[name] = kind.values[int(rng.choice(len(weights), p=weights / weights.sum()))]
            continue
        low, high = kind.inside(kind.low), kind.inside(kind.high)
        if len(ranked) < warm_up:
            out[name] = kind.outside(rng.uniform(low, high))
            continue
        good, rest = (_Kernels([kind.inside(t.params[name]) for t in part], low, high) for part in (ranked[:n_good], ranked[n_good:]))
        drawn = good.draw(rng, CANDIDATES)
        out[name] = kind.outside(float(drawn[np.argmax(good.log_density(drawn) - rest.log_density(drawn))]))
    return out


def search(
    objective: Callable[[dict[str, Any]], float], space: dict[str, Span | Choice], max_evals: int = 100, timeout_seconds: float = 3600, parallelism: int = 4, seed: int = 42, warm_up: int = WARM_UP,
) -> Search:
    """Trials of ``objective`` (parameters to a loss), ``parallelism`` at a time, within a budget of trials and of time.

    Trials of one round are proposed from the rounds before and run in threads, so that their Spark jobs share the
    cluster; a round that has begun is finished. One seed gives one sequence of trials for one parallelism. A trial that
    fails, or whose loss isn't a number, has an infinite loss and its error.
    """
    if max_evals < 1 or parallelism < 1 or not space:
        raise ValueError("a search needs a space, one trial and one at a time at least")
    rng, out, began = np.random.default_rng(seed), Search(), time.monotonic()

    def run(trial: Trial) -> None:
        try:
            loss = float(objective(dict(trial.params)))
            trial.loss = loss if not math.isnan(loss) else math.inf
        except Exception as error:  # the search goes on without it
            trial.error = str(error)
            log.warning("trial %s failed: %s", trial.params, error)

    session = SparkSession.getActiveSession()
    with ThreadPoolExecutor(parallelism) as pool:
        while not out.stopped:
            batch = [Trial(propose(space, out.trials, rng, warm_up)) for _ in range(min(parallelism, max_evals - len(out.trials)))]
            list(pool.map(inheritable_thread_target(session)(run) if session else run, batch))
            out.trials += batch
            if len(out.trials) >= max_evals:
                out.stopped = "max_evals"
            elif time.monotonic() - began >= timeout_seconds:
                out.stopped = "timeout"
    return out


#: Where boosted trees are looked for unless the caller says otherwise.
TREE_SPACE = {
    "max_depth": Span(2, 10, whole=True), "learning_rate": Span(0.01, 0.3, log=True), "subsample": Span(0.5, 1.0), "colsample_bytree": Span(0.5, 1.0),
    "min_child_weight": Span(1, 20, log=True), "reg_alpha": Span(1e-3, 10, log=True), "reg_lambda": Span(1e-2, 10, log=True), "gamma": Span(1e-4, 1, log=True),
}


def search_model(
    train: DataFrame, validation: DataFrame, features: Sequence[str], cfg: dict[str, Any], kind: str = "xgboost", space: dict[str, Span | Choice] | None = None, parallelism: int = 4,
) -> Search:
    """Parameters of a :class:`FloodModel` by its RMSE on ``validation``, over those that ``cfg['model']`` fixes, with
    the budgets of ``cfg['hyperopt']`` (max_evals, timeout_seconds) and the experiment's seed. Both frames should be cached or
    written: every trial reads them."""
    spec, fixed = cfg.get("hyperopt") or {}, dict((cfg.get("model") or {}).get(kind) or {})

    def objective(params: dict[str, Any]) -> float:
        model = FloodModel(kind, fixed | params).fit(train, features, validation)
        loss = model.predict(validation).agg(rmse("predicted", "label")).first()[0]
        return math.nan if loss is None else loss

    seed = (cfg.get("experiment") or {}).get("seed", 42)
    return search(objective, space or TREE_SPACE, spec.get("max_evals", 100), spec.get("timeout_seconds", 3600), parallelism, seed)
