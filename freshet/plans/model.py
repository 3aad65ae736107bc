"""Boosted-tree water-level regressors over :mod:`freshet.plans.boosting`."""

from __future__ import annotations

import json
import logging
import os
from collections.abc import Sequence
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.plans.boosting import BoostedTrees, Boosting, fit_boosted_trees, known_parameters

log = logging.getLogger(__name__)

KINDS = ("xgboost", "gradient_boosting")
#: What a kind's parameters are where the configuration doesn't say. Fixed values.
DEFAULTS = {
    "xgboost": Boosting(),
    "gradient_boosting": Boosting(max_depth=3, learning_rate=0.1, reg_lambda=0.0, min_child_weight=0.0),
}
#: Parameters of the configuration that don't change a model of these kinds.
IDLE = ("n_jobs", "objective", "eval_metric", "loss", "criterion", "verbosity", "tree_method")


class FloodModel:
    """A regressor of the water level some hours on, of boosted trees on squared error.

    ``xgboost`` and ``gradient_boosting`` differ in their defaults (the former regularises) and in that only
    the former stops early where it gets validation rows. Parameters that this library
    doesn't know are logged and left out; an objective other than squared error is an error.
    """

    def __init__(self, kind: str = "xgboost", params: dict[str, Any] | None = None):
        if kind not in KINDS:
            raise ValueError(f"Unsupported model kind '{kind}'. Choose from {list(KINDS)}")
        self.kind, self.params = kind, dict(params or {})
        if self.params.get("objective", "reg:squarederror") != "reg:squarederror" or self.params.get("loss", "squared_error") != "squared_error":
            raise ValueError("models minimise squared error only")
        self.features: list[str] = []
        self.model: BoostedTrees | None = None

    def fit(self, train: DataFrame, features: Sequence[str], validation: DataFrame | None = None, order: Sequence[str] = ()) -> FloodModel:
        """``train`` has the feature columns and ``label``. One seed gives one model however the
        input was partitioned; ``order`` (columns that name a row) isn't needed for that any more."""
        self.features = list(features)
        params, unknown = known_parameters(self.params, DEFAULTS[self.kind])
        if left := [k for k in unknown if k not in IDLE]:
            log.info("parameters without a counterpart are left out: %s", left)
        self.model = fit_boosted_trees(train, self.features, params, validation=validation if self.kind == "xgboost" else None)
        return self

    def _fitted(self) -> BoostedTrees:
        if self.model is None:
            raise RuntimeError("Model is not fitted. Call fit() first.")
        return self.model

    def predict(self, df: DataFrame, clip_negative: bool = True) -> DataFrame:
        """Adds ``predicted`` (not below 0 with ``clip_negative``)."""
        out = self._fitted().predict(df, "predicted")
        return out.withColumn("predicted", F.greatest("predicted", F.lit(0.0))) if clip_negative else out

    def explain(self, df: DataFrame) -> DataFrame:
        """Adds ``attributions``, the Shapley value of every feature, and ``expected``: together they are the
        prediction (before it is clipped)."""
        return self._fitted().attribute(df)

    def feature_importance(self, spark: SparkSession, top_n: int = 20) -> DataFrame:
        """The largest parts of the gain of all splits; for ``xgboost`` of the mean gain of a feature's splits."""
        weights = self._fitted().importances(mean=self.kind == "xgboost")
        rows = [(n, float(w)) for n, w in zip(self.features, weights, strict=True)]  # a row a feature
        return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(top_n)

    def save(self, folder: str, name: str | None = None) -> str:
        path = os.path.join(folder, f"{name or 'flood'}_{self.kind}_{datetime.now(timezone.utc):%Y%m%dT%H%M%S}")
        model, spark = self._fitted(), SparkSession.getActiveSession()
        model.nodes(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        about = {"kind": self.kind, "params": self.params, "features": self.features, "base": model.base}
        spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/wrapper")
        return path

    @classmethod
    def load(cls, path: str) -> FloodModel:
        if "://" not in path and not os.path.exists(path):
            raise FileNotFoundError(f"Model not found: {path}")
        spark = SparkSession.getActiveSession()
        about = json.loads(spark.read.text(f"{path}/wrapper").first()[0])
        out = cls(about["kind"], about["params"])
        out.features, out.model = about["features"], BoostedTrees.from_nodes(about["base"], spark.read.parquet(f"{path}/nodes"), about["features"])
        return out

    def __repr__(self) -> str:
        state = "fitted" if self.model is not None else "not fitted"
        return f"FloodModel(kind={self.kind}, {state}, n_features={len(self.features)})"


def build_model_from_config(cfg: dict[str, Any]) -> FloodModel:
    spec = cfg.get("model", {})
    kind = spec.get("kind", "xgboost")
    return FloodModel(kind, dict(spec.get(kind) or {}))
