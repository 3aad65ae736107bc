"""Results to files: metrics, predictions, configuration and metadata."""

from __future__ import annotations

import json
import os
from collections.abc import Sequence
from datetime import datetime, timezone
from typing import Any

import yaml
from pyspark.sql import DataFrame

from freshet.operators.temporal import in_time_order


def save_metrics(metrics: dict[str, Any], output_dir: str, filename: str) -> str:
    os.makedirs(output_dir, exist_ok=True)
    path = os.path.join(output_dir, filename)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(metrics, f, indent=2, default=str)
    return path


def save_predictions(df: DataFrame, output_dir: str, filename: str = "predictions.csv", time_col: str = "timestamp", pred: str = "predicted", obs: str = "observed", single_file: bool = True, keys: Sequence[str] = ()) -> str:
    """CSV of keys, time, predicted, observed, in time order. One file for small results; with
    ``single_file`` off every task writes its part."""
    out = in_time_order(df, time_col, keys).selectExpr(*[f"`{k}`" for k in keys], f"`{time_col}`", f"`{pred}` AS predicted", f"`{obs}` AS observed")
    path = os.path.join(output_dir, filename)
    (out.coalesce(1) if single_file else out).write.mode("overwrite").csv(path, header=True)
    return path


def save_config(cfg: dict[str, Any], output_dir: str, name: str) -> str:
    os.makedirs(output_dir, exist_ok=True)
    path = os.path.join(output_dir, f"{name}_config.yaml")
    with open(path, "w", encoding="utf-8") as f:
        yaml.dump(cfg, f)
    return path


def artifact_metadata(cfg: dict[str, Any], features: list[str], n_train: int, n_val: int, n_test: int) -> dict[str, Any]:
    experiment = cfg.get("experiment", {})
    return {
        "experiment": experiment.get("name", "unnamed"), "seed": experiment.get("seed", 42), "model_type": cfg.get("model", {}).get("kind", "xgboost"),
        "feature_names": features, "n_train": n_train, "n_val": n_val, "n_test": n_test, "trained_at": datetime.now(timezone.utc).isoformat(),
    }


def save_feature_importance(importance: DataFrame, output_dir: str, filename: str = "feature_importance.csv") -> str:
    """CSV of feature, importance: a row a feature, so one file."""
    path = os.path.join(output_dir, filename)
    importance.coalesce(1).write.mode("overwrite").csv(path, header=True)
    return path
