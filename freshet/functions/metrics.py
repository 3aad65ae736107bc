"""Verification metrics as aggregates, in one pass over (pred, obs) and by any keys.

NaN counts as missing everywhere. Undefined ratios are null; ``on_zero='zero'`` gives 0, ``on_zero='nan'`` NaN, as
a division of doubles in SQL engines that follow IEEE 754.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from datetime import datetime, timezone
from itertools import accumulate
from typing import Any

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _clean(c: str) -> Column:
    x = F.col(c).cast("double")
    return F.nanvl(x, F.lit(None).cast("double"))


def _pairs(pred: str, obs: str) -> tuple[Column, Column, Column]:
    p, o = _clean(pred), _clean(obs)
    return p, o, p.isNotNull() & o.isNotNull()


def rmse(pred: str = "pred", obs: str = "obs") -> Column:
    p, o, _ = _pairs(pred, obs)
    return F.sqrt(F.avg((p - o) * (p - o)))


def mae(pred: str = "pred", obs: str = "obs") -> Column:
    p, o, _ = _pairs(pred, obs)
    return F.avg(F.abs(p - o))


def mean_error(pred: str = "pred", obs: str = "obs") -> Column:
    p, o, _ = _pairs(pred, obs)
    return F.avg(p - o)


def nse(pred: str = "pred", obs: str = "obs") -> Column:
    """1 - SSE / SST over complete pairs; null without pairs or spread."""
    p, o, both = _pairs(pred, obs)
    o = F.when(both, o)
    return F.lit(1.0) - F.try_divide(F.sum((p - o) * (p - o)), F.nullif(F.var_pop(o) * F.count(o), F.lit(0.0)))


def r2(pred: str = "pred", obs: str = "obs") -> Column:
    """As :func:`nse`, but without spread 1 for a perfect fit, else 0; null below two pairs."""
    p, o, both = _pairs(pred, obs)
    o = F.when(both, o)
    sse, sst = F.sum((p - o) * (p - o)), F.var_pop(o) * F.count(o)
    flat = F.when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(F.count(o) >= 2, F.when(sst == 0, flat).otherwise(F.lit(1.0) - F.try_divide(sse, sst)))


#: What stands for an undefined ratio other than null.
_UNDEFINED = {"zero": 0.0, "nan": math.nan}
REGRESSION = {"RMSE": rmse, "MAE": mae, "NSE": nse, "ME": mean_error, "R2": r2}


def regression_metrics(df: DataFrame, pred: str = "pred", obs: str = "obs", by: Sequence[str] = (), names: Sequence[str] | None = None, digits: int | None = None) -> DataFrame:
    chosen = [n for n in (names or REGRESSION) if n in REGRESSION]
    shape = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    return df.groupBy(*by).agg(*[shape(REGRESSION[n](pred, obs)).alias(n) for n in chosen])


def skill_by_horizon(df: DataFrame, pred: str = "pred", obs: str = "label", reference: str | None = None, by: Sequence[str] = ("horizon",), digits: int | None = None) -> DataFrame:
    """Regression metrics a horizon in one aggregation, with the number of complete pairs ``n`` and, against a
    ``reference`` forecast (persistence, say), ``SS`` = 1 - MSE / MSE of the reference over rows that have both; null
    where the reference has no error."""
    shape = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    p, o, both = _pairs(pred, obs)
    wanted = {"n": F.count_if(both), **{k: shape(REGRESSION[k](pred, obs)) for k in REGRESSION}}
    if reference is not None:
        r = _clean(reference)
        error, theirs = (F.sum(F.when(both & r.isNotNull(), (x - o) * (x - o))) for x in (p, r))
        wanted["SS"] = shape(F.lit(1.0) - F.try_divide(error, F.nullif(theirs, F.lit(0.0))))
    return df.groupBy(*by).agg(*[c.alias(k) for k, c in wanted.items()])


def contingency(threshold: float, pred: str = "pred", obs: str = "obs") -> dict[str, Column]:
    """TP, FP, FN, TN; a missing value is a non-event, so the four add up to all rows."""
    p, o = (F.coalesce(_clean(c) >= F.lit(float(threshold)), F.lit(False)) for c in (pred, obs))
    return {"TP": F.count_if(p & o), "FP": F.count_if(p & ~o), "FN": F.count_if(~p & o), "TN": F.count_if(~p & ~o)}


def event_scores(on_zero: str = "null", digits: int | None = None) -> dict[str, Column]:
    """POD, recall, FAR, CSI, precision, F1 over columns TP, FP, FN."""
    tp, fp, fn = (F.col(c).cast("double") for c in ("TP", "FP", "FN"))

    def ratio(a: Column, b: Column) -> Column:
        x = F.try_divide(a, b)
        x = F.coalesce(x, F.lit(_UNDEFINED[on_zero])) if on_zero in _UNDEFINED else x
        return F.round(x, digits) if digits is not None else x

    pod, precision = ratio(tp, tp + fn), ratio(tp, tp + fp)
    return {"POD": pod, "recall": pod, "FAR": ratio(fp, tp + fp), "CSI": ratio(tp, tp + fp + fn), "precision": precision, "F1": ratio(2 * tp, 2 * tp + fp + fn)}


def event_metrics(df: DataFrame, threshold: float, pred: str = "pred", obs: str = "obs", by: Sequence[str] = (), on_zero: str = "null", digits: int | None = None) -> DataFrame:
    counts = df.groupBy(*by).agg(*[c.alias(n) for n, c in contingency(threshold, pred, obs).items()])
    return counts.select(*by, F.lit(float(threshold)).alias("threshold"), "TP", "FP", "FN", "TN", *[c.alias(n) for n, c in event_scores(on_zero, digits).items()], (F.col("TP") + F.col("FN")).alias("n_observed_events"))


def roc_auc(df: DataFrame, threshold: float, pred: str = "pred", obs: str = "obs", per_range: int = 100_000, on_zero: str = "null") -> DataFrame:
    """roc_auc (one row) of ``obs >= threshold`` by the score ``pred``, ties half: null unless
    both classes occur (with ``on_zero='nan'`` NaN if only events do: 0 wins over 0 pairs). Rows without a prediction are left out.

    Rows fold into one per distinct score (map-side), scores into ranges between quantiles,
    as many as leave about ``per_range`` distinct scores in each; ranks come from range
    totals (a row a range on the driver) and running sums inside a range.
    """
    scores = df.where(_clean(pred).isNotNull()).groupBy(_clean(pred).alias("s")).agg(
        F.count_if(F.coalesce(_clean(obs) >= F.lit(float(threshold)), F.lit(False))).alias("pos"), F.count("*").alias("n"))
    scores = scores.select("s", "pos", (F.col("n") - F.col("pos")).alias("neg"))
    ranges = -(-scores.count() // per_range)
    cuts = []
    if ranges > 1:
        cuts = sorted(set(scores.agg(F.percentile_approx("s", [k / ranges for k in range(1, ranges)], 100 * ranges)).first()[0]))
    if cuts:
        ranged = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="s", outputCol="b").transform(scores).withColumn("b", F.col("b").cast("int"))
    else:
        ranged = scores.withColumn("b", F.lit(0))
    totals = sorted(ranged.groupBy("b").agg(F.sum("neg").alias("neg")).collect())  # a row a range
    before = list(accumulate((r["neg"] for r in totals), initial=0))
    starts = df.sparkSession.createDataFrame([(r["b"], n) for r, n in zip(totals, before, strict=False)], "b int, start long")
    inside = F.coalesce(F.sum("neg").over(Window.partitionBy("b").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wins = ranged.withColumn("inside", inside).join(F.broadcast(starts), "b").withColumn("lower", F.col("start") + F.col("inside"))
    area = F.try_divide(F.sum(F.col("pos") * (F.col("lower") + F.col("neg") * F.lit(0.5))), F.sum("pos").cast("double") * F.sum("neg").cast("double"))
    if on_zero == "nan":
        area = F.when(F.sum("pos") > 0, F.coalesce(area, F.lit(math.nan)))
    return wins.agg(area.alias("roc_auc"))


def alert_metrics(df: DataFrame, threshold: float, pred: str = "pred", obs: str = "obs", on_zero: str = "zero") -> DataFrame:
    """One row: precision, recall, f1 (``on_zero`` where undefined), roc_auc, counts and the threshold."""
    auc = roc_auc(df, threshold, pred, obs, on_zero=on_zero).first()["roc_auc"]
    e = event_metrics(df, threshold, pred, obs, on_zero=on_zero)
    return e.select(
        "precision", "recall", F.col("F1").alias("f1"), F.lit(auc).cast("double").alias("roc_auc"), F.col("n_observed_events").alias("n_flood_events_observed"),
        F.col("threshold").alias("threshold_m"), "TP", "FP", "FN", "TN",
    )


def evaluate(df: DataFrame, cfg: dict[str, Any], split_name: str = "test", pred: str = "pred", obs: str = "obs") -> dict[str, Any]:
    """All configured metrics as a flat dict. Alert metrics need explicit warning and danger
    levels: a level that the config doesn't give is skipped."""
    spec, alert = cfg.get("evaluation", {}), cfg.get("alert", {})
    names = [n for n in spec.get("regression_metrics", list(REGRESSION)) if n in REGRESSION]
    row = df.agg(F.count("*").alias("n_samples"), *[REGRESSION[n](pred, obs).alias(n) for n in names]).first().asDict()
    out = {"experiment": cfg.get("experiment", {}).get("name", "unnamed"), "split": split_name, "n_samples": row.pop("n_samples"), "evaluated_at": datetime.now(timezone.utc).isoformat(), **row}
    if spec.get("classification_metrics"):
        for level in ("warning_level", "danger_level"):
            if alert.get(f"{level}_m") is not None:
                found = alert_metrics(df, alert[f"{level}_m"], pred, obs).first().asDict()
                out |= {f"{level}_{k}": v for k, v in found.items()}
    return out
