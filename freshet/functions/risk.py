"""Rule-based flood and landslide risk as Column expressions.

Thresholds are a driver-side dict compiled to literals; which columns exist decides at
plan time which conditions are built, nulls decide at run time. Severities are 0 to 4:
none, low, moderate, high, extreme. No UDF, no shuffle: a projection.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet.errors import FloodThresholdsNotCalibratedError, ThresholdsNotCalibratedError
from freshet.sources.config import null_leaves

NONE, LOW, MODERATE, HIGH, EXTREME = range(5)
SEVERITY_NAMES = ("NONE", "LOW", "MODERATE", "HIGH", "EXTREME")
RAIN_WINDOWS = (1, 3, 6, 12, 24)
API, LEVEL, RISE, RAIN = "antecedent_precipitation_index", "water_level_m", "water_level_m_delta_1", "rainfall_mm_hr"


def _text(template: str, value: Column, threshold: float | None = None, exact: bool = False) -> Column:
    """A reason: ``{v}`` is the value as a number format, ``{t}`` the threshold (as its own digits, or in that format)."""
    head, _, rest = template.partition("{v")
    fmt, _, tail = rest.partition("}")
    shown = (f"%{fmt}" % threshold if exact else str(float(threshold))) if threshold is not None else ""
    quote = lambda s: s.replace("{t}", shown).replace("%", "%%")
    return F.format_string(quote(head) + f"%{fmt}" + quote(tail), value)


def _ladder(value: Column, steps: list[tuple[float | None, int, bool, str]], otherwise: tuple[int, bool, Column], exact: bool = False) -> tuple[Column, Column, Column]:
    """(severity, fired, reason) of the first step (threshold, severity, fired, template) that value reaches."""
    sev = fired = reason = None
    for threshold, s, f, template in steps:
        if threshold is None:
            continue
        hit, text = value >= F.lit(float(threshold)), _text(template, value, float(threshold), exact)
        sev = F.when(hit, s) if sev is None else sev.when(hit, s)
        fired = F.when(hit, f) if fired is None else fired.when(hit, f)
        reason = F.when(hit, text) if reason is None else reason.when(hit, text)
    if sev is None:
        return F.lit(otherwise[0]), F.lit(otherwise[1]), otherwise[2]
    return sev.otherwise(otherwise[0]), fired.otherwise(otherwise[1]), reason.otherwise(otherwise[2])


def _used(*thresholds: float | None) -> Column:
    """The first threshold that is given and not 0."""
    return F.lit(next((float(t) for t in thresholds if t), None)).cast("double")


def _value(df: DataFrame, name: str) -> Column:
    """A column as double with NaN as null; null where the frame lacks it."""
    if name not in df.columns:
        return F.lit(None).cast("double")
    x = F.col(f"`{name}`").cast("double")
    return F.nanvl(x, F.lit(None).cast("double"))


def _any(columns: list[Column], empty: bool = False) -> Column:
    return reduce(lambda a, b: a | b, columns) if columns else F.lit(empty)


_CONDITION = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("fired", T.BooleanType()), T.StructField("severity", T.IntegerType()),
    T.StructField("value", T.DoubleType()), T.StructField("threshold_used", T.DoubleType()), T.StructField("reason", T.StringType()),
])


class FloodThresholdBaseline:
    """Ordered thresholds over rainfall sums, antecedent wetness, level and rate of rise.

    A threshold group that is absent switches its condition off; a null threshold is an
    error. Any condition of moderate severity or more triggers; the risk is the highest
    triggered severity, one more (at most extreme) where antecedent wetness is high.
    """

    def __init__(self, thresholds: dict[str, Any]):
        bad = sorted(null_leaves(thresholds))
        if bad:
            raise FloodThresholdsNotCalibratedError(f"Thresholds not calibrated: {', '.join(bad)} are null")
        self.thresholds = thresholds

    @classmethod
    def from_config(cls, cfg: dict[str, Any]) -> FloodThresholdBaseline:
        if not cfg.get("thresholds"):
            raise FloodThresholdsNotCalibratedError("Thresholds not calibrated: the config has no 'thresholds'")
        return cls(cfg["thresholds"])

    def fit(self, df: DataFrame | None = None) -> FloodThresholdBaseline:
        return self

    def __repr__(self) -> str:
        level = self.thresholds.get("water_level", {})
        return f"FloodThresholdBaseline(WL={level.get('warning_level_m')}, DL={level.get('danger_level_m')})"

    def _rain(self, v: Column, t: dict) -> tuple[Column, Column, Column, Column]:
        steps = [(t.get(k), s, f, f"{k.capitalize()} rainfall accumulation ({{v.1f}} mm >= {{t}} mm)") for k, s, f in (("high", HIGH, True), ("moderate", MODERATE, True), ("low", LOW, False))]
        return *_ladder(v, steps, (NONE, False, _text("Rainfall within normal range ({v.1f} mm)", v))), _used(t.get("high"), t.get("moderate"))

    def _wetness(self, v: Column, t: dict) -> tuple[Column, Column, Column, Column]:
        steps = [(t.get("high"), HIGH, True, "High antecedent wetness ({v.1f} >= {t})"), (t.get("moderate"), MODERATE, True, "Moderate antecedent wetness ({v.1f} >= {t})")]
        return *_ladder(v, steps, (NONE, False, _text("Normal antecedent wetness ({v.1f})", v))), _used(t.get("high"), t.get("moderate"))

    def _level(self, v: Column, t: dict) -> tuple[Column, Column, Column, Column]:
        steps = [
            (t.get("hfl_m"), EXTREME, True, "At/above Highest Flood Level ({v.2f} m >= HFL {t} m)"),
            (t.get("danger_level_m"), HIGH, True, "Above Danger Level ({v.2f} m >= DL {t} m) — flooding likely"),
            (t.get("warning_level_m"), MODERATE, True, "Above Warning Level ({v.2f} m >= WL {t} m) — above normal situation"),
        ]
        return *_ladder(v, steps, (NONE, False, _text("Water level normal ({v.2f} m)", v)), exact=True), _used(t.get("danger_level_m"), t.get("warning_level_m"))

    def _rise(self, v: Column, t: dict) -> tuple[Column, Column, Column, Column]:
        steps = [
            (t.get("critical_m_per_hr"), EXTREME, True, "Critical rate of rise ({v.3f} m/hr >= {t} m/hr) — rapid flash-flood conditions"),
            (t.get("warning_m_per_hr"), HIGH, True, "Warning rate of rise ({v.3f} m/hr >= {t} m/hr)"),
        ]
        slow = F.when(v > 0, LOW).otherwise(NONE)
        text = F.when(v > 0, _text("Rising slowly ({v.3f} m/hr, below warning)", v)).otherwise(_text("Stable or falling ({v.3f} m/hr)", v))
        return *_ladder(v, steps, (slow, False, text)), _used(t.get("critical_m_per_hr"), t.get("warning_m_per_hr"))

    def assessment(self, df: DataFrame) -> Column:
        """struct(risk_level, triggered_rules, missing_inputs, conditions, explanation)."""
        t, missing, conditions, rain_seen = self.thresholds, [], [], []

        def condition(name: str, v: Column, built: tuple, also: Column | None = None) -> None:
            sev, fired, reason, used = built
            there = v.isNotNull() if also is None else v.isNotNull() & also
            conditions.append(F.when(there, F.struct(F.lit(name).alias("name"), fired.alias("fired"), sev.cast("int").alias("severity"), v.alias("value"), used.alias("threshold_used"), reason.alias("reason")).cast(_CONDITION)))

        for hours in RAIN_WINDOWS:
            name = f"rainfall_mm_hr_rolling_sum_{hours}"
            v = _value(df, name)
            missing.append(F.when(v.isNull(), F.lit(name)))
            if name in df.columns and f"rainfall_{hours}h" in t:
                rain_seen.append(v.isNotNull())
                condition(f"cumulative_rainfall_{hours}h", v, self._rain(v, t[f"rainfall_{hours}h"]))
        v, none_seen = _value(df, RAIN), ~_any(rain_seen)
        missing.append(F.when(none_seen & v.isNull(), F.lit(RAIN)))
        if RAIN in df.columns and "rainfall_intensity" in t:
            condition("cumulative_rainfall_1h", v, self._rain(v, t["rainfall_intensity"]), none_seen)
        for name, column, group, rule in (("antecedent_wetness", API, "antecedent_wetness", self._wetness), ("water_level_state", LEVEL, "water_level", self._level), ("rate_of_rise", RISE, "rate_of_rise", self._rise)):
            v = _value(df, column)
            missing.append(F.when(v.isNull(), F.lit(column)))
            if column in df.columns and group in t:
                condition(name, v, rule(v, t[group]))
        empty = F.array().cast(T.ArrayType(_CONDITION))
        found = F.array_compact(F.array(*conditions)) if conditions else empty
        triggers = F.filter(found, lambda c: c["severity"] >= MODERATE)
        base = F.coalesce(F.array_max(F.transform(triggers, lambda c: c["severity"])), F.lit(NONE))
        wet = F.exists(found, lambda c: (c["name"] == "antecedent_wetness") & (c["severity"] >= HIGH))
        risk = F.when((base > NONE) & wet, F.least(base + 1, F.lit(EXTREME))).otherwise(base)
        return F.struct(
            risk.cast("int").alias("risk_level"), F.transform(triggers, lambda c: c["name"]).alias("triggered_rules"),
            F.array_sort(F.array_distinct(F.array_compact(F.array(*missing)))).alias("missing_inputs"), found.alias("conditions"),
        )

    def predict_explained(self, df: DataFrame) -> DataFrame:
        """Adds ``assessment`` and ``explanation`` (condition name to reason)."""
        out = df.withColumn("assessment", self.assessment(df))
        return out.withColumn("explanation", F.map_from_entries(F.transform("assessment.conditions", lambda c: F.struct(c["name"], c["reason"]))))

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds ``risk_level`` (0 to 4)."""
        return df.withColumn("_a", self.assessment(df)).withColumn("risk_level", F.col("_a.risk_level")).drop("_a")


_INDICATOR = T.StructType([T.StructField("name", T.StringType()), T.StructField("severity", T.IntegerType()), T.StructField("value", T.DoubleType()), T.StructField("reason", T.StringType())])


class LandslideThresholdBaseline:
    """Five indicators; rain or rise of moderate severity triggers; unsusceptible terrain caps at
    low; saturated soil adds one; the water level only explains."""

    def __init__(self, thresholds: dict[str, Any]):
        bad = sorted(null_leaves(thresholds))
        if bad:
            raise ThresholdsNotCalibratedError(f"Thresholds not calibrated: {', '.join(bad)} are null")
        self.thresholds = thresholds

    @classmethod
    def from_config(cls, cfg: dict[str, Any]) -> LandslideThresholdBaseline:
        if not cfg.get("thresholds"):
            raise ThresholdsNotCalibratedError("Thresholds not calibrated: the config has no 'thresholds'")
        return cls(cfg["thresholds"])

    def fit(self, df: DataFrame | None = None) -> LandslideThresholdBaseline:
        return self

    def __repr__(self) -> str:
        return f"LandslideThresholdBaseline(groups={sorted(self.thresholds)})"

    # Names, words and number formats of the reasons.
    #: name, column, threshold group, unit of the value, steps high to low as (key, severity, word), number format
    RULES = (
        ("rainfall_intensity", RAIN, "rainfall_intensity", " mm/hr", (("extreme", EXTREME, "Extreme"), ("heavy", HIGH, "Heavy"), ("moderate", MODERATE, "Moderate"), ("light", LOW, "Light")), ".1f"),
        ("antecedent_wetness", "soil_moisture_pct", "antecedent_wetness", "%", (("saturated", HIGH, "Saturated"), ("wet", MODERATE, "Wet"), ("moist", LOW, "Moist")), ".1f"),
        ("water_level_state", LEVEL, "water_level", " m", (("critical", EXTREME, "Critical"), ("high", HIGH, "High"), ("elevated", MODERATE, "Elevated")), ".2f"),
        ("rate_of_rise", RISE, "rate_of_rise", " m/hr", (("critical", EXTREME, "Critical rise"), ("warning", HIGH, "Warning rise")), ".3f"),
        ("terrain_susceptibility", "terrain_susceptibility", "terrain_susceptibility", "", (("high", HIGH, "High susceptibility"), ("moderate", MODERATE, "Moderate susceptibility")), ".2f"),
    )
    _ELSE = {"rainfall_intensity": "None", "antecedent_wetness": "Dry", "water_level_state": "Normal", "terrain_susceptibility": "Low susceptibility"}

    def assessment(self, df: DataFrame) -> Column:
        """struct(risk_level, trigger_active, indicators)."""
        found, severity = [], {}
        for name, column, group, unit, steps, fmt in self.RULES:
            if column not in df.columns:
                severity[name] = F.lit(None).cast("int")
                continue
            t, v = self.thresholds[group], _value(df, column)  # an absent group is a KeyError here
            ladder = [(t[k], s, True, f"{word} ({{v{fmt}}}{unit} >= {{t}}{unit})") for k, s, word in steps]
            if name == "rate_of_rise":
                rest = (F.when(v > 0, LOW).otherwise(NONE), False, F.when(v > 0, _text("Rising ({v.3f} m/hr, below warning)", v)).otherwise(_text("Stable or falling ({v.3f} m/hr)", v)))
            else:
                least = float(t[steps[-1][0]])
                rest = (LOW if name == "terrain_susceptibility" else NONE, False, _text(f"{self._ELSE[name]} ({{v{fmt}}}{unit} < {{t}}{unit})", v, least))
            sev, _, reason = _ladder(v, ladder, rest)
            severity[name] = F.when(v.isNotNull(), sev)
            found.append(F.when(v.isNotNull(), F.struct(F.lit(name).alias("name"), sev.cast("int").alias("severity"), v.alias("value"), reason.alias("reason")).cast(_INDICATOR)))
        rain, rise = (F.coalesce(severity[n], F.lit(NONE)) for n in ("rainfall_intensity", "rate_of_rise"))
        active = (rain >= MODERATE) | (rise >= MODERATE)
        base = F.greatest(rain, rise)
        wet = F.coalesce(severity["antecedent_wetness"] >= HIGH, F.lit(False))
        risk = (
            F.when(~active, NONE)
            .when(F.coalesce(severity["terrain_susceptibility"] < MODERATE, F.lit(False)), LOW)
            .when(wet, F.least(base + 1, F.lit(EXTREME)))
            .otherwise(base)
        )
        indicators = F.array_compact(F.array(*found)) if found else F.array().cast(T.ArrayType(_INDICATOR))
        return F.struct(risk.cast("int").alias("risk_level"), active.alias("trigger_active"), indicators.alias("indicators"))

    def predict_explained(self, df: DataFrame) -> DataFrame:
        out = df.withColumn("assessment", self.assessment(df))
        return out.withColumn("explanation", F.map_from_entries(F.transform("assessment.indicators", lambda c: F.struct(c["name"], c["reason"]))))

    def predict(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_a", self.assessment(df)).withColumn("risk_level", F.col("_a.risk_level")).drop("_a")
