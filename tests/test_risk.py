"""Thresholds here are software test values only."""

import pytest

from freshet.errors import FloodThresholdsNotCalibratedError, ThresholdsNotCalibratedError
from freshet.functions.risk import FloodThresholdBaseline, LandslideThresholdBaseline

FLOOD = {
    **{f"rainfall_{h}h": dict(zip(("low", "moderate", "high"), v, strict=True)) for h, v in {1: (10, 25, 50), 3: (20, 50, 100), 6: (30, 75, 150), 12: (50, 100, 200), 24: (75, 150, 300)}.items()},
    "antecedent_wetness": {"moderate": 40, "high": 80}, "water_level": {"warning_level_m": 5, "danger_level_m": 7, "hfl_m": 10},
    "rate_of_rise": {"warning_m_per_hr": 0.3, "critical_m_per_hr": 0.8},
}
SLIDE = {
    "rainfall_intensity": {"light": 2.5, "moderate": 7.5, "heavy": 15, "extreme": 30}, "antecedent_wetness": {"moist": 30, "wet": 50, "saturated": 70},
    "water_level": {"elevated": 3, "high": 5, "critical": 7}, "rate_of_rise": {"warning": 0.2, "critical": 0.5}, "terrain_susceptibility": {"moderate": 0.4, "high": 0.7},
}
R1, API, WL, RISE = "rainfall_mm_hr_rolling_sum_1", "antecedent_precipitation_index", "water_level_m", "water_level_m_delta_1"


def one(spark, model, row):
    df = spark.createDataFrame([tuple(None if v is None else float(v) for v in row.values())], ", ".join(f"{k} double" for k in row))
    return model.predict_explained(df).first()


@pytest.mark.parametrize("row,risk", [
    ({R1: 60}, 3), ({R1: 30}, 2), ({R1: 12}, 0), ({R1: 0}, 0), ({R1: 50}, 3), ({WL: 8}, 3), ({WL: 5.5}, 2), ({WL: 10}, 4), ({WL: 4.9}, 0),
    ({RISE: 1.0}, 4), ({RISE: 0.5}, 3), ({RISE: 0.1}, 0), ({RISE: -0.5}, 0), ({R1: 30, API: 90}, 4), ({R1: 60, API: 90}, 4), ({R1: 30, API: 50}, 2), ({API: 90}, 4),
    ({R1: float("nan"), WL: None}, 0), ({"unrelated": 1}, 0),
])
def test_flood(spark, row, risk):  # high wetness is a trigger and its own amplifier
    assert one(spark, FloodThresholdBaseline(FLOOD), row)["assessment"]["risk_level"] == risk


def test_flood_explains(spark):
    r = one(spark, FloodThresholdBaseline(FLOOD), {R1: 12, WL: 8, RISE: None})
    a = r["assessment"]
    assert a["triggered_rules"] == ["water_level_state"]
    assert [c["name"] for c in a["conditions"]] == ["cumulative_rainfall_1h", "water_level_state"]
    assert RISE in a["missing_inputs"] and WL not in a["missing_inputs"] and a["missing_inputs"] == sorted(a["missing_inputs"])
    assert r["explanation"]["cumulative_rainfall_1h"] == "Low rainfall accumulation (12.0 mm >= 10.0 mm)"
    assert r["explanation"]["water_level_state"] == "Above Danger Level (8.00 m >= DL 7.00 m) — flooding likely"
    assert a["conditions"][1]["threshold_used"] == 7.0


def test_flood_fallback_on_current_rain(spark):
    model = FloodThresholdBaseline({**FLOOD, "rainfall_intensity": FLOOD["rainfall_1h"]})
    assert one(spark, model, {"rainfall_mm_hr": 60})["assessment"]["triggered_rules"] == ["cumulative_rainfall_1h"]
    both = one(spark, model, {"rainfall_mm_hr": 60, R1: 1})["assessment"]
    assert both["risk_level"] == 0 and "rainfall_mm_hr" not in both["missing_inputs"]


def test_flood_calibration(spark):
    with pytest.raises(FloodThresholdsNotCalibratedError, match="not calibrated"):
        FloodThresholdBaseline({"water_level": {"hfl_m": None}})
    with pytest.raises(FloodThresholdsNotCalibratedError, match="not calibrated"):
        FloodThresholdBaseline.from_config({})
    assert one(spark, FloodThresholdBaseline({}), {WL: 99})["assessment"]["risk_level"] == 0
    assert "WL=5" in repr(FloodThresholdBaseline(FLOOD).fit())


def test_batch_and_empty(spark):
    df = spark.createDataFrame([(60.0,), (30.0,), (0.0,)], f"{R1} double")
    model = FloodThresholdBaseline(FLOOD)
    assert [r["risk_level"] for r in model.predict(df).collect()] == [3, 2, 0]
    assert model.predict(df.limit(0)).count() == 0


RAIN, SOIL, TERRAIN = "rainfall_mm_hr", "soil_moisture_pct", "terrain_susceptibility"


@pytest.mark.parametrize("row,risk", [
    ({RAIN: 20, TERRAIN: 0.39}, 1), ({RAIN: 20, TERRAIN: 0.40}, 3), ({RAIN: 20}, 3), ({RAIN: 1, TERRAIN: 0.9}, 0), ({TERRAIN: 0.9, SOIL: 90}, 0),
    ({RAIN: 10, TERRAIN: 0.8}, 2), ({RAIN: 35, TERRAIN: 0.8}, 4), ({RAIN: 10, SOIL: 75, TERRAIN: 0.8}, 3), ({RAIN: 35, SOIL: 75, TERRAIN: 0.8}, 4),
    ({RAIN: 10, SOIL: 60, TERRAIN: 0.8}, 2), ({RISE: 0.6, TERRAIN: 0.8}, 4), ({RISE: 0.3, TERRAIN: 0.8}, 3), ({RISE: 0.05, TERRAIN: 0.8}, 0), ({WL: 9, TERRAIN: 0.8}, 0),
    ({RAIN: float("nan"), TERRAIN: 0.8}, 0),
])
def test_landslide(spark, row, risk):
    assert one(spark, LandslideThresholdBaseline(SLIDE), row)["assessment"]["risk_level"] == risk


def test_landslide_explains_and_guards(spark):
    a = one(spark, LandslideThresholdBaseline(SLIDE), {RAIN: 20, WL: 4, TERRAIN: 0.1})
    assert a["explanation"] == {"rainfall_intensity": "Heavy (20.0 mm/hr >= 15.0 mm/hr)", "water_level_state": "Elevated (4.00 m >= 3.0 m)", "terrain_susceptibility": "Low susceptibility (0.10 < 0.4)"}
    assert a["assessment"]["trigger_active"]
    with pytest.raises(ThresholdsNotCalibratedError, match="not calibrated"):
        LandslideThresholdBaseline.from_config({"thresholds": {"rainfall_intensity": {"light": None}}})
    with pytest.raises(KeyError):
        one(spark, LandslideThresholdBaseline({}), {RAIN: 1})
    assert one(spark, LandslideThresholdBaseline({}), {"x": 1})["assessment"]["risk_level"] == 0
