"""Errors raised by guards before a plan is built."""


class CWCJoinError(Exception):
    """Rainfall and water-level records can't be joined defensibly."""


class CWCSchemaError(Exception):
    """A telemetry file lacks required columns after normalisation."""


class FloodThresholdsNotCalibratedError(Exception):
    """Flood thresholds are missing or null."""


class ThresholdsNotCalibratedError(Exception):
    """Landslide thresholds are missing or null."""
