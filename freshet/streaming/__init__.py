"""Streaming forms of hourly means and the wetness index (additions of ours)."""
