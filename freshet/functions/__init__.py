"""Column and aggregate builders: risk rules and verification metrics."""
