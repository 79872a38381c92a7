"""Operators on panels, on the predictions table and on the metrics table."""
