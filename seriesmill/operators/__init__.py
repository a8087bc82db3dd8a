"""Forecast combination, long-horizon correction, cross-validation helpers and series generators."""
