"""Predictions that arrive over time."""
