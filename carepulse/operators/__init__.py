"""Reusable DataFrame operators: global ranking, shares, quantiles, time series."""
