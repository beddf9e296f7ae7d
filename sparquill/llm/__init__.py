"""Preparing training data: splits, duplicates, percentiles, rankings, leaks, mixing, screening."""
