"""Bars, indicators, signals, simulated trading and its statistics as Spark DataFrames keyed by symbol."""
