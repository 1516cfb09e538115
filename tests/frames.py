"""Seeded frames of bars, and their way into Spark."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def walk(n: int, seed: int, step: float = 0.001, noise: float = 0.0006) -> pd.DataFrame:
    """A random walk from 100; draws in the order returns, highs, lows."""
    r = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(r.normal(0, step, n)))
    high = close * (1 + np.abs(r.normal(0, noise, n)))
    low = close * (1 - np.abs(r.normal(0, noise, n)))
    opened = np.concatenate([[close[0]], close[:-1]])
    return pd.DataFrame({"symbol": "S", "open_time": pd.date_range("2025-01-01", periods=n, freq="1min"), "open": opened, "high": high, "low": low, "close": close, "volume": 1.0})


def series(close, opened=None, high=None, low=None, symbol: str = "S") -> pd.DataFrame:
    close = np.asarray(close, float)
    given = lambda x: close if x is None else np.asarray(x, float)
    return pd.DataFrame({"symbol": symbol, "open_time": pd.date_range("2025-01-01", periods=len(close), freq="1min"), "open": given(opened), "high": given(high), "low": given(low), "close": close, "volume": 1.0})


def to_spark(spark: SparkSession, pdf: pd.DataFrame) -> DataFrame:
    from barloom.functions.columns import without_nan

    kinds = {"object": "string", "bool": "boolean"}
    schema = ", ".join(f"{c} {'timestamp_ntz' if 'datetime' in str(t) else kinds.get(str(t), 'long' if 'int' in str(t) else 'string' if str(t) in ('string', 'str') else 'double')}" for c, t in pdf.dtypes.items())
    return without_nan(spark.createDataFrame(pdf, schema))


def column(df: DataFrame, *names: str) -> pd.DataFrame:
    return df.select("symbol", "open_time", *names).toPandas().sort_values(["symbol", "open_time"]).reset_index(drop=True)
