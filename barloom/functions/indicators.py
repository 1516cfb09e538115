"""Indicators: functions from bars to bars with columns added. Values that are not yet warm are null."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.columns import KEY, TIME, bars_window, indicator
from barloom.functions.signals import forward_fill
from barloom.operators.fold import fold_sorted
from barloom.operators.recurrence import decayed_mean, linear_recurrence
from barloom.operators.rolling import rolling
from barloom.operators.timeframe import bucket_start, resample


@indicator(lambda period, source="close", out=None, adjust=False: [out or f"ema_{period}"])
def add_ema(df: DataFrame, period: int, source: str = "close", out: str | None = None, adjust: bool = False) -> DataFrame:
    """Exponential mean with alpha 2 / (period + 1), from the period-th value on."""
    return decayed_mean(df, out or f"ema_{period}", F.col(source), 2 / (period + 1), period, adjust)


def add_emas(df: DataFrame, periods: list[int], source: str = "close", prefix: str = "ema", adjust: bool = False) -> DataFrame:
    for p in periods:
        df = add_ema(df, int(p), source, f"{prefix}_{int(p)}", adjust)
    return df


def add_smas(df: DataFrame, periods: list[int], source: str = "close", prefix: str = "sma") -> DataFrame:
    """Simple means of the last bars; null unless all are there."""
    return rolling(df, {f"{prefix}_{int(p)}": ("mean", F.col(source), int(p)) for p in periods})


@indicator(lambda period=14, source="close", out=None: [out or f"rsi_{period}"])
def add_rsi(df: DataFrame, period: int = 14, source: str = "close", out: str | None = None) -> DataFrame:
    """Wilder's relative strength: 100 without losses, null without any movement."""
    out = out or f"rsi_{period}"
    move, gain, loss = (f"_{out}_{x}" for x in ("d", "up", "down"))
    df = df.withColumn(move, F.col(source) - F.lag(source).over(bars_window()))
    df = decayed_mean(df, gain, F.greatest(F.col(move), F.lit(0.0)) + F.col(move) * 0, 1 / period, period)
    df = decayed_mean(df, loss, F.greatest(-F.col(move), F.lit(0.0)) + F.col(move) * 0, 1 / period, period)
    value = F.when(F.col(loss) > 0, 100 - 100 / (1 + F.col(gain) / F.nullif(F.col(loss), F.lit(0.0)))).when(F.col(gain) > 0, F.lit(100.0))
    return df.withColumn(out, value).drop(move, gain, loss)


@indicator(lambda fast=12, slow=26, signal=9, source="close", prefix="macd": [prefix, f"{prefix}_signal", f"{prefix}_hist"])
def add_macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, source: str = "close", prefix: str = "macd") -> DataFrame:
    """The difference of two exponential means, its own mean from its first value on, and what is between."""
    a, b = f"_{prefix}_f", f"_{prefix}_s"
    df = add_ema(add_ema(df, fast, source, a), slow, source, b)
    df = df.withColumn(prefix, F.col(a) - F.col(b)).drop(a, b)
    df = add_ema(df, signal, prefix, f"{prefix}_signal")
    return df.withColumn(f"{prefix}_hist", F.col(prefix) - F.col(f"{prefix}_signal"))


@indicator(lambda k=14, d=3, smooth=3, prefix="stoch": [f"{prefix}_k", f"{prefix}_d"])
def add_stochastic(df: DataFrame, k: int = 14, d: int = 3, smooth: int = 3, prefix: str = "stoch") -> DataFrame:
    """Where the close lies in the range of k bars, in percent, smoothed once and twice."""
    raw, low, high = (f"_{prefix}_{x}" for x in ("raw", "low", "high"))
    df = rolling(df, {low: ("min", F.col("low"), k), high: ("max", F.col("high"), k)})
    df = df.withColumn(raw, 100 * F.try_divide(F.col("close") - F.col(low), F.col(high) - F.col(low))).drop(low, high)
    df = rolling(df, {f"{prefix}_k": ("mean", F.col(raw), smooth)}).drop(raw)
    return rolling(df, {f"{prefix}_d": ("mean", F.col(f"{prefix}_k"), d)})


def true_range() -> Column:
    """The bar's range, stretched to the close before; the first bar's own range."""
    before = F.lag("close").over(bars_window())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


@indicator(lambda period=14, out=None: [out or f"atr_{period}"])
def add_atr(df: DataFrame, period: int = 14, out: str | None = None) -> DataFrame:
    """Wilder's mean of the true range."""
    out = out or f"atr_{period}"
    tr = f"_{out}_tr"
    return decayed_mean(df.withColumn(tr, true_range()), out, F.col(tr), 1 / period, period).drop(tr)


def _bands(line: str):
    def fold(key: tuple, pieces: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        inf = float("inf")
        last = None  # close, final upper, final lower, direction
        for pdf in pieces:
            lines, ways = [], []
            for close, up, down in zip(pdf["close"].to_numpy(float), pdf["_up"].fillna(inf).to_numpy(float), pdf["_down"].fillna(-inf).to_numpy(float), strict=True):
                if last is None:
                    way, shown = -1, up
                else:
                    was, top, bottom, way = last
                    if was <= top:
                        up = min(up, top)
                    if was >= bottom:
                        down = max(down, bottom)
                    if way < 0 and close > top:
                        way = 1
                    elif way > 0 and close < bottom:
                        way = -1
                    shown = down if way > 0 else up
                last = (close, up, down, way)
                lines.append(shown)
                ways.append(way)
            yield pdf.drop(columns=["_up", "_down"]).assign(**{line: lines, f"{line}_dir": ways})

    return fold


@indicator(lambda period=10, multiplier=3.0, prefix="st": [prefix, f"{prefix}_dir", f"{prefix}_up"])
def add_supertrend(df: DataFrame, period: int = 10, multiplier: float = 3.0, prefix: str = "st") -> DataFrame:
    """The trailing band, its direction (+1, -1) and whether it is up.

    The ratchet depends on its own past, so each symbol is folded in order, in pieces: memory does not grow
    with the series.
    """
    a = f"_{prefix}_atr"
    df = add_atr(df.drop(prefix, f"{prefix}_dir", f"{prefix}_up"), period, a)
    mid = (F.col("high") + F.col("low")) / 2
    df = df.withColumn("_up", mid + multiplier * F.col(a)).withColumn("_down", mid - multiplier * F.col(a)).drop(a)
    kept = [f for f in df.schema.fields if f.name not in ("_up", "_down")]
    schema = T.StructType([*kept, T.StructField(prefix, T.DoubleType()), T.StructField(f"{prefix}_dir", T.IntegerType())])
    folded = fold_sorted(df, [KEY], [TIME], _bands(prefix), schema)
    return folded.withColumn(f"{prefix}_up", F.col(f"{prefix}_dir") == 1)


@indicator(lambda prefix="ha": [f"{prefix}_{c}" for c in ("open", "high", "low", "close", "green")])
def add_heikin_ashi(df: DataFrame, prefix: str = "ha") -> DataFrame:
    """Averaged candles; the open is a linear recurrence on the averages before."""
    o, h, lo, c = (f"{prefix}_{x}" for x in ("open", "high", "low", "close"))
    df = df.withColumn(c, (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4)
    before = f"_{prefix}_b"
    df = df.withColumn(before, F.lag(c).over(bars_window()))
    df = linear_recurrence(df, o, 0.5, (F.col("open") + F.col("close")) / 2, F.col(before) / 2, F.lit(True)).drop(before)
    df = df.withColumn(h, F.greatest("high", o, c)).withColumn(lo, F.least("low", o, c))
    return df.withColumn(f"{prefix}_green", F.coalesce(F.col(c) > F.col(o), F.lit(False)))


@indicator(lambda left=10, right=10, prefix="swing": [f"{prefix}_{c}" for c in ("high", "low", "last_high", "last_low")])
def add_swings(df: DataFrame, left: int = 10, right: int = 10, prefix: str = "swing") -> DataFrame:
    """Pivot highs and lows over [-left, right], known right bars later, and the last known of each."""
    w = bars_window()
    size = left + right + 1
    names = {"high": ("high", "max"), "low": ("low", "min")}
    # right bars after a pivot, all that is around it are the last bars
    df = rolling(df, {f"_{prefix}_{k}": (kind, F.col(c), size) for k, (c, kind) in names.items()})
    pivots = {k: F.lag(c, right).over(w) if right else F.col(c) for k, (c, _) in names.items()}
    df = df.withColumns({f"_{prefix}_{k}": F.when(at == F.col(f"_{prefix}_{k}"), at) for k, at in pivots.items()})
    df = df.withColumns({f"{prefix}_{k}": F.col(f"_{prefix}_{k}").isNotNull() for k in names})
    df = df.withColumns({f"{prefix}_last_{k}": forward_fill(f"_{prefix}_{k}") for k in names})
    return df.drop(*[f"_{prefix}_{k}" for k in names])


def add_pivot_points(df: DataFrame, rule: str = "1D", prefix: str = "piv") -> DataFrame:
    """Floor pivots of the last earlier period that has bars, for all bars of a period.

    The levels are made from the bars themselves, so every bar's period is there: an equi-join.
    """
    names = [f"{prefix}_{x}" for x in ("pp", "r1", "s1", "r2", "s2")]
    per = resample(df, rule)
    pp = (F.col("high") + F.col("low") + F.col("close")) / 3
    span = F.col("high") - F.col("low")
    values = dict(zip(names, (pp, 2 * pp - F.col("low"), 2 * pp - F.col("high"), pp + span, pp - span), strict=True))
    levels = per.select(KEY, F.col(TIME).alias("_bucket"), *[v.alias(n) for n, v in values.items()])
    w = Window.partitionBy(KEY).orderBy("_bucket")
    levels = levels.select(KEY, "_bucket", *[F.lag(n).over(w).alias(n) for n in names])
    return df.drop(*names).withColumn("_bucket", bucket_start(rule)).join(levels, [KEY, "_bucket"], "left").drop("_bucket")
