"""Signals on small series with known answers, and indicators against pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions import indicators as I
from barloom.functions import signals as S
from barloom.functions import time_filters as D
from barloom.operators import timeframe as R
from tests.frames import column, series, to_spark, walk


def answers(spark, pdf, expression):
    return column(to_spark(spark, pdf).withColumn("x", expression), "x")["x"].tolist()


T_, F_ = True, False
A = [1, 2, 3, 2, 1]


@pytest.mark.parametrize(
    ("close", "opened", "make", "want"),
    [
        (A, None, lambda: S.cross_up("close", 2.5), [F_, F_, T_, F_, F_]),
        (A, None, lambda: S.cross_down("close", 2.5), [F_, F_, F_, T_, F_]),
        ([1, 3, 3, 3, 0], None, lambda: S.last_all_above("close", 2, 3), [F_, F_, F_, T_, F_]),
        ([1, 1, 1, 5], None, lambda: S.prev_all_below("close", 2, 2), [F_, F_, T_, T_]),
        ([2, 3, 4, 1], [1, 2, 3, 2], lambda: S.consecutive_green(2), [F_, T_, T_, F_]),
        (A, None, lambda: S.crossed_up_within("close", 2.5, 2), [F_, F_, T_, T_, F_]),
        (A, None, lambda: S.crossed_up_within("close", 2.5, 0), [F_] * 5),
        (A, None, lambda: S.rising("close", 2), [F_, F_, T_, F_, F_]),
        (A, None, lambda: S.falling("close"), [F_, F_, F_, T_, T_]),
        (A, None, lambda: S.last_all_above("close", 0, 0), [F_] * 5),
        (A, None, lambda: S.last_all_above("close", 0, 9), [F_] * 5),
        ([np.nan, 2], None, lambda: S.above("close", 1), [F_, T_]),
        ([np.nan, 2], None, lambda: S.none_of(S.above("close", 1)), [T_, F_]),
        ([np.nan, 2], None, lambda: S.above_all("close", []), [T_, T_]),
        ([3, 1], [2, 2], lambda: S.refs_ordered(["close", "open", 1.0]), [T_, F_]),
        ([1, 1], [1, 2], lambda: S.refs_ordered(["close", "open"], descending=False), [T_, T_]),
    ],
)
def test_primitives(spark, close, opened, make, want):
    assert answers(spark, series(close, opened), make()) == want


def test_combinators(spark):
    pdf = series([1, 1, 0], [1, 0, 0])
    a, b = S.above("close", 0.5), S.above("open", 0.5)
    assert answers(spark, pdf, S.all_of(a, b)) == [T_, F_, F_]
    assert answers(spark, pdf, S.any_of(a, b)) == [T_, T_, F_]
    assert answers(spark, pdf, S.none_of(a, b)) == [F_, F_, T_]
    with pytest.raises(ValueError):
        S.all_of()
    with pytest.raises(ValueError):
        D.in_session("mars")


def test_symbols_do_not_leak(spark):
    both = pd.concat([series([1, 2, 3], symbol="A"), series([9, 1, 3], symbol="B")])
    assert answers(spark, both, S.cross_up("close", 2.5)) == [F_, F_, T_, F_, F_, T_]


def test_time_filters(spark):
    pdf = series(range(4))
    pdf["open_time"] = pd.to_datetime(["2025-01-03 23:30", "2025-01-04 05:59", "2025-01-05 06:00", "2025-01-06 13:30"])
    assert answers(spark, pdf, D.in_session("sydney")) == [T_, T_, F_, F_]
    assert answers(spark, pdf, D.not_weekend()) == [T_, F_, F_, T_]
    assert answers(spark, pdf, D.between_times("13:30", "06:00")) == [T_, T_, F_, T_]
    assert answers(spark, pdf, D.hour_between(8, 9, tz="America/New_York")) == [F_, F_, F_, T_]


def wilder(x, p):
    return x.ewm(alpha=1 / p, adjust=False, min_periods=p).mean()


def expected(df: pd.DataFrame) -> pd.DataFrame:
    c, h, lo = df["close"], df["high"], df["low"]
    out = {"ema_20": c.ewm(span=20, adjust=False, min_periods=20).mean(), "ema_3": c.ewm(span=3, adjust=False, min_periods=3).mean(), "sma_7": c.rolling(7).mean()}
    d = c.diff()
    out["rsi_14"] = 100 - 100 / (1 + wilder(d.clip(lower=0), 14) / wilder((-d).clip(lower=0), 14))
    macd = c.ewm(span=12, adjust=False, min_periods=12).mean() - c.ewm(span=26, adjust=False, min_periods=26).mean()
    out["macd"], out["macd_signal"] = macd, macd.ewm(span=9, adjust=False, min_periods=9).mean()
    low, high = lo.rolling(14).min(), h.rolling(14).max()
    out["stoch_k"] = (100 * (c - low) / (high - low)).rolling(3).mean()
    out["stoch_d"] = out["stoch_k"].rolling(3).mean()
    tr = pd.concat([h - lo, (h - c.shift()).abs(), (lo - c.shift()).abs()], axis=1).max(axis=1)
    out["atr_14"] = wilder(tr, 14)
    return pd.DataFrame(out)


def test_indicators_match_pandas(spark):
    pdf = walk(2500, 11)
    df = to_spark(spark, pdf)
    df = I.add_atr(I.add_stochastic(I.add_macd(I.add_rsi(I.add_smas(I.add_emas(df, [20, 3]), [7])))))
    want = expected(pdf)
    got = column(df, *want.columns)[want.columns]
    for c in want:
        assert (got[c].isna() == want[c].isna()).all(), c
        np.testing.assert_allclose(got[c].dropna(), want[c].dropna(), rtol=1e-9, atol=1e-11, err_msg=c)


def test_adjusted_ema_and_heikin_ashi(spark):
    pdf = walk(800, 5)
    df = I.add_heikin_ashi(I.add_ema(to_spark(spark, pdf), 10, adjust=True))
    got = column(df, "ema_10", "ha_open", "ha_close")
    np.testing.assert_allclose(got["ema_10"].dropna(), pdf["close"].ewm(span=10, min_periods=10).mean().dropna(), rtol=1e-9)
    mean = pdf[["open", "high", "low", "close"]].mean(axis=1).to_numpy()
    o = [(pdf["open"][0] + pdf["close"][0]) / 2]
    for m in mean[:-1]:
        o.append((o[-1] + m) / 2)
    np.testing.assert_allclose(got["ha_open"], o, rtol=1e-12)


def test_rsi_without_moves(spark):
    up, flat = series(range(1, 30), symbol="U"), series([5.0] * 29, symbol="F")
    got = column(I.add_rsi(to_spark(spark, pd.concat([flat, up])), 14), "rsi_14")
    assert got[got.symbol == "U"]["rsi_14"].tolist()[14:] == [100.0] * 15
    assert got[got.symbol == "F"]["rsi_14"].isna().all()


def test_supertrend_streams_in_pieces(spark):
    pdf = pd.concat([walk(700, k).assign(symbol=s) for k, s in enumerate("AB")])
    whole = column(I.add_supertrend(to_spark(spark, pdf)), "st", "st_dir")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        cut = column(I.add_supertrend(to_spark(spark, pdf)), "st", "st_dir")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    pd.testing.assert_frame_equal(whole, cut)
    assert set(whole["st_dir"]) == {1, -1}


def test_indicator_reuse_tells_parameters_apart(spark):
    from barloom.functions.columns import reusing_columns

    df = to_spark(spark, walk(60, 1))
    with reusing_columns():
        one = I.add_macd(df, 3, 6, 2)
        assert I.add_macd(one, 3, 6, 2) is one
        ema = I.add_emas(one, [5])
        assert I.add_emas(ema, [5]) is ema
        two = I.add_macd(one, 4, 9, 2)
    want = I.add_macd(df, 4, 9, 2)
    pd.testing.assert_frame_equal(column(two, "macd"), column(want, "macd"))


def test_resample_and_asof(spark):
    pdf = walk(400, 3).drop(index=range(100, 180))
    df = to_spark(spark, pdf)
    got = column(R.resample(df, "15min"), "open", "high", "low", "close", "volume")
    rule = {"open": "first", "high": "max", "low": "min", "close": "last", "volume": "sum"}
    want = pdf.set_index("open_time").resample("15min").agg(rule).dropna().reset_index()
    np.testing.assert_allclose(got[list(rule)], want[list(rule)])
    late = to_spark(spark, pdf.iloc[::9]).withColumn("v", F.col("close") * 2).withColumn("v", F.when(F.col("v") % 3 > 1, F.col("v")))
    joined = column(R.asof_join(df, late.select("symbol", "open_time", "v"), ["v"]), "v")
    right = late.select("open_time", "v").toPandas().sort_values("open_time")
    pd.testing.assert_series_equal(joined["v"], pd.merge_asof(pdf[["open_time"]], right, on="open_time")["v"], check_names=False)


def test_mtf_equals_alignment(spark):
    df = to_spark(spark, walk(600, 8))
    a = R.build_mtf(df, {"5min": lambda d: I.add_emas(d, [3])})
    b = R.align_timeframes(df, {"5min": I.add_emas(R.resample(df, "5min"), [3])})
    pd.testing.assert_frame_equal(column(a, "5min__ema_3"), column(b, "5min__ema_3"))


def test_bad_rule():
    with pytest.raises(ValueError):
        R.span("7 fortnights")
    assert R.span("5min") == "5 minute" and R.span("1D") == "1 day"


@pytest.mark.parametrize(("lookback", "size"), [(400, 450), (400, 5000)])
def test_chunks_give_the_same_as_the_whole(spark, lookback, size):
    from barloom.operators.chunks import in_chunks

    pdf = pd.concat([walk(2300, 4).assign(symbol="A"), walk(300, 5).assign(symbol="B")])
    pdf["open_time"] = pd.concat([pd.Series(pd.date_range("2025-01-01", periods=2300, freq="1h")), pd.Series(pd.date_range("2025-01-20", periods=300, freq="1h"))]).to_numpy()
    df = to_spark(spark, pdf)

    def plan(d):
        d = I.add_smas(I.add_emas(d, [9]), [21])
        return d.withColumns({"up": S.cross_up("close", "ema_9"), "held": S.last_all_above("close", "sma_21", 5)})

    got = column(in_chunks(df, plan, lookback, size), "close", "ema_9", "sma_21", "up", "held")
    want = column(plan(df), "close", "ema_9", "sma_21", "up", "held")
    pd.testing.assert_frame_equal(got, want, rtol=1e-12)
    with pytest.raises(ValueError):
        in_chunks(df, plan, 10, 5)
