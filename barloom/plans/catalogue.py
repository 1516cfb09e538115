"""Registered queries, each with the SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

import random
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions import indicators as I
from barloom.functions import signals as S
from barloom.functions import time_filters as D
from barloom.functions.columns import KEY, TIME, bars_window, without_nan
from barloom.operators import attribution as A
from barloom.operators import backtest, search, statistics
from barloom.operators import timeframe as R
from barloom.operators.backtest import RUN, SIGNALS, SimResult, run_backtest, with_drawdown
from barloom.operators.chunks import in_chunks
from barloom.operators.config import BacktestConfig, TakeProfit
from barloom.operators.levels import Levels
from barloom.operators.quantiles import exact_quantiles
from barloom.plans import report
from barloom.plans import strategies as Y
from barloom.sources import providers, store
from barloom.sources.ticks import event_bars, order_bars
from barloom.staging import scratch_path, stage, stage_parts
from barloom.streaming import fetch as fetches
from barloom.streaming import signals as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# ---- SQL that many queries begin with

BARS = """ticks AS (SELECT event_type AS symbol, ts, event_id, value, round(100 * exp(sum((value - 50) / 25000) OVER (PARTITION BY event_type ORDER BY ts, event_id)), 6) AS px FROM events),
bars AS (SELECT symbol, time_bucket(INTERVAL '1 hour', ts) AS open_time, arg_min(px, row(ts, event_id)) AS open, max(px) AS high, min(px) AS low, arg_max(px, row(ts, event_id)) AS close, sum(value) AS volume FROM ticks GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_time) AS rn FROM bars)"""
DAILY = "daily AS (SELECT o_orderpriority AS symbol, time_bucket(INTERVAL '1 day', o_orderdate) AS open_time, arg_min(o_totalprice, row(o_orderdate, o_orderkey)) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, row(o_orderdate, o_orderkey)) AS close, CAST(count(*) AS DOUBLE) AS volume FROM orders GROUP BY 1, 2)"
W = "PARTITION BY symbol ORDER BY open_time"
TRADES = "trades AS (SELECT o_orderpriority AS symbol, CASE WHEN o_orderkey % 2 = 0 THEN 'long' ELSE 'short' END AS side, o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS entry_time, o_orderkey AS entry_i, round(o_totalprice - 150000, 2) AS pnl, round(o_totalprice / 1000, 2) AS fees, (o_totalprice - 150000) / o_totalprice * 100 AS return_pct, o_orderkey % 50 AS bars_held, o_orderstatus AS close_reason FROM orders)"


def recursive_mean(name: str, source: str, column: str, alpha: str) -> str:
    """A CTE (symbol, rn, y): the exponential mean of a column over rows numbered from 1."""
    return f"{name}(symbol, rn, y) AS (SELECT symbol, rn, CAST({column} AS DOUBLE) FROM {source} WHERE rn = 1 UNION ALL SELECT s.symbol, s.rn, {alpha} * s.{column} + (1 - {alpha}) * e.y FROM {name} e JOIN {source} s ON s.symbol = e.symbol AND s.rn = e.rn + 1)"


def _rounded(df: DataFrame, *names: str, keep: tuple[str, ...] = (KEY, TIME), digits: int = 6) -> DataFrame:
    return df.select(*keep, *[F.round(n, digits).alias(n) for n in names])


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _bars(spark: SparkSession, sf_dir: str, rule: str = "1h") -> DataFrame:
    return without_nan(event_bars(spark, sf_dir, rule))


_OHLCV = ("open", "high", "low", "close", "volume")
_ROUND = ", ".join(f"round({c}, 6) AS {c}" for c in _OHLCV)

# ---- bars


@query("bars_1h", f"WITH {BARS} SELECT symbol, open_time, {_ROUND} FROM bars")
def bars_1h(spark, d):
    return _rounded(_bars(spark, d), *_OHLCV)


@query("bars_daily_orders", f"WITH {DAILY} SELECT symbol, open_time, {_ROUND} FROM daily")
def bars_daily_orders(spark, d):
    return _rounded(order_bars(spark, d), *_OHLCV)


@query("resample_4h", f"WITH {BARS} SELECT symbol, time_bucket(INTERVAL '4 hours', open_time) AS open_time, arg_min(open, b.open_time) AS open, max(high) AS high, min(low) AS low, arg_max(close, b.open_time) AS close, round(sum(volume), 6) AS volume FROM bars b GROUP BY 1, 2")
def resample_4h(spark, d):
    return R.resample(_bars(spark, d), "4h").withColumn("volume", F.round("volume", 6))


@query("resample_week", f"WITH {DAILY} SELECT symbol, CAST(date_trunc('week', open_time) AS TIMESTAMP) AS open_time, arg_min(open, d.open_time) AS open, max(high) AS high, min(low) AS low, arg_max(close, d.open_time) AS close, round(sum(volume), 6) AS volume FROM daily d GROUP BY 1, 2")
def resample_week(spark, d):
    return R.resample(order_bars(spark, d), "1W").withColumn("volume", F.round("volume", 6))


@query("validate_dedup", f"WITH {BARS} SELECT symbol, open_time, open, CASE WHEN hour(open_time) % 6 = 0 THEN close + 1 ELSE close END AS close FROM bars")
def validate_dedup(spark, d):
    bars = _bars(spark, d).withColumn("seq", F.lit(0))
    again = bars.where("hour(open_time) % 6 = 0").withColumn("close", F.col("close") + 1).withColumn("seq", F.lit(1))
    return store.validate_ohlcv(bars.unionByName(again), arrival="seq").select(KEY, TIME, "open", "close")


@query("gap_detect", f"WITH {BARS}, g AS (SELECT symbol, lag(open_time) OVER ({W}) AS a, open_time AS b FROM bars) SELECT symbol, a + INTERVAL '1 hour' AS gap_start, b - INTERVAL '1 hour' AS gap_end FROM g WHERE b - a > INTERVAL '90 minutes'")
def gap_detect(spark, d):
    return store.find_gaps(_bars(spark, d), "1h")


@query("range_slice", f"WITH {BARS} SELECT symbol, open_time, close FROM bars WHERE open_time BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-12 12:00:00'")
def range_slice(spark, d):
    return store.time_slice(_bars(spark, d), "2024-01-05 00:00:00", "2024-01-12 12:00:00").select(KEY, TIME, "close")


@query("catalog_stats", f"WITH {BARS} SELECT symbol, count(*) AS n_bars, min(open_time) AS first_time, max(open_time) AS last_time FROM bars GROUP BY 1")
def catalog_stats(spark, d):
    return store.catalog(_bars(spark, d))


@query("downsample_k", f"WITH {BARS} SELECT symbol, open_time, close FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS c FROM n) WHERE (rn - 1) % CAST(greatest(1, ceil(c / 100.0)) AS BIGINT) = 0")
def downsample_k(spark, d):
    return R.downsample(_bars(spark, d), 100).select(KEY, TIME, "close")


_VIEW = ("2024-01-03 00:00:00", "2024-01-23 00:00:00")


@query("viewport_candles", f"WITH {BARS}, v AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS c FROM bars WHERE open_time BETWEEN TIMESTAMP '{_VIEW[0]}' AND TIMESTAMP '{_VIEW[1]}') SELECT symbol, open_time, open, high, low, close FROM v WHERE c <= 60 UNION ALL SELECT symbol, time_bucket(INTERVAL '480 minutes', open_time) AS open_time, arg_min(open, v.open_time), max(high), min(low), arg_max(close, v.open_time) FROM v WHERE c > 60 GROUP BY 1, 2")
def viewport_candles(spark, d):
    return R.viewport(_bars(spark, d), *_VIEW, 60)


@query("viewport_levels", SQL["viewport_candles"])
def viewport_levels(spark, d):
    """The same candles from levels of one and four hours."""
    return Levels(spark, scratch_path(spark, "levels"), ("1h", "4h")).write(_bars(spark, d)).viewport(*_VIEW, 60)


@query("line_extremes", f"WITH {BARS}, g AS (SELECT symbol, time_bucket(INTERVAL '1 day', open_time) AS b, arg_min(row(open_time, close), row(close, open_time)) AS lo, arg_max(row(open_time, close), row(close, open_time)) AS hi FROM bars GROUP BY 1, 2), p AS (SELECT symbol, lo AS p FROM g UNION SELECT symbol, hi FROM g) SELECT symbol, p[1] AS open_time, p[2] AS close FROM p")
def line_extremes(spark, d):
    return R.extremes(_bars(spark, d), "1D")


_SHAPE = f"""{BARS}, g AS (SELECT symbol, time_bucket(INTERVAL '6 hours', open_time) AS b, arg_min(row(open_time, close), row(close, open_time)) AS lo, arg_max(row(open_time, close), row(close, open_time)) AS hi FROM bars GROUP BY 1, 2),
c AS (SELECT symbol, p[1] AS t, CAST(epoch_us(p[1]) AS DOUBLE) AS x, p[2] AS v FROM (SELECT symbol, lo AS p FROM g UNION SELECT symbol, hi FROM g)),
p AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS size, (count(*) OVER (PARTITION BY symbol) - 2) / 38.0::DOUBLE AS every FROM c),
r AS (SELECT *, CASE WHEN i = size - 1 THEN 38 ELSE (SELECT max(k) FROM range(0, 38) q(k) WHERE floor(k * every) + 1 <= i) END AS k FROM p WHERE i > 0 AND size > 40),
m AS (SELECT symbol, k, avg(x) AS x, avg(v) AS v FROM r GROUP BY 1, 2),
s(symbol, k, t, x, v) AS (SELECT symbol, CAST(-1 AS BIGINT), t, x, v FROM p WHERE i = 0 AND size > 40
  UNION ALL SELECT s.symbol, s.k + 1, arg_max(r.t, abs((s.x - m.x) * (r.v - s.v) - (s.x - r.x) * (m.v - s.v))), arg_max(r.x, abs((s.x - m.x) * (r.v - s.v) - (s.x - r.x) * (m.v - s.v))), arg_max(r.v, abs((s.x - m.x) * (r.v - s.v) - (s.x - r.x) * (m.v - s.v)))
  FROM s JOIN r ON r.symbol = s.symbol AND r.k = s.k + 1 JOIN m ON m.symbol = s.symbol AND m.k = s.k + 2 WHERE s.k < 37 GROUP BY 1, 2)"""


@query("line_shape", f"WITH RECURSIVE {_SHAPE} SELECT symbol, t AS open_time, v AS close FROM s UNION ALL SELECT symbol, t, v FROM p WHERE size <= 40 OR i = size - 1")
def line_shape(spark, d):
    """Forty bars of each symbol that keep the shape of its closes."""
    return R.shape(_bars(spark, d), "6h", 40)


@query("incremental_merge", f"WITH {BARS} SELECT symbol, open_time, CASE WHEN open_time >= TIMESTAMP '2024-01-15 00:00:00' THEN close * 2 ELSE close END AS close FROM bars")
def incremental_merge(spark, d):
    bars = _bars(spark, d)
    head = store.time_slice(bars, None, "2024-01-20 00:00:00")
    tail = store.time_slice(bars, "2024-01-15 00:00:00").withColumn("close", F.col("close") * 2)
    return store.merge_bars(head, tail).select(KEY, TIME, "close")


@query("store_load", f"WITH {BARS} SELECT upper(symbol) AS symbol, open_time, close FROM bars WHERE open_time BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-02-12 12:00:00'")
def store_load(spark, d):
    """All series put into a new store, their heads twice, and a span of each loaded."""
    bars = _bars(spark, d)
    kept = store.BarStore(spark, scratch_path(spark, "store"))
    kept.write(store.time_slice(bars, None, "2024-01-20 00:00:00").withColumn("close", F.col("close") + 1), "1h")
    kept.write(bars, "1h")
    return reduce(DataFrame.unionByName, [kept.load(r[KEY], "1h", "2024-01-05 00:00:00", "2024-02-12 12:00:00", []) for r in kept.catalog().collect()]).select(KEY, TIME, "close")


@query("store_catalog", f"WITH {BARS} SELECT upper(symbol) AS symbol, count(*) AS n_bars, min(open_time) AS first_time, max(open_time) AS last_time FROM bars GROUP BY 1")
def store_catalog(spark, d):
    """What the log of a store's commits says of it, after two overlapping commits."""
    bars = _bars(spark, d)
    kept = store.BarStore(spark, scratch_path(spark, "store"))
    kept.write(store.time_slice(bars, "2024-01-10 00:00:00"), "1h")
    kept.write(store.time_slice(bars, None, "2024-01-20 00:00:00"), "1h")
    return kept.catalog().select(KEY, "n_bars", "first_time", "last_time")


_KNOWN = ("2024-01-10 00:00:00", "2024-01-20 00:00:00")


@query("fetch_klines", f"WITH {BARS} SELECT upper(symbol) AS symbol, open_time, close, open_time NOT BETWEEN TIMESTAMP '{_KNOWN[0]}' AND TIMESTAMP '{_KNOWN[1]}' AS fetched FROM bars WHERE open_time BETWEEN TIMESTAMP '2024-01-03 00:00:00' AND TIMESTAMP '2024-02-20 00:00:00'")
def fetch_klines(spark, d):
    """Spans of all series of which a store has the middle: only what is missing is fetched, and all is kept."""
    bars = stage(_bars(spark, d), "bars")
    kept = store.BarStore(spark, scratch_path(spark, "store"))
    kept.write(store.time_slice(bars, *_KNOWN).withColumn("fetched", F.lit(False)), "1h", "table")
    provider = providers.TableProvider(bars.withColumn("fetched", F.lit(True)))
    series = [providers.get_ohlcv(kept, r[KEY], "1h", "2024-01-03 00:00:00", "2024-02-20 00:00:00", provider) for r in bars.select(KEY).distinct().collect()]
    return reduce(DataFrame.unionByName, [s.select(KEY, TIME, "close", "fetched") for s in series])


@query("parse_klines", f"WITH {BARS} SELECT symbol, open_time, open, high, low, close, round(volume, 6) AS volume, CAST(7 AS BIGINT) AS num_trades FROM bars")
def parse_klines(spark, d):
    text = lambda c: F.col(c).cast("string")
    row = F.array(F.unix_millis(F.col(TIME).cast("timestamp")).cast("string"), *[text(c) for c in _OHLCV], *[F.lit("0")] * 2, F.lit("7"), *[F.lit("0")] * 3)
    pages = _bars(spark, d).groupBy(F.col(KEY).alias("s"), F.trunc(TIME, "month")).agg(F.to_json(F.collect_list(row)).alias("page"))
    return providers.parse_klines(pages, "page", F.col("s")).select(KEY, TIME, *_OHLCV[:4], F.round("volume", 6).alias("volume"), "num_trades")


@query("normalise_bars", f"WITH {BARS} SELECT upper(symbol) AS symbol, open_time, open, high, low, close, 0.0::DOUBLE AS volume FROM bars")
def normalise_bars(spark, d):
    raw = _bars(spark, d).select(F.col(KEY).alias("Instrument"), F.col(TIME).cast("string").alias("Timestamp"), *[F.col(c).alias(c.title()) for c in _OHLCV[:4]])
    return providers.normalise(raw, F.col("instrument"))


# ---- indicators


def _roll(f: str, column: str, p: int, source: str = "n") -> str:
    frame = f"OVER ({W} ROWS BETWEEN {p - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({column}) {frame} = {p} THEN {f}({column}) {frame} END"


@query("sma_20", f"WITH {BARS} SELECT symbol, open_time, round({_roll('avg', 'close', 20)}, 9) AS sma_20 FROM n")
def sma_20(spark, d):
    return _rounded(I.add_smas(_bars(spark, d), [20]), "sma_20", digits=9)


@query("sma_200", f"WITH {BARS} SELECT symbol, open_time, round({_roll('avg', 'close', 200)}, 6) AS sma_200, round({_roll('avg', 'close', 50)}, 6) AS sma_50 FROM n")
def sma_200(spark, d):
    """Means over frames that are cut into blocks."""
    return _rounded(I.add_smas(_bars(spark, d), [200, 50]), "sma_200", "sma_50")


@query("price_quantiles", "SELECT unnest([0.0, 0.05, 1.0 / 3, 0.5, 0.999, 1.0]) AS share, round(unnest(quantile_cont(l_extendedprice, [0.0, 0.05, 1.0 / 3, 0.5, 0.999, 1.0])), 6) AS price FROM lineitem")
def price_quantiles(spark, d):
    """Exact quantiles of a column of any length."""
    shares = [0.0, 0.05, 1 / 3, 0.5, 0.999, 1.0]
    found, _ = exact_quantiles(spark.read.parquet(f"{d}/lineitem.parquet"), F.col("l_extendedprice"), shares)
    return spark.createDataFrame(list(zip(shares, found, strict=True)), "share double, price double").withColumn("price", F.round("price", 6))


def _ema_sql(periods: list[int]) -> str:
    means = ", ".join(recursive_mean(f"e{p}", "n", "close", f"(2.0 / {p + 1})") for p in periods)
    joins = " ".join(f"JOIN e{p} USING (symbol, rn)" for p in periods)
    return f"WITH RECURSIVE {BARS}, {means} SELECT symbol, open_time, " + ", ".join(f"CASE WHEN rn >= {p} THEN round(e{p}.y, 6) END AS ema_{p}" for p in periods) + f" FROM n {joins}"


@query("ema_20", _ema_sql([20]))
def ema_20(spark, d):
    return _rounded(I.add_emas(_bars(spark, d), [20]), "ema_20")


@query("ema_multi", _ema_sql([5, 50]))
def ema_multi(spark, d):
    return _rounded(I.add_emas(_bars(spark, d), [5, 50]), "ema_5", "ema_50")


@query("ema_adjusted", f"WITH {BARS} SELECT a.symbol, a.open_time, CASE WHEN a.rn >= 10 THEN round(sum(b.close * pow(9.0 / 11, a.rn - b.rn)) / sum(pow(9.0 / 11, a.rn - b.rn)), 6) END AS ema_10 FROM n a JOIN n b ON a.symbol = b.symbol AND b.rn <= a.rn GROUP BY a.symbol, a.open_time, a.rn")
def ema_adjusted(spark, d):
    return _rounded(I.add_emas(_bars(spark, d), [10], adjust=True), "ema_10")


_MOVES = f"m AS (SELECT symbol, open_time, rn - 1 AS rn, greatest(close - lag(close) OVER ({W}), 0.0) AS up, greatest(lag(close) OVER ({W}) - close, 0.0) AS down FROM n), m1 AS (SELECT * FROM m WHERE rn > 0)"


@query("rsi_14", f"WITH RECURSIVE {BARS}, {_MOVES}, {recursive_mean('g', 'm1', 'up', '(1.0 / 14)')}, {recursive_mean('l', 'm1', 'down', '(1.0 / 14)')} SELECT m.symbol, m.open_time, CASE WHEN m.rn >= 14 THEN round(CASE WHEN l.y > 0 THEN 100 - 100 / (1 + g.y / l.y) WHEN g.y > 0 THEN 100.0 END, 6) END AS rsi_14 FROM m LEFT JOIN g ON g.symbol = m.symbol AND g.rn = m.rn LEFT JOIN l ON l.symbol = m.symbol AND l.rn = m.rn")
def rsi_14(spark, d):
    return _rounded(I.add_rsi(_bars(spark, d), 14), "rsi_14")


@query("macd", f"WITH RECURSIVE {BARS}, {recursive_mean('f', 'n', 'close', '(2.0 / 13)')}, {recursive_mean('s', 'n', 'close', '(2.0 / 27)')}, x AS (SELECT n.symbol, n.open_time, n.rn - 25 AS rn, f.y - s.y AS macd FROM n JOIN f USING (symbol, rn) JOIN s USING (symbol, rn) WHERE n.rn >= 26), {recursive_mean('g', 'x', 'macd', '(2.0 / 10)')} SELECT n.symbol, n.open_time, round(x.macd, 6) AS macd, CASE WHEN x.rn >= 9 THEN round(g.y, 6) END AS macd_signal, CASE WHEN x.rn >= 9 THEN round(x.macd - g.y, 6) END AS macd_hist FROM n LEFT JOIN x ON x.symbol = n.symbol AND x.open_time = n.open_time LEFT JOIN g ON g.symbol = x.symbol AND g.rn = x.rn")
def macd(spark, d):
    return _rounded(I.add_macd(_bars(spark, d)), "macd", "macd_signal", "macd_hist")


@query("stochastic", f"WITH {BARS}, r AS (SELECT *, 100 * (close - {_roll('min', 'low', 14)}) / nullif({_roll('max', 'high', 14)} - {_roll('min', 'low', 14)}, 0) AS raw FROM n), k AS (SELECT *, {_roll('avg', 'raw', 3)} AS k FROM r) SELECT symbol, open_time, round(k, 6) AS stoch_k, round({_roll('avg', 'k', 3)}, 6) AS stoch_d FROM k")
def stochastic(spark, d):
    return _rounded(I.add_stochastic(_bars(spark, d)), "stoch_k", "stoch_d")


_TR = f"tr AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER ({W})), abs(low - lag(close) OVER ({W}))) AS tr FROM n)"


@query("atr_14", f"WITH RECURSIVE {BARS}, {_TR}, {recursive_mean('a', 'tr', 'tr', '(1.0 / 14)')} SELECT symbol, open_time, CASE WHEN rn >= 14 THEN round(a.y, 6) END AS atr_14 FROM n JOIN a USING (symbol, rn)")
def atr_14(spark, d):
    return _rounded(I.add_atr(_bars(spark, d), 14), "atr_14")


_BANDS = f"{_TR}, {recursive_mean('a', 'tr', 'tr', '(1.0 / 10)')}, b AS (SELECT n.*, CASE WHEN rn >= 10 THEN (high + low) / 2 + 3 * a.y ELSE 'inf'::DOUBLE END AS up, CASE WHEN rn >= 10 THEN (high + low) / 2 - 3 * a.y ELSE '-inf'::DOUBLE END AS dn FROM n JOIN a USING (symbol, rn)), st(symbol, rn, close, fu, fl, dir) AS (SELECT symbol, rn, close, up, dn, -1 FROM b WHERE rn = 1 UNION ALL SELECT b.symbol, b.rn, b.close, CASE WHEN s.close <= s.fu AND b.up >= s.fu THEN s.fu ELSE b.up END, CASE WHEN s.close >= s.fl AND b.dn <= s.fl THEN s.fl ELSE b.dn END, CASE WHEN s.dir = -1 AND b.close > s.fu THEN 1 WHEN s.dir = 1 AND b.close < s.fl THEN -1 ELSE s.dir END FROM st s JOIN b ON b.symbol = s.symbol AND b.rn = s.rn + 1)"


@query("supertrend", f"WITH RECURSIVE {BARS}, {_BANDS} SELECT n.symbol, n.open_time, CASE WHEN isinf(CASE WHEN dir = 1 THEN fl ELSE fu END) THEN NULL ELSE round(CASE WHEN dir = 1 THEN fl ELSE fu END, 6) END AS st, CAST(dir AS BIGINT) AS st_dir, dir = 1 AS st_up FROM st JOIN n USING (symbol, rn)")
def supertrend(spark, d):
    out = I.add_supertrend(_bars(spark, d))
    return out.select(KEY, TIME, F.when(F.abs("st") != float("inf"), F.round("st", 6)).alias("st"), F.col("st_dir").cast("long").alias("st_dir"), "st_up")


@query("heikin_ashi", f"WITH RECURSIVE {BARS}, c AS (SELECT *, (open + high + low + close) / 4 AS hc FROM n), h(symbol, rn, o, hc) AS (SELECT symbol, rn, (open + close) / 2, hc FROM c WHERE rn = 1 UNION ALL SELECT c.symbol, c.rn, (h.o + h.hc) / 2, c.hc FROM h JOIN c ON c.symbol = h.symbol AND c.rn = h.rn + 1) SELECT n.symbol, n.open_time, round(o, 9) AS ha_open, round(greatest(high, o, hc), 9) AS ha_high, round(least(low, o, hc), 9) AS ha_low, round(hc, 9) AS ha_close, round(hc - o, 6) > 0 AS ha_green FROM h JOIN n USING (symbol, rn)")
def heikin_ashi(spark, d):
    out = I.add_heikin_ashi(_bars(spark, d))
    return out.select(KEY, TIME, *[F.round(f"ha_{c}", 9).alias(f"ha_{c}") for c in ("open", "high", "low", "close")], (F.round(F.col("ha_close") - F.col("ha_open"), 6) > 0).alias("ha_green"))


_PIVOT = f"p AS (SELECT *, CASE WHEN count(*) OVER f = 11 AND high = max(high) OVER f THEN high END AS ph, CASE WHEN count(*) OVER f = 11 AND low = min(low) OVER f THEN low END AS pl FROM n WINDOW f AS ({W} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)), q AS (SELECT *, lag(ph, 5) OVER ({W}) AS h, lag(pl, 5) OVER ({W}) AS l FROM p), sw AS (SELECT *, h IS NOT NULL AS swing_high, l IS NOT NULL AS swing_low, last_value(h IGNORE NULLS) OVER ({W}) AS swing_last_high, last_value(l IGNORE NULLS) OVER ({W}) AS swing_last_low FROM q)"


@query("swings", f"WITH {BARS}, {_PIVOT} SELECT symbol, open_time, swing_high, swing_low, swing_last_high, swing_last_low FROM sw")
def swings(spark, d):
    return I.add_swings(_bars(spark, d), 5, 5).select(KEY, TIME, "swing_high", "swing_low", "swing_last_high", "swing_last_low")


_WIDE = _PIVOT.replace("= 11 ", "= 41 ").replace("5 PRECEDING AND 5 FOLLOWING", "20 PRECEDING AND 20 FOLLOWING").replace("(ph, 5)", "(ph, 20)").replace("(pl, 5)", "(pl, 20)")


@query("swings_wide", f"WITH {BARS}, {_WIDE} SELECT symbol, open_time, swing_high, swing_low, swing_last_high, swing_last_low FROM sw")
def swings_wide(spark, d):
    """Pivots over frames that are cut into blocks."""
    return I.add_swings(_bars(spark, d), 20, 20).select(KEY, TIME, "swing_high", "swing_low", "swing_last_high", "swing_last_low")


@query("pivot_points", f"WITH {BARS}, dd AS (SELECT symbol, time_bucket(INTERVAL '1 day', open_time) AS b, max(high) AS h, min(low) AS l, arg_max(close, open_time) AS c FROM bars GROUP BY 1, 2), lv AS (SELECT symbol, b, lag(h) OVER w AS h, lag(l) OVER w AS l, lag(c) OVER w AS c FROM dd WINDOW w AS (PARTITION BY symbol ORDER BY b)) SELECT bars.symbol, open_time, round((h + l + c) / 3, 6) AS piv_pp, round(2 * (h + l + c) / 3 - l, 6) AS piv_r1, round(2 * (h + l + c) / 3 - h, 6) AS piv_s1, round((h + l + c) / 3 + (h - l), 6) AS piv_r2, round((h + l + c) / 3 - (h - l), 6) AS piv_s2 FROM bars JOIN lv ON lv.symbol = bars.symbol AND lv.b = time_bucket(INTERVAL '1 day', open_time)")
def pivot_points(spark, d):
    return _rounded(I.add_pivot_points(_bars(spark, d)), "piv_pp", "piv_r1", "piv_s1", "piv_r2", "piv_s2")


# ---- several timeframes

_FOUR = "q AS (SELECT symbol, time_bucket(INTERVAL '4 hours', open_time) AS b, arg_max(close, open_time) AS c FROM bars GROUP BY 1, 2), h AS (SELECT symbol, b, row_number() OVER (PARTITION BY symbol ORDER BY b) AS rn, c FROM q)"


@query("align_htf_ema", f"WITH RECURSIVE {BARS}, {_FOUR}, {recursive_mean('e', 'h', 'c', '(2.0 / 6)')}, f AS (SELECT h.symbol, h.b, lag(CASE WHEN rn >= 5 THEN e.y END) OVER (PARTITION BY h.symbol ORDER BY h.b) AS v FROM h JOIN e USING (symbol, rn)) SELECT bars.symbol, open_time, round(v, 6) AS \"4h__ema_5\" FROM bars ASOF LEFT JOIN f ON bars.symbol = f.symbol AND bars.open_time >= f.b")
def align_htf_ema(spark, d):
    bars = _bars(spark, d)
    out = R.align_timeframes(bars, {"4h": I.add_emas(R.resample(bars, "4h"), [5])})
    return out.select(KEY, TIME, F.round("4h__ema_5", 6).alias("4h__ema_5"))


@query("asof_general", f"WITH {BARS}, t AS (SELECT symbol, ts, px, lag(event_id) OVER w AS before FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts, event_id) QUALIFY lead(ts) OVER w IS DISTINCT FROM ts) SELECT bars.symbol, open_time, px, CAST(before AS DOUBLE) AS before FROM bars ASOF LEFT JOIN t ON bars.symbol = t.symbol AND bars.open_time >= t.ts")
def asof_general(spark, d):
    """The last tick at or before each bar's start; of ticks at one time, the last by event_id."""
    from barloom.sources.ticks import event_ticks

    w = Window.partitionBy(KEY).orderBy(TIME, "event_id")
    ticks = event_ticks(spark, d).select(KEY, F.col("ts").alias(TIME), F.col("price").alias("px"), "event_id").withColumns({"before": F.lag("event_id").over(w).cast("double"), "next": F.lead(TIME).over(w)})
    return R.asof_join(_bars(spark, d).select(KEY, TIME), ticks.where(f"not next <=> {TIME}"), ["px", "before"], block="month")


@query("build_mtf_two", f"WITH {BARS}, {_FOUR}, f0 AS (SELECT symbol, b, CASE WHEN rn >= 3 THEN avg(c) OVER (PARTITION BY symbol ORDER BY b ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) END AS v FROM h), f AS (SELECT symbol, b, lag(v) OVER (PARTITION BY symbol ORDER BY b) AS v FROM f0), dd AS (SELECT symbol, time_bucket(INTERVAL '1 day', open_time) AS b, arg_max(close, open_time) AS c FROM bars GROUP BY 1, 2), g0 AS (SELECT symbol, b, CASE WHEN row_number() OVER w >= 2 THEN avg(c) OVER (PARTITION BY symbol ORDER BY b ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) END AS v FROM dd WINDOW w AS (PARTITION BY symbol ORDER BY b)), g AS (SELECT symbol, b, lag(v) OVER (PARTITION BY symbol ORDER BY b) AS v FROM g0) SELECT bars.symbol, open_time, round(f.v, 9) AS \"4h__sma_3\", round(g.v, 9) AS \"1D__sma_2\" FROM bars LEFT JOIN f ON f.symbol = bars.symbol AND f.b = time_bucket(INTERVAL '4 hours', open_time) LEFT JOIN g ON g.symbol = bars.symbol AND g.b = time_bucket(INTERVAL '1 day', open_time)")
def build_mtf_two(spark, d):
    out = R.build_mtf(_bars(spark, d), {"4h": lambda x: I.add_smas(x, [3]), "1D": lambda x: I.add_smas(x, [2])})
    return _rounded(out, "4h__sma_3", "1D__sma_2", digits=9)


# ---- signals and time filters: one query each

_SIG = f"f0 AS (SELECT *, round({_roll('avg', 'close', 5)}, 9) AS sma_5, round({_roll('avg', 'close', 20)}, 9) AS sma_20 FROM n), f AS (SELECT *, coalesce(lag(close - sma_20) OVER ({W}) <= 0 AND close - sma_20 > 0, false) AS up, coalesce(lag(close - sma_20) OVER ({W}) >= 0 AND close - sma_20 < 0, false) AS down, coalesce(close > sma_20, false) AS a, coalesce(close < sma_20, false) AS b, close > open AS g, close < open AS r, coalesce(close - lag(close) OVER ({W}) > 0, false) AS inc, coalesce(close - lag(close) OVER ({W}) < 0, false) AS dec FROM f0)"


def _rows(flag: str, n: int, last: int = 0) -> str:
    end = "CURRENT ROW" if not last else f"{last} PRECEDING"
    return f"coalesce(sum(CAST({flag} AS INTEGER)) OVER ({W} ROWS BETWEEN {n - 1 + last} PRECEDING AND {end}) = {n}, false)"


def _signal_frame(spark: SparkSession, d: str, rule: str = "1h") -> DataFrame:
    bars = I.add_smas(_bars(spark, d, rule), [5, 20])
    return bars.withColumns({c: F.round(c, 9) for c in ("sma_5", "sma_20")})


def _signal(name: str, make: Callable[[], Column], sql: str) -> None:
    QUERIES[name] = lambda spark, d: _signal_frame(spark, d).select(KEY, TIME, make().alias("signal"))
    SQL[name] = f"WITH {BARS}, {_SIG} SELECT symbol, open_time, {sql} AS signal FROM f"


for _name, _make, _text in (
    ("sig_above", lambda: S.above("close", "sma_20"), "a"),
    ("sig_below", lambda: S.below("close", "sma_20"), "b"),
    ("sig_operand", lambda: S.above("close", F.col("open") + 0.001) & S.below("low", 105), "close > open + 0.001 AND low < 105"),
    ("sig_above_all", lambda: S.above_all("close", ["sma_5", "sma_20"]), "coalesce(close > sma_5, false) AND a"),
    ("sig_below_all", lambda: S.below_all("close", ["sma_5", "sma_20"]), "coalesce(close < sma_5, false) AND b"),
    ("sig_cross_up", lambda: S.cross_up("close", "sma_20"), "up"),
    ("sig_cross_down", lambda: S.cross_down("close", "sma_20"), "down"),
    ("sig_crossed_up_within", lambda: S.crossed_up_within("close", "sma_20", 4), f"coalesce(max(CAST(up AS INTEGER)) OVER ({W} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) = 1, false)"),
    ("sig_last_all_above", lambda: S.last_all_above("close", "sma_20", 3), _rows("a", 3)),
    ("sig_last_all_below", lambda: S.last_all_below("close", "sma_20", 3), _rows("b", 3)),
    ("sig_prev_all_above", lambda: S.prev_all_above("close", "sma_20", 2), _rows("a", 2, 1)),
    ("sig_prev_all_below", lambda: S.prev_all_below("close", "sma_20", 2), _rows("b", 2, 1)),
    ("sig_is_green", lambda: S.is_green(), "g"),
    ("sig_is_red", lambda: S.is_red(), "r"),
    ("sig_consecutive_green", lambda: S.consecutive_green(3), _rows("g", 3)),
    ("sig_consecutive_red", lambda: S.consecutive_red(3), _rows("r", 3)),
    ("sig_rising", lambda: S.rising("close", 2), _rows("inc", 2)),
    ("sig_falling", lambda: S.falling("close", 2), _rows("dec", 2)),
    ("sig_refs_ordered", lambda: S.refs_ordered(["close", "sma_5", "sma_20"]), "coalesce(close >= sma_5, false) AND coalesce(sma_5 >= sma_20, false)"),
    ("sig_refs_ordered_up", lambda: S.refs_ordered(["close", "sma_5", "sma_20"], descending=False), "coalesce(close <= sma_5, false) AND coalesce(sma_5 <= sma_20, false)"),
    ("sig_all_of", lambda: S.all_of(S.above("close", "sma_20"), S.is_green()), "a AND g"),
    ("sig_any_of", lambda: S.any_of(S.above("close", "sma_20"), S.is_green()), "a OR g"),
    ("sig_none_of", lambda: S.none_of(S.above("close", "sma_20"), S.is_green()), "NOT (a OR g)"),
    ("tf_hour_between", lambda: D.hour_between(22, 4), "hour(open_time) >= 22 OR hour(open_time) < 4"),
    ("tf_session", lambda: D.in_session("london"), "hour(open_time) >= 7 AND hour(open_time) < 16"),
    ("tf_session_wrap", lambda: D.in_session("sydney"), "hour(open_time) >= 21 OR hour(open_time) < 6"),
    ("tf_weekday", lambda: D.weekday_in((0, 2, 4)), "isodow(open_time) - 1 IN (0, 2, 4)"),
    ("tf_not_weekend", lambda: D.not_weekend(), "isodow(open_time) <= 5"),
    ("tf_between_times", lambda: D.between_times("13:30", "20:00"), "hour(open_time) * 60 + minute(open_time) >= 810 AND hour(open_time) * 60 + minute(open_time) < 1200"),
):
    _signal(_name, _make, _text)


@query("tf_local_hour", f"WITH {BARS} SELECT symbol, open_time, hour(timezone('America/New_York', timezone('UTC', open_time))) BETWEEN 9 AND 15 AS signal FROM bars")
def tf_local_hour(spark, d):
    return _bars(spark, d).select(KEY, TIME, D.hour_between(9, 16, tz="America/New_York").alias("signal"))


@query("sig_in_chunks", f"WITH {BARS}, {_SIG} SELECT symbol, open_time, {_rows('a', 3)} AS signal FROM f")
def sig_in_chunks(spark, d):
    def plan(bars: DataFrame) -> DataFrame:
        bars = I.add_smas(bars, [5, 20]).withColumns({c: F.round(c, 9) for c in ("sma_5", "sma_20")})
        return bars.withColumn("signal", S.last_all_above("close", "sma_20", 3))

    return in_chunks(_bars(spark, d), plan, lookback=25, size=100, bucket="week").select(KEY, TIME, "signal")


@query("sig_changes", f"WITH {BARS} SELECT symbol, open_time, lag(close, 2) OVER ({W}) AS shifted, round(close - lag(close) OVER ({W}), 6) AS change FROM bars")
def sig_changes(spark, d):
    return _bars(spark, d).select(KEY, TIME, S.shifted("close", 2).alias("shifted"), F.round(S.change("close"), 6).alias("change"))


# ---- strategies: how often each signal is on


def _strategy(name: str, make: Callable[[], Y.Strategy], sql: str | None = None, bars: Query = _bars) -> None:
    def run(spark, d):
        s = make()
        return Y.signal_counts(s.signals(s.prepare(bars(spark, d))))

    QUERIES[name] = run
    if sql:
        SQL[name] = sql


def _counts(*flags: str) -> str:
    names = dict(zip(SIGNALS, flags, strict=True))
    return "symbol, count(*) AS n_bars, " + ", ".join(f"CAST(sum(CAST(coalesce({f}, false) AS INTEGER)) AS BIGINT) AS {n}" for n, f in names.items())


_RIBBON = f"{recursive_mean('e1', 'n', 'close', '(2.0 / 6)')}, {recursive_mean('e2', 'n', 'close', '(2.0 / 21)')}, x0 AS (SELECT n.*, CASE WHEN rn >= 5 THEN round(close - e1.y, 9) END AS d, CASE WHEN rn >= 20 THEN coalesce(close - e2.y > 0, false) ELSE false END AS s FROM n JOIN e1 USING (symbol, rn) JOIN e2 USING (symbol, rn)), x AS (SELECT *, lag(d) OVER ({W}) AS pd, {_rows('s', 3)} AS held FROM x0)"
_strategy("strat_ema_ribbon", lambda: Y.EmaRibbon(fast=5, slow=20, confirm_n=3), f"WITH RECURSIVE {BARS}, {_RIBBON} SELECT {_counts('pd <= 0 AND d > 0 AND held', 'pd >= 0 AND d < 0', 'false', 'false')} FROM x GROUP BY symbol")
_strategy("strat_ema_ribbon_hours", lambda: Y.EmaRibbon(fast=5, slow=20, confirm_n=3, hours=(8, 16), avoid_weekends=True), f"WITH RECURSIVE {BARS}, {_RIBBON} SELECT {_counts('pd <= 0 AND d > 0 AND held AND hour(open_time) >= 8 AND hour(open_time) < 16 AND isodow(open_time) <= 5', 'pd >= 0 AND d < 0', 'false', 'false')} FROM x GROUP BY symbol")
_strategy("strat_ema_cross", lambda: Y.EmaCross(ema_period=20), f"WITH RECURSIVE {BARS}, {recursive_mean('e', 'n', 'close', '(2.0 / 21)')}, x0 AS (SELECT n.*, CASE WHEN rn >= 20 THEN close - e.y END AS d FROM n JOIN e USING (symbol, rn)), x AS (SELECT *, lag(d) OVER ({W}) AS pd FROM x0) SELECT {_counts('pd <= 0 AND d > 0', 'd < 0', 'pd >= 0 AND d < 0', 'd > 0')} FROM x GROUP BY symbol")
_strategy("strat_ema_cross_candles", lambda: Y.EmaCross(ema_period=20, entry_mode="full_candle", confirm_n=2, confirm_color=True, exit_mode="below_ema", exit_ema=10), f"WITH RECURSIVE {BARS}, {recursive_mean('e', 'n', 'close', '(2.0 / 21)')}, {recursive_mean('x1', 'n', 'close', '(2.0 / 11)')}, x AS (SELECT n.*, rn >= 20 AND low > e.y AS lo, rn >= 20 AND high < e.y AS hi, close > open AS g, close < open AS r, rn >= 10 AND high < x1.y AS xl, rn >= 10 AND low > x1.y AS xs FROM n JOIN e USING (symbol, rn) JOIN x1 USING (symbol, rn)), z AS (SELECT *, {_rows('lo', 2)} AND {_rows('g', 2)} AS el, {_rows('hi', 2)} AND {_rows('r', 2)} AS es FROM x) SELECT {_counts('el', 'xl', 'es', 'xs')} FROM z GROUP BY symbol")
_strategy("strat_ema_cross_htf", lambda: Y.EmaCross(ema_period=20, use_heikin_ashi=True, exit_mode="ha_flip", htf="4h", htf_ema=5))
_strategy("strat_rsi_reversal", lambda: Y.RsiReversal(oversold=40, overbought=60, long_consec=2, short_consec=3, allow_short_signals=True), f"WITH RECURSIVE {BARS}, {_MOVES}, {recursive_mean('g', 'm1', 'up', '(1.0 / 14)')}, {recursive_mean('l', 'm1', 'down', '(1.0 / 14)')}, x AS (SELECT m.symbol, m.open_time, CASE WHEN m.rn >= 14 THEN CASE WHEN l.y > 0 THEN 100 - 100 / (1 + g.y / l.y) WHEN g.y > 0 THEN 100.0 END END AS v FROM m LEFT JOIN g ON g.symbol = m.symbol AND g.rn = m.rn LEFT JOIN l ON l.symbol = m.symbol AND l.rn = m.rn), z AS (SELECT *, coalesce(v < 40, false) AS a, coalesce(v > 60, false) AS b FROM x), zz AS (SELECT *, {_rows('a', 2)} AS el, {_rows('b', 3)} AS es FROM z) SELECT {_counts('el', 'v > 50', 'es', 'v < 50')} FROM zz GROUP BY symbol")
_strategy("strat_macd_trend", lambda: Y.MacdTrend(allow_short_signals=True), f"WITH RECURSIVE {BARS}, {recursive_mean('f', 'n', 'close', '(2.0 / 13)')}, {recursive_mean('s', 'n', 'close', '(2.0 / 27)')}, x AS (SELECT n.symbol, n.open_time, n.rn - 25 AS rn, f.y - s.y AS macd FROM n JOIN f USING (symbol, rn) JOIN s USING (symbol, rn) WHERE n.rn >= 26), {recursive_mean('g', 'x', 'macd', '(2.0 / 10)')}, z0 AS (SELECT n.symbol, n.open_time, x.macd, CASE WHEN x.rn >= 9 THEN x.macd - g.y END AS d FROM n LEFT JOIN x ON x.symbol = n.symbol AND x.open_time = n.open_time LEFT JOIN g ON g.symbol = x.symbol AND g.rn = x.rn), z AS (SELECT *, lag(d) OVER ({W}) AS pd FROM z0) SELECT {_counts('pd <= 0 AND d > 0 AND macd > 0', 'pd >= 0 AND d < 0', 'pd >= 0 AND d < 0 AND macd < 0', 'pd <= 0 AND d > 0')} FROM z GROUP BY symbol")
_strategy("strat_heikin_ashi", lambda: Y.HeikinAshiTrend(), f"WITH RECURSIVE {BARS}, c AS (SELECT *, (open + high + low + close) / 4 AS hc FROM n), h(symbol, rn, o, hc) AS (SELECT symbol, rn, (open + close) / 2, hc FROM c WHERE rn = 1 UNION ALL SELECT c.symbol, c.rn, (h.o + h.hc) / 2, c.hc FROM h JOIN c ON c.symbol = h.symbol AND c.rn = h.rn + 1), z AS (SELECT n.symbol, n.open_time, hc > o AS g, hc < o AS r FROM h JOIN n USING (symbol, rn)), zz AS (SELECT *, {_rows('g', 3)} AS el FROM z) SELECT {_counts('el', 'r', 'false', 'false')} FROM zz GROUP BY symbol")
_strategy("strat_supertrend", lambda: Y.SupertrendFlip(allow_short_signals=True), f"WITH RECURSIVE {BARS}, {_BANDS}, z AS (SELECT n.symbol, n.open_time, dir, lag(dir) OVER ({W}) AS pd FROM st JOIN n USING (symbol, rn)) SELECT {_counts('pd <= 0 AND dir > 0', 'pd >= 0 AND dir < 0', 'pd >= 0 AND dir < 0', 'pd <= 0 AND dir > 0')} FROM z GROUP BY symbol")
_strategy("strat_mtf_trend", lambda: Y.MtfTrend(fast_1m=5, trend_5m_fast=3, trend_5m_slow=8, mom_15m=2, rules=("4h", "1D")))
_strategy("strat_key_level", lambda: Y.KeyLevelBounce(left=5, right=5, near_pct=2.0), f"WITH {BARS}, {_PIVOT} SELECT {_counts('(close - swing_last_low) / close >= 0 AND (close - swing_last_low) / close <= 0.02 AND close > open', '(swing_last_high - close) / close >= 0 AND (swing_last_high - close) / close <= 0.02', 'false', 'false')} FROM sw GROUP BY symbol")


@query("stream_ema_ribbon", f"WITH RECURSIVE {BARS}, {_RIBBON} SELECT symbol, open_time, round(close, 6) AS close, CASE WHEN rn >= 20 THEN round(e2.y, 6) END AS ema_20, coalesce(pd <= 0 AND d > 0 AND held, false) AS entry_long, coalesce(pd >= 0 AND d < 0, false) AS exit_long FROM x JOIN e2 USING (symbol, rn)")
def stream_ema_ribbon(spark, d):
    """The ribbon's signals on a stream of bars that arrive week by week."""
    bars = stage(_bars(spark, d), "bars")
    week = F.date_trunc("week", TIME)
    weeks = sorted(r[0] for r in bars.select(week).distinct().collect())
    arrived = stage_parts((bars.where(week == F.lit(w)).repartition(KEY) for w in weeks), "weeks")
    source = spark.readStream.schema(bars.schema).option("maxFilesPerTrigger", 1).parquet(arrived._barloom_path)
    ribbon, path = Y.EmaRibbon(fast=5, slow=20, confirm_n=3), scratch_path(spark, "followed")
    streams.follow(source, lambda b: ribbon.signals(ribbon.prepare(b)), path, scratch_path(spark, "checkpoint"), 500, availableNow=True).awaitTermination()
    return streams.table(spark, path).select(KEY, TIME, F.round("close", 6).alias("close"), F.round("ema_20", 6).alias("ema_20"), "entry_long", "exit_long")


@query("stream_fetch", f"WITH {BARS} SELECT upper(symbol) AS symbol, open_time, close FROM bars WHERE open_time BETWEEN TIMESTAMP '2024-01-03 00:00:00' AND TIMESTAMP '2024-02-20 00:00:00'")
def stream_fetch(spark, d):
    """A span of all series, fetched into a store as a stream of months."""
    bars = stage(_bars(spark, d), "bars")
    kept, asked = store.BarStore(spark, scratch_path(spark, "store")), scratch_path(spark, "asked")
    names = [r[KEY] for r in bars.select(KEY).distinct().collect()]
    fetches.ask(spark, asked, names, "1h", "2024-01-03 00:00:00", "2024-02-20 00:00:00")
    fetches.fetch_asked(kept, asked, scratch_path(spark, "checkpoint"), providers.TableProvider(bars), availableNow=True).awaitTermination()
    return kept.table().select(KEY, TIME, "close")


_DAYS = "dd AS (SELECT symbol, b, c, row_number() OVER (PARTITION BY symbol ORDER BY b) AS rn FROM (SELECT symbol, time_bucket(INTERVAL '1 day', open_time) AS b, arg_max(close, open_time) AS c FROM bars GROUP BY 1, 2))"
SQL["strat_mtf_trend"] = f"WITH RECURSIVE {BARS}, {_FOUR}, {_DAYS}, {recursive_mean('e5', 'n', 'close', '(2.0 / 6)')}, {recursive_mean('e3', 'h', 'c', '(2.0 / 4)')}, {recursive_mean('e8', 'h', 'c', '(2.0 / 9)')}, {recursive_mean('e2', 'dd', 'c', '(2.0 / 3)')}, f AS (SELECT symbol, b, lag(CASE WHEN rn >= 3 THEN e3.y END) OVER o AS fast, lag(CASE WHEN rn >= 8 THEN e8.y END) OVER o AS slow FROM h JOIN e3 USING (symbol, rn) JOIN e8 USING (symbol, rn) WINDOW o AS (PARTITION BY symbol ORDER BY b)), g AS (SELECT symbol, b, lag(CASE WHEN rn >= 2 THEN e2.y END) OVER (PARTITION BY symbol ORDER BY b) AS mom FROM dd JOIN e2 USING (symbol, rn)), x0 AS (SELECT n.symbol, n.open_time, CASE WHEN n.rn >= 5 THEN n.close - e5.y END AS d, fast, slow, mom FROM n JOIN e5 USING (symbol, rn) LEFT JOIN f ON f.symbol = n.symbol AND f.b = time_bucket(INTERVAL '4 hours', n.open_time) LEFT JOIN g ON g.symbol = n.symbol AND g.b = time_bucket(INTERVAL '1 day', n.open_time)), x AS (SELECT *, lag(d) OVER ({W}) AS pd, lag(mom) OVER ({W}) AS pm FROM x0) SELECT {_counts('pd <= 0 AND d > 0 AND fast > slow AND mom > pm', 'pd >= 0 AND d < 0', 'false', 'false')} FROM x GROUP BY symbol"
SQL["strat_ema_cross_htf"] = f"WITH RECURSIVE {BARS}, {_FOUR}, {recursive_mean('e5', 'h', 'c', '(2.0 / 6)')}, v AS (SELECT symbol, b, lag(CASE WHEN rn >= 5 THEN e5.y END) OVER (PARTITION BY symbol ORDER BY b) AS bias FROM h JOIN e5 USING (symbol, rn)), c AS (SELECT *, (open + high + low + close) / 4 AS hc FROM n), ha(symbol, rn, o, hc) AS (SELECT symbol, rn, (open + close) / 2, hc FROM c WHERE rn = 1 UNION ALL SELECT c.symbol, c.rn, (ha.o + ha.hc) / 2, c.hc FROM ha JOIN c ON c.symbol = ha.symbol AND c.rn = ha.rn + 1), {recursive_mean('e20', 'c', 'hc', '(2.0 / 21)')}, x0 AS (SELECT c.symbol, c.open_time, c.hc, ha.o, CASE WHEN c.rn >= 20 THEN c.hc - e20.y END AS d, bias FROM c JOIN ha USING (symbol, rn) JOIN e20 USING (symbol, rn) LEFT JOIN v ON v.symbol = c.symbol AND v.b = time_bucket(INTERVAL '4 hours', c.open_time)), x AS (SELECT *, lag(d) OVER ({W}) AS pd FROM x0) SELECT {_counts('pd <= 0 AND d > 0 AND hc > bias', 'hc < o', 'pd >= 0 AND d < 0 AND hc < bias', 'hc > o')} FROM x GROUP BY symbol"

# ---- simulated trading


def _crossing(spark: SparkSession, d: str, rule: str = "1h") -> DataFrame:
    bars = I.add_swings(_signal_frame(spark, d, rule), 5, 5)
    return bars.withColumns({"entry_long": S.cross_up("close", "sma_20"), "exit_long": S.cross_down("close", "sma_20"), "entry_short": F.lit(False), "exit_short": F.lit(False)})


def _account(result) -> DataFrame:
    """Per symbol: trades, their total, final cash and deepest fall."""
    trades = result.trades.groupBy(RUN, KEY).agg(F.count("*").alias("n_trades"), F.sum("pnl").alias("total_pnl"))
    fall = result.equity.groupBy(RUN, KEY).agg(F.max("drawdown").alias("max_drawdown"))
    out = result.accounts.join(trades, [RUN, KEY], "left").join(fall, [RUN, KEY], "left")
    return out.select(KEY, F.coalesce("n_trades", F.lit(0)).alias("n_trades"), *[F.round(c, 4).alias(c) for c in ("total_pnl", "final_cash", "max_drawdown")])


_FOLD = f"""sim(symbol, rn, cash, qty, px, k, eq) AS (
SELECT symbol, CAST(0 AS BIGINT), 10000.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, CAST(0 AS BIGINT), 10000.0::DOUBLE FROM f WHERE rn = 1
UNION ALL SELECT symbol, rn, CASE WHEN go THEN cash - 10000 * 0.001 ELSE cash END, CASE WHEN go THEN 10000 / close ELSE qty END, CASE WHEN go THEN close ELSE px END, CASE WHEN go THEN k + 1 ELSE k END, eq
FROM (SELECT symbol, rn, close, px, k, eq, cash, qty, up AND qty = 0 AND cash > 0 AND 10 <= cash AS go
FROM (SELECT f.symbol, f.rn, f.close, f.up, s.px, s.k, s.cash + (f.close - s.px) * s.qty AS eq, CASE WHEN s.qty > 0 AND f.down THEN s.cash + (f.close - s.px) * s.qty - f.close * s.qty * 0.001 ELSE s.cash END AS cash, CASE WHEN s.qty > 0 AND f.down THEN 0 ELSE s.qty END AS qty FROM sim s JOIN f ON f.symbol = s.symbol AND f.rn = s.rn + 1))),
done AS (SELECT s.symbol, s.k, s.cash + CASE WHEN s.qty > 0 THEN (f.close - s.px) * s.qty - f.close * s.qty * 0.001 ELSE 0 END AS cash FROM sim s JOIN f USING (symbol, rn) WHERE rn = (SELECT max(rn) FROM f g WHERE g.symbol = s.symbol)),
dd AS (SELECT symbol, max(CASE WHEN peak > 0 THEN (peak - eq) / peak ELSE 0 END) AS fall FROM (SELECT symbol, eq, max(eq) OVER (PARTITION BY symbol ORDER BY rn) AS peak FROM sim WHERE rn > 0) GROUP BY symbol)"""


@query("bt_signal_only", f"WITH RECURSIVE {BARS}, {_SIG}, {_FOLD} SELECT symbol, k AS n_trades, round(cash - 10000, 4) AS total_pnl, round(cash, 4) AS final_cash, round(fall, 4) AS max_drawdown FROM done JOIN dd USING (symbol)")
def bt_signal_only(spark, d):
    return _account(run_backtest(_crossing(spark, d), BacktestConfig(fee_bps=10)))


_MINUTES = BARS.replace("INTERVAL '1 hour'", "INTERVAL '1 minute'")


@query("bt_minute", f"WITH RECURSIVE {_MINUTES}, {_SIG}, {_FOLD} SELECT symbol, k AS n_trades, round(cash - 10000, 4) AS total_pnl, round(cash, 4) AS final_cash, round(fall, 4) AS max_drawdown FROM done JOIN dd USING (symbol)")
def bt_minute(spark, d):
    return _account(run_backtest(_crossing(spark, d, "1min"), BacktestConfig(fee_bps=10)))


def _risk_fold(frame: str, stop: str, target: str | None, trail: float | None = None) -> str:
    """One long position at a time, sized by the risk to its stop, as a recursive query over the rows of f.

    stop is an expression of the entry price e (and of columns of f), target one of e and s, the stop.
    """
    fee, slip = 0.0008, 0.00015
    best = "greatest(p.best, f.high)" if trail else "p.best"
    moved = f"greatest(p.stop, greatest(p.best, f.high) * {1 - trail / 100})" if trail else "p.stop"
    hit = "f.high >= p.target" if target else "false"
    return f"""{frame}, sim(symbol, rn, cash, qty, px, stop, target, best, k, eq) AS (
SELECT symbol, CAST(0 AS BIGINT), 10000.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, CAST(0 AS BIGINT), 10000.0::DOUBLE FROM f WHERE rn = 1
UNION ALL SELECT symbol, rn, CASE WHEN go THEN cash - e * size * {fee} ELSE cash END, CASE WHEN go THEN size ELSE qty END, CASE WHEN go THEN e ELSE px END, CASE WHEN go THEN s ELSE stop END, CASE WHEN go THEN {target or '0'} ELSE target END, CASE WHEN go THEN e ELSE best END, CASE WHEN go THEN k + 1 ELSE k END, eq
FROM (SELECT *, up AND qty = 0 AND cash > 0 AND size > 0 AND e * size * {fee} <= cash AS go
FROM (SELECT *, least(eq * 0.01 / abs(e - s), least(eq, cash) / e) AS size
FROM (SELECT *, {stop} AS s
FROM (SELECT symbol, rn, ref, up, eq, px, stop, target, best, k, close * {1 + slip} AS e, CASE WHEN left_at IS NULL THEN cash ELSE cash + (left_at * {1 - slip} - px) * qty - left_at * {1 - slip} * qty * {fee} END AS cash, CASE WHEN left_at IS NULL THEN qty ELSE 0 END AS qty
FROM (SELECT f.symbol, f.rn, f.close, f.ref, f.up, p.cash, p.qty, p.px, {moved} AS stop, p.target, {best} AS best, p.k, p.cash + (f.close - p.px) * p.qty AS eq,
CASE WHEN p.qty = 0 THEN NULL WHEN f.low <= {moved} THEN {moved} WHEN {hit} THEN p.target WHEN f.down THEN f.close END AS left_at FROM sim p JOIN f ON f.symbol = p.symbol AND f.rn = p.rn + 1)))))),
done AS (SELECT s.symbol, s.k, s.cash + CASE WHEN s.qty > 0 THEN (f.close * {1 - slip} - s.px) * s.qty - f.close * {1 - slip} * s.qty * {fee} ELSE 0 END AS cash FROM sim s JOIN f USING (symbol, rn) WHERE rn = (SELECT max(rn) FROM f g WHERE g.symbol = s.symbol)),
dd AS (SELECT symbol, max(CASE WHEN peak > 0 THEN (peak - eq) / peak ELSE 0 END) AS fall FROM (SELECT symbol, eq, max(eq) OVER (PARTITION BY symbol ORDER BY rn) AS peak FROM sim WHERE rn > 0) GROUP BY symbol)
SELECT symbol, k AS n_trades, CASE WHEN k > 0 THEN round(cash - 10000, 4) END AS total_pnl, round(cash, 4) AS final_cash, round(fall, 4) AS max_drawdown FROM done JOIN dd USING (symbol)"""


_PLAIN = _SIG.replace("f AS (SELECT *,", "f AS (SELECT *, 0.0 AS ref,")
_SWUNG = _SIG.replace("f AS (SELECT *,", "ff AS (SELECT *,") + f", {_PIVOT}, f AS (SELECT ff.*, sw.swing_last_low AS ref FROM ff JOIN sw USING (symbol, rn))"
_REF = "CASE WHEN ref > 0 AND ref * (1 - 0.0005) < e THEN ref * (1 - 0.0005) ELSE e * (1 - 0.008) END"
SQL["bt_sl_tp"] = f"WITH RECURSIVE {BARS}, " + _risk_fold(_PLAIN, "e * (1 - 0.006)", "e + (e - s) * 2")
SQL["bt_trailing"] = f"WITH RECURSIVE {BARS}, " + _risk_fold(_PLAIN, "e * (1 - 0.006)", None, 0.8)
SQL["bt_ref_stop"] = f"WITH RECURSIVE {BARS}, " + _risk_fold(_SWUNG, _REF, "e + (e - s) * 2")

_PF = "CASE WHEN coalesce(-sum(pnl) FILTER (pnl < 0), 0) > 0 THEN coalesce(sum(pnl) FILTER (pnl > 0), 0) / -sum(pnl) FILTER (pnl < 0) WHEN coalesce(sum(pnl) FILTER (pnl > 0), 0) > 0 THEN 'inf'::DOUBLE ELSE 0 END"
_BY_RISK = "least(eq * 0.01 / abs(e - s), least(eq, cash) / e)"


def _trading(stop: str = "NULL", target: str = "NULL", size: str = "10000 / e", fee: float = 0.0, slip: float = 0.0, half: float = 0.0, commission: float = 0.0, margin: tuple[float, float] | None = None, extra: tuple[str, ...] = ()) -> str:
    """CTEs sim (an account a symbol of f, one long position at a time), trades and told (statistics a symbol).

    stop and target are expressions of the entry price e, the stop s and the columns extra of f; size also of
    eq, the equity, and cash. commission is a unit of quantity; margin is leverage and stop-out level.
    """
    cost = lambda price, qty: f"({price} * {qty} * {fee} + {qty} * {commission})"
    more = "".join(f", {c}" for c in extra)
    out = f"p.cash + (f.close - p.px) * p.qty <= {margin[1] / 100} * p.px * p.qty / {margin[0]}" if margin else "false"
    bound = f" AND e * size / {margin[0]} <= cash" if margin else ""
    double = "0.0::DOUBLE"
    return f"""sim(symbol, rn, cash, qty, px, stop, target, k, eq, ex, why) AS (
SELECT symbol, CAST(0 AS BIGINT), 10000.0::DOUBLE, {double}, {double}, {double}, {double}, CAST(0 AS BIGINT), 10000.0::DOUBLE, NULL::DOUBLE, NULL::VARCHAR FROM f WHERE rn = 1
UNION ALL SELECT symbol, rn, CASE WHEN go THEN cash - {cost('e', 'size')} ELSE cash END, CASE WHEN go THEN size ELSE qty END, CASE WHEN go THEN e ELSE px END, CASE WHEN go THEN s ELSE stop END, CASE WHEN go THEN {target} ELSE target END, CASE WHEN go THEN k + 1 ELSE k END, eq, ex, why
FROM (SELECT *, up AND qty = 0 AND cash > 0 AND size > 0 AND {cost('e', 'size')} <= cash AND coalesce(why, '') <> 'margin_call'{bound} AS go
FROM (SELECT *, {size} AS size FROM (SELECT *, {stop} AS s
FROM (SELECT symbol, rn, close, up, eq, px, stop, target, k, why, x AS ex{more}, close * {1 + slip} + {half} AS e, CASE WHEN x IS NULL THEN cash ELSE cash + (x - px) * qty - {cost('x', 'qty')} END AS cash, CASE WHEN x IS NULL THEN qty ELSE 0 END AS qty
FROM (SELECT *, CASE why WHEN 'stop_loss' THEN stop WHEN 'take_profit' THEN target WHEN 'signal' THEN close WHEN 'margin_call' THEN close END * {1 - slip} - {half} AS x
FROM (SELECT f.symbol, f.rn, f.close, f.up{"".join(f", f.{c}" for c in extra)}, p.cash, p.qty, p.px, p.stop, p.target, p.k, p.cash + (f.close - p.px) * p.qty AS eq,
CASE WHEN p.qty = 0 THEN NULL WHEN {out} THEN 'margin_call' WHEN f.low <= p.stop THEN 'stop_loss' WHEN f.high >= p.target THEN 'take_profit' WHEN f.down THEN 'signal' END AS why FROM sim p JOIN f ON f.symbol = p.symbol AND f.rn = p.rn + 1))))))),
steps AS (SELECT *, lag(k) OVER (PARTITION BY symbol ORDER BY rn) AS k0, lag(eq) OVER (PARTITION BY symbol ORDER BY rn) AS eq0, max(eq) OVER (PARTITION BY symbol ORDER BY rn ROWS UNBOUNDED PRECEDING) AS peak FROM sim),
ends AS (SELECT symbol, max(rn) AS rn, arg_max(close, rn) AS close FROM f GROUP BY symbol),
trades AS (SELECT w.symbol, 'long' AS side, w.rn - 1 AS entry_i, coalesce(c.rn, l.rn) - 1 AS exit_i, i.open_time AS entry_time, o.open_time AS exit_time, w.px AS entry_price, coalesce(c.ex, l.close * {1 - slip} - {half}) AS exit_price, w.stop AS stop_price, w.qty,
(coalesce(c.ex, l.close * {1 - slip} - {half}) - w.px) * w.qty AS gross_pnl, {cost('w.px', 'w.qty')} + {cost(f'coalesce(c.ex, l.close * {1 - slip} - {half})', 'w.qty')} AS fees, coalesce(c.why, 'forced_close_end') AS close_reason
FROM steps w JOIN ends l ON l.symbol = w.symbol LEFT JOIN steps c ON c.symbol = w.symbol AND c.k0 = w.k AND c.ex IS NOT NULL JOIN f i ON i.symbol = w.symbol AND i.rn = w.rn JOIN f o ON o.symbol = w.symbol AND o.rn = coalesce(c.rn, l.rn) WHERE w.k > w.k0),
won AS (SELECT *, gross_pnl - fees AS pnl, (gross_pnl - fees) / (entry_price * qty) * 100 AS return_pct, exit_i - entry_i AS bars_held FROM trades),
spaced AS (SELECT symbol, 365.25 * 86400 / quantile_cont(s, 0.5) AS per_year FROM (SELECT symbol, epoch(open_time - lag(open_time) OVER ({W})) AS s FROM f) GROUP BY symbol),
curve AS (SELECT symbol, max(CASE WHEN peak > 0 THEN (peak - eq) / peak ELSE 0 END) AS fall, avg(eq / eq0 - 1) FILTER (rn > 1) AS mean, stddev_samp(eq / eq0 - 1) FILTER (rn > 1) AS sd, stddev_samp(eq / eq0 - 1) FILTER (rn > 1 AND eq < eq0) AS down FROM steps WHERE rn > 0 GROUP BY symbol),
told AS (SELECT ends.symbol, count(pnl) AS n_trades, sum(pnl) AS total_pnl, 10000 + coalesce(sum(pnl), 0) AS final_cash, coalesce(sum(pnl), 0) / 100 AS total_return_pct, any_value(fall) AS max_drawdown, coalesce(avg(CAST(pnl > 0 AS DOUBLE)) * 100, 0) AS win_rate_pct, {_PF} AS profit_factor, coalesce(avg(pnl), 0) AS expectancy,
any_value(CASE WHEN sd > 0 THEN mean / sd * sqrt(per_year) ELSE 0 END) AS sharpe, any_value(CASE WHEN down > 0 THEN mean / down * sqrt(per_year) ELSE 0 END) AS sortino, coalesce(sum(fees), 0) AS total_fees, avg(bars_held) AS avg_bars_held, max(pnl) AS best, min(pnl) AS worst
FROM ends JOIN curve USING (symbol) JOIN spaced USING (symbol) LEFT JOIN won USING (symbol) GROUP BY ends.symbol)"""


_ACCOUNT = "symbol, n_trades, round(total_pnl, 4) AS total_pnl, round(final_cash, 4) AS final_cash, round(max_drawdown, 4) AS max_drawdown FROM told"
_RISK_SQL = _trading("e * (1 - 0.006)", "e + (e - s) * 2", _BY_RISK, 0.0008, 0.00015)
SQL["bt_margin"] = f"WITH RECURSIVE {BARS}, {_SIG}, {_trading(size='200', half=0.01, margin=(50, 50))} SELECT {_ACCOUNT}"
SQL["bt_costs"] = f"WITH RECURSIVE {BARS}, {_SIG}, {_trading(size='200', half=0.01, commission=0.035)} SELECT {_ACCOUNT}"
SQL["bt_targets_pct"] = f"WITH RECURSIVE {BARS}, {_SIG}, {_trading('e - 1.5', 'e * 1.012', 'least(80 / abs(e - s), least(eq, cash) / e)', 0.0005)} SELECT {_ACCOUNT}"
SQL["bt_ladder"] = f"""WITH RECURSIVE {BARS}, {_SIG}, sim(symbol, rn, cash, qty, px, stop, one, two, first, k, eq) AS (
SELECT symbol, CAST(0 AS BIGINT), 10000.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, false, CAST(0 AS BIGINT), 10000.0::DOUBLE FROM f WHERE rn = 1
UNION ALL SELECT symbol, rn, CASE WHEN go THEN cash - e * size * 0.0008 ELSE cash END, CASE WHEN go THEN size ELSE qty END, CASE WHEN go THEN e ELSE px END, CASE WHEN go THEN s ELSE stop END, CASE WHEN go THEN e * 1.004 ELSE one END, CASE WHEN go THEN e * 1.01 ELSE two END, first AND NOT go, CASE WHEN go THEN k + 1 ELSE k END, eq
FROM (SELECT *, up AND qty = 0 AND cash > 0 AND size > 0 AND e * size * 0.0008 <= cash AS go FROM (SELECT *, {_BY_RISK} AS size FROM (SELECT *, e * (1 - 0.006) AS s
FROM (SELECT symbol, rn, up, eq, px, one, two, k, close * 1.00015 AS e, first OR a AS first, CASE WHEN a THEN greatest(stop, px) ELSE stop END AS stop, CASE WHEN hit OR b THEN 0 WHEN a THEN qty * 0.5 ELSE qty END AS qty,
cash + CASE WHEN hit THEN (stop * 0.99985 - px) * qty - stop * 0.99985 * qty * 0.0008 ELSE CASE WHEN a THEN (one * 0.99985 - px) * qty * 0.5 - one * 0.99985 * qty * 0.5 * 0.0008 ELSE 0 END + CASE WHEN b THEN ((two * 0.99985 - px) - two * 0.99985 * 0.0008) * CASE WHEN a THEN qty * 0.5 ELSE qty END ELSE 0 END END AS cash
FROM (SELECT *, held AND NOT hit AND NOT first AND high >= one AS a, held AND NOT hit AND high >= two AS b
FROM (SELECT f.symbol, f.rn, f.close, f.high, f.up, p.* EXCLUDE (symbol, rn, eq), p.qty > 0 AS held, p.qty > 0 AND f.low <= p.stop AS hit, p.cash + (f.close - p.px) * p.qty AS eq FROM sim p JOIN f ON f.symbol = p.symbol AND f.rn = p.rn + 1))))))),
done AS (SELECT s.symbol, s.k, s.cash + (f.close * 0.99985 - s.px) * s.qty - f.close * 0.99985 * s.qty * 0.0008 AS cash FROM sim s JOIN f USING (symbol, rn) WHERE rn = (SELECT max(rn) FROM f g WHERE g.symbol = s.symbol)),
dd AS (SELECT symbol, max(CASE WHEN peak > 0 THEN (peak - eq) / peak ELSE 0 END) AS fall FROM (SELECT symbol, eq, max(eq) OVER (PARTITION BY symbol ORDER BY rn) AS peak FROM sim WHERE rn > 0) GROUP BY symbol)
SELECT symbol, k AS n_trades, CASE WHEN k > 0 THEN round(cash - 10000, 4) END AS total_pnl, round(cash, 4) AS final_cash, round(fall, 4) AS max_drawdown FROM done JOIN dd USING (symbol)"""


def _several(up: str) -> str:
    """Up to three positions at once, as a list; sized by cash, with stops and targets in units of price."""
    gone = "low <= x.stop OR high >= x.target OR down"
    price = "CASE WHEN low <= x.stop THEN x.stop WHEN high >= x.target THEN x.target ELSE close END"
    return f"""sim(symbol, rn, cash, held, k, eq) AS (
SELECT symbol, CAST(0 AS BIGINT), 10000.0::DOUBLE, CAST([] AS STRUCT(px DOUBLE, qty DOUBLE, stop DOUBLE, target DOUBLE)[]), CAST(0 AS BIGINT), 10000.0::DOUBLE FROM f WHERE rn = 1
UNION ALL SELECT symbol, rn, CASE WHEN go THEN cash - close * qty * 0.0005 ELSE cash END, CASE WHEN go THEN list_append(held, {{'px': close, 'qty': qty, 'stop': close - 1, 'target': close + 2}}) ELSE held END, CASE WHEN go THEN k + 1 ELSE k END, eq
FROM (SELECT *, {up} AND len(held) < 3 AND cash > 0 AND qty > 0 AND close * qty * 0.0005 <= cash AS go FROM (SELECT *, least(10000.0 / 3, least(eq, cash)) / close AS qty
FROM (SELECT * EXCLUDE (held, cash), cash + coalesce(list_sum(list_transform(list_filter(held, lambda x: {gone}), lambda x: ({price} - x.px) * x.qty - {price} * x.qty * 0.0005)), 0) AS cash, list_filter(held, lambda x: NOT ({gone})) AS held
FROM (SELECT f.*, p.cash, p.held, p.k, p.cash + coalesce(list_sum(list_transform(p.held, lambda x: (f.close - x.px) * x.qty)), 0) AS eq FROM sim p JOIN f ON f.symbol = p.symbol AND f.rn = p.rn + 1))))),
done AS (SELECT s.symbol, s.k, s.cash + coalesce(list_sum(list_transform(s.held, lambda x: (f.close - x.px) * x.qty - f.close * x.qty * 0.0005)), 0) AS cash FROM sim s JOIN f USING (symbol, rn) WHERE rn = (SELECT max(rn) FROM f g WHERE g.symbol = s.symbol)),
dd AS (SELECT symbol, max(CASE WHEN peak > 0 THEN (peak - eq) / peak ELSE 0 END) AS fall FROM (SELECT symbol, eq, max(eq) OVER (PARTITION BY symbol ORDER BY rn) AS peak FROM sim WHERE rn > 0) GROUP BY symbol)
SELECT symbol, k AS n_trades, CASE WHEN k > 0 THEN round(cash - 10000, 4) END AS total_pnl, round(cash, 4) AS final_cash, round(fall, 4) AS max_drawdown FROM done JOIN dd USING (symbol)"""


SQL["bt_multi_position"] = f"WITH RECURSIVE {BARS}, {_SIG}, {_several('up')}"
SQL["bt_pyramid"] = f"WITH RECURSIVE {BARS}, {_SIG}, {_several('a AND g')}"

_RISK = BacktestConfig(fee_bps=8, slippage_bps=1.5, exit_enabled=True, sl_mode="entry_pct", sl_value=0.6, tp_mode="rr", tp_value=2.0, sizing_mode="risk_pct_equity", sizing_value=1.0)
for _name, _cfg in {
    "bt_sl_tp": _RISK,
    "bt_ladder": _RISK.replace(take_profits=(TakeProfit("entry_pct", 0.4, 50, "breakeven"), TakeProfit("entry_pct", 1.0, 100)), allow_rule_close=False),
    "bt_trailing": _RISK.replace(trail_mode="pct", trail_value=0.8, tp_mode="none"),
    "bt_ref_stop": _RISK.replace(sl_mode="ref_col", sl_buffer_pct=0.05, sl_fallback_value=0.8, sl_ref_long_col="swing_last_low"),
    "bt_margin": BacktestConfig(margin_enabled=True, leverage=50, contract_size=100, sizing_mode="lots", sizing_value=2, stop_out_level=50, spread=0.02),
    "bt_costs": BacktestConfig(contract_size=100, sizing_mode="lots", sizing_value=2, spread=0.02, commission_per_lot=3.5),
    "bt_targets_pct": BacktestConfig(fee_bps=5, exit_enabled=True, sl_mode="price_abs", sl_value=1.5, tp_mode="entry_pct", tp_value=1.2, sizing_mode="risk_amount", sizing_value=80),
    "bt_multi_position": BacktestConfig(max_open_trades=3, fee_bps=5, exit_enabled=True, sl_mode="price_abs", sl_value=1.0, tp_mode="price_abs", tp_value=2.0),
}.items():
    QUERIES[_name] = lambda spark, d, cfg=_cfg: _account(run_backtest(_crossing(spark, d), cfg))


@query("bt_pyramid")
def bt_pyramid(spark, d):
    """Three positions at once: an entry on every rising bar above the mean."""
    cfg = BacktestConfig(max_open_trades=3, fee_bps=5, exit_enabled=True, sl_mode="price_abs", sl_value=1.0, tp_mode="price_abs", tp_value=2.0)
    rows = _crossing(spark, d).withColumn("entry_long", S.all_of(S.above("close", "sma_20"), S.is_green()))
    return _account(run_backtest(rows, cfg))


_TRADE_DIGITS = {"entry_price": 6, "exit_price": 6, "stop_price": 6, "qty": 6, "gross_pnl": 4, "fees": 4, "pnl": 4, "return_pct": 6}


@query("bt_trades", f"WITH RECURSIVE {BARS}, {_SIG}, {_RISK_SQL} SELECT symbol, side, entry_time, exit_time, entry_i, exit_i, bars_held, close_reason, " + ", ".join(f"round({c}, {k}) AS {c}" for c, k in _TRADE_DIGITS.items()) + " FROM won")
def bt_trades(spark, d):
    made = run_backtest(_crossing(spark, d), _RISK).trades
    return made.select(KEY, "side", "entry_time", "exit_time", "entry_i", "exit_i", "bars_held", "close_reason", *[F.round(c, k).alias(c) for c, k in _TRADE_DIGITS.items()])


_TOLD = {"n_trades": ("num_trades", 0), "total_pnl": ("total_pnl", 4), "final_cash": ("final_cash", 4), "total_return_pct": ("total_return_pct", 6), "max_drawdown * 100": ("max_drawdown_pct", 6), "win_rate_pct": ("win_rate_pct", 6), "profit_factor": ("profit_factor", 6), "expectancy": ("expectancy_per_trade", 4), "sharpe": ("sharpe", 6), "sortino": ("sortino", 6)}
_TOLD_SQL = ", ".join(f"CAST(round({e}, {k}) AS DOUBLE) AS {n}" for e, (n, k) in _TOLD.items())
_MORE = {"total_fees": ("total_fees", 4), "avg_bars_held": ("avg_bars_held", 6), "best": ("largest_winner", 4), "worst": ("largest_loser", 4)}


@query("bt_stats", f"WITH RECURSIVE {BARS}, {_SIG}, {_RISK_SQL} SELECT symbol, {_TOLD_SQL}, " + ", ".join(f"round({e}, {k}) AS {n}" for e, (n, k) in _MORE.items()) + " FROM told")
def bt_stats(spark, d):
    told = statistics.compute_stats(run_backtest(_crossing(spark, d), _RISK))
    return told.select(KEY, *[F.round(n, k).alias(n) for n, k in [*_TOLD.values(), *_MORE.values()]])


@query("drawdown_curve", f"WITH {DAILY} SELECT symbol, open_time AS t, close AS equity, round(CASE WHEN max(close) OVER ({W}) > 0 THEN (max(close) OVER ({W}) - close) / max(close) OVER ({W}) ELSE 0 END, 8) AS drawdown FROM daily")
def drawdown_curve(spark, d):
    return with_drawdown(_curve(spark, d)).select(KEY, "t", "equity", F.round("drawdown", 8).alias("drawdown"))


# ---- analytics, over trades and curves made from orders


def _trades(spark: SparkSession, d: str) -> DataFrame:
    orders = spark.read.parquet(f"{d}/orders.parquet")
    pnl = F.round(F.col("o_totalprice") - 150000, 2)
    return orders.select(
        F.lit(0).cast("long").alias(RUN), F.col("o_orderpriority").alias(KEY), F.when(F.col("o_orderkey") % 2 == 0, "long").otherwise("short").alias("side"), F.expr("o_orderdate + make_dt_interval(0, cast(o_orderkey % 24 as int))").alias("entry_time"), F.col("o_orderkey").alias("entry_i"),
        pnl.alias("pnl"), F.round(F.col("o_totalprice") / 1000, 2).alias("fees"), ((F.col("o_totalprice") - 150000) / F.col("o_totalprice") * 100).alias("return_pct"), (F.col("o_orderkey") % 50).alias("bars_held"), F.col("o_orderstatus").alias("close_reason"),
    )


def _curve(spark: SparkSession, d: str) -> DataFrame:
    return order_bars(spark, d).select(F.lit(0).cast("long").alias(RUN), KEY, F.col(TIME).alias("t"), F.col("close").alias("equity"), F.lit(0).cast("long").alias("open_trades"))


_STATS = f"count(pnl) AS n_trades, round(coalesce(avg(CAST(pnl > 0 AS DOUBLE)) * 100, 0), 6) AS win_rate_pct, round(coalesce(sum(pnl), 0), 2) AS total_pnl, round(coalesce(avg(pnl), 0), 6) AS avg_pnl, round({_PF}, 6) AS profit_factor"


def _told(df: DataFrame, *keys: str) -> DataFrame:
    digits = {"total_pnl": 2}
    return df.select(*keys, "n_trades", *[F.round(c, digits.get(c, 6)).alias(c) for c in ("win_rate_pct", "total_pnl", "avg_pnl", "profit_factor")])


@query("by_hour", f"WITH {TRADES} SELECT hour(entry_time) AS hour, {_STATS} FROM trades GROUP BY 1")
def by_hour(spark, d):
    return _told(A.by_hour(_trades(spark, d)), "hour")


@query("by_weekday", f"WITH {TRADES} SELECT isodow(entry_time) - 1 AS weekday, dayname(entry_time) AS day, {_STATS} FROM trades GROUP BY 1, 2")
def by_weekday(spark, d):
    return _told(A.by_weekday(_trades(spark, d)), "weekday", "day")


@query("by_month", f"WITH {TRADES} SELECT month(entry_time) AS month, {_STATS} FROM trades GROUP BY 1")
def by_month(spark, d):
    return _told(A.by_month(_trades(spark, d)), "month")


@query("by_session", f"WITH {TRADES}, s(session, a, b) AS (VALUES ('london', 7, 16), ('newyork', 12, 21), ('tokyo', 0, 9), ('sydney', 21, 6)) SELECT session, {_STATS} FROM s LEFT JOIN trades ON CASE WHEN a <= b THEN hour(entry_time) >= a AND hour(entry_time) < b ELSE hour(entry_time) >= a OR hour(entry_time) < b END GROUP BY 1")
def by_session(spark, d):
    return _told(A.by_session(_trades(spark, d)), "session")


def _bar_trades(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A trade of every bar, held for three bars."""
    bars = _bars(spark, d)
    w = bars_window()
    numbered = bars.withColumn("entry_i", F.row_number().over(w) - 1).withColumn("pnl", F.round(F.lead("close", 3).over(w) - F.col("close"), 6))
    return numbered.where("pnl is not null").select(KEY, "entry_i", "pnl"), bars


_REGIME = f"WITH RECURSIVE {BARS}, {_TR}, {recursive_mean('e', 'n', 'close', '(2.0 / 21)')}, {recursive_mean('a', 'tr', 'tr', '(1.0 / 5)')}, t0 AS (SELECT *, round(lead(close, 3) OVER ({W}) - close, 6) AS pnl FROM n), t AS (SELECT t0.*, coalesce(rn >= 20 AND close >= e.y, false) AS up, CASE WHEN rn >= 5 THEN a.y / close END AS v FROM t0 JOIN e USING (symbol, rn) JOIN a USING (symbol, rn) WHERE pnl IS NOT NULL), q AS (SELECT quantile_cont(v, 1.0 / 3) AS q1, quantile_cont(v, 2.0 / 3) AS q2 FROM t) SELECT CASE WHEN up THEN 'uptrend' ELSE 'downtrend' END || '/' || CASE WHEN v IS NULL OR v <= q1 THEN 'lowvol' WHEN v <= q2 THEN 'midvol' ELSE 'highvol' END AS regime, {_STATS} FROM t, q GROUP BY 1"


@query("by_regime", _REGIME)
def by_regime(spark, d):
    return _told(A.by_regime(*_bar_trades(spark, d), ema_period=20, atr_period=5), "regime")


@query("close_reasons", f"WITH {TRADES} SELECT close_reason, count(*) AS n_trades FROM trades GROUP BY 1")
def close_reasons(spark, d):
    return A.close_reasons(_trades(spark, d))


@query("best_weekday", f"WITH {TRADES}, t AS (SELECT dayname(entry_time) AS day, sum(pnl) AS total_pnl FROM trades GROUP BY 1) SELECT arg_max(day, total_pnl) AS day, round(max(total_pnl), 2) AS total_pnl FROM t")
def best_weekday(spark, d):
    return A.best_of(A.by_weekday(_trades(spark, d)), "day").withColumn("total_pnl", F.round("total_pnl", 2))


@query("hour_weekday_grid", f"WITH {TRADES}, g AS (SELECT isodow(entry_time) - 1 AS weekday, hour(entry_time) AS h, pnl FROM trades) SELECT d.weekday, " + ", ".join(f"round(sum(pnl) FILTER (h = {h}), 2) AS h{h:02d}" for h in range(24)) + " FROM (SELECT CAST(range AS BIGINT) AS weekday FROM range(7)) d LEFT JOIN g ON g.weekday = d.weekday GROUP BY 1")
def hour_weekday_grid(spark, d):
    return A.hour_weekday(_trades(spark, d)).select("weekday", *[F.round(f"h{h:02d}", 2).alias(f"h{h:02d}") for h in range(24)])


@query("monthly_returns", f"WITH {DAILY}, m AS (SELECT symbol, date_trunc('month', open_time) AS m, arg_max(close, open_time) AS e, arg_min(close, open_time) AS s FROM daily GROUP BY 1, 2), sp AS (SELECT symbol, unnest(generate_series(min(m), max(m), INTERVAL '1 month')) AS m, min(m) AS a FROM m GROUP BY symbol), j AS (SELECT sp.symbol, CAST(sp.m AS TIMESTAMP) AS m, sp.a, e, s FROM sp LEFT JOIN m ON m.symbol = sp.symbol AND m.m = sp.m) SELECT symbol, year(m) AS year, month(m) AS month, round((e / CASE WHEN m = a THEN s ELSE lag(e) OVER (PARTITION BY symbol ORDER BY m) END - 1) * 100, 6) AS return_pct FROM j")
def monthly_returns(spark, d):
    return statistics.monthly_returns(_curve(spark, d)).select(KEY, "year", "month", F.round("return_pct", 6).alias("return_pct"))


@query("monthly_table", f"WITH {DAILY}, m AS (SELECT symbol, date_trunc('month', open_time) AS m, arg_max(close, open_time) AS e, arg_min(close, open_time) AS s FROM daily GROUP BY 1, 2), r AS (SELECT symbol, m, (e / coalesce(lag(e) OVER (PARTITION BY symbol ORDER BY m), s) - 1) * 100 AS r FROM m) SELECT symbol, year(m) AS year, " + ", ".join(f'round(max(r) FILTER (month(m) = {k}), 6) AS "{k}"' for k in range(1, 13)) + " FROM r GROUP BY 1, 2")
def monthly_table(spark, d):
    return statistics.monthly_table(_curve(spark, d)).select(KEY, "year", *[F.round(str(k), 6).alias(str(k)) for k in range(1, 13)])


@query("curve_points", f"WITH {DAILY}, c AS (SELECT symbol, open_time, close, floor((row_number() OVER ({W}) - 1) / ceil(count(*) OVER (PARTITION BY symbol) / 50)) AS b FROM daily) SELECT symbol, min(open_time) AS t, min(close) AS low, max(close) AS high, arg_max(close, open_time) AS last FROM c GROUP BY symbol, b")
def curve_points(spark, d):
    """An equity curve cut to fifty points, for a drawing."""
    return report.curve(SimResult.of(_curve(spark, d)), 50).drop(RUN)


@query("chart_trades", f"WITH RECURSIVE {BARS}, {_SIG}, {_RISK_SQL} SELECT symbol, 'entry' AS what, entry_time AS open_time, round(entry_price, 6) AS price, side FROM won UNION ALL SELECT symbol, 'exit', exit_time, round(exit_price, 6), side FROM won")
def chart_trades(spark, d):
    """Entries and exits of all trades as points of a chart."""
    made = run_backtest(_crossing(spark, d), _RISK).trades
    return report.price_and_trades(_bars(spark, d), made, "4h")[1].withColumn("price", F.round("price", 6))


@query("periods_per_year", f"WITH {BARS}, s AS (SELECT symbol, epoch(open_time - lag(open_time) OVER ({W})) AS s FROM bars) SELECT symbol, round(365.25 * 86400 / quantile_cont(s, 0.5), 6) AS periods_per_year FROM s GROUP BY 1")
def periods_per_year(spark, d):
    return backtest.periods_per_year(_bars(spark, d).withColumnRenamed(TIME, "t"), keys=(KEY,)).withColumn("periods_per_year", F.round("periods_per_year", 6))


@query("max_consecutive", f"WITH {TRADES}, a AS (SELECT symbol, entry_i, sign(pnl) AS k, row_number() OVER (PARTITION BY symbol ORDER BY entry_i) - row_number() OVER (PARTITION BY symbol, sign(pnl) ORDER BY entry_i) AS g FROM trades), c AS (SELECT symbol, k, g, count(*) AS n FROM a GROUP BY 1, 2, 3) SELECT symbol, coalesce(max(n) FILTER (k > 0), 0) AS max_consecutive_wins, coalesce(max(n) FILTER (k < 0), 0) AS max_consecutive_losses FROM c GROUP BY 1")
def max_consecutive(spark, d):
    return statistics.longest_runs(_trades(spark, d)).drop(RUN)


_CORE = {"total_pnl": ("sum(pnl)", 2), "num_trades": ("CAST(count(*) AS DOUBLE)", 2), "num_winners": ("CAST(count(*) FILTER (pnl > 0) AS DOUBLE)", 2), "num_losers": ("CAST(count(*) FILTER (pnl < 0) AS DOUBLE)", 2), "win_rate_pct": ("avg(CAST(pnl > 0 AS DOUBLE)) * 100", 6), "gross_profit": ("sum(pnl) FILTER (pnl > 0)", 2), "gross_loss": ("-sum(pnl) FILTER (pnl < 0)", 2), "profit_factor": (_PF, 6), "avg_pnl": ("avg(pnl)", 4), "median_pnl": ("quantile_cont(pnl, 0.5)", 4), "avg_winner": ("avg(pnl) FILTER (pnl > 0)", 4), "avg_loser": ("avg(pnl) FILTER (pnl < 0)", 4), "largest_winner": ("max(pnl)", 2), "largest_loser": ("min(pnl)", 2), "avg_return_pct": ("avg(return_pct)", 6), "avg_bars_held": ("avg(bars_held)", 6), "total_fees": ("sum(fees)", 2), "avg_fee_per_trade": ("avg(fees)", 6)}


@query("stats_core", f"WITH {TRADES} SELECT symbol, " + ", ".join(f"round({e}, {k}) AS {n}" for n, (e, k) in _CORE.items()) + " FROM trades GROUP BY 1")
def stats_core(spark, d):
    return statistics.trade_table_stats(_trades(spark, d)).select(KEY, *[F.round(n, k).alias(n) for n, (_, k) in _CORE.items()])


@query("stats_side", f"WITH {TRADES} SELECT symbol, " + ", ".join(f"CAST(count(*) FILTER (side = '{s}') AS DOUBLE) AS {s}_trades, round(coalesce(sum(pnl) FILTER (side = '{s}'), 0), 2) AS {s}_pnl, round(coalesce(avg(CAST(pnl > 0 AS DOUBLE)) FILTER (side = '{s}') * 100, 0), 6) AS {s}_win_rate_pct" for s in ("long", "short")) + " FROM trades GROUP BY 1")
def stats_side(spark, d):
    out = statistics.trade_table_stats(_trades(spark, d))
    return out.select(KEY, *[c for s in ("long", "short") for c in (F.col(f"{s}_trades"), F.round(f"{s}_pnl", 2).alias(f"{s}_pnl"), F.round(f"{s}_win_rate_pct", 6).alias(f"{s}_win_rate_pct"))])


@query("stats_curve", f"WITH {DAILY}, r AS (SELECT symbol, open_time, close / lag(close) OVER ({W}) - 1 AS r, epoch(open_time - lag(open_time) OVER ({W})) AS s, (max(close) OVER ({W}) - close) / max(close) OVER ({W}) AS dd FROM daily), a AS (SELECT symbol, max(dd) AS dd, avg(r) AS m, stddev_samp(r) AS sd, stddev_samp(r) FILTER (r < 0) AS down, 365.25 * 86400 / quantile_cont(s, 0.5) AS y FROM r GROUP BY 1) SELECT symbol, round(dd * 100, 6) AS max_drawdown_pct, round(m / sd * sqrt(y), 6) AS sharpe, round(m / down * sqrt(y), 6) AS sortino, round(m * y / dd, 4) AS calmar FROM a")
def stats_curve(spark, d):
    out = statistics.curve_stats(_curve(spark, d))
    return out.select(KEY, *[F.round(c, k).alias(c) for c, k in (("max_drawdown_pct", 6), ("sharpe", 6), ("sortino", 6), ("calmar", 4))])


# ---- searches

_GRID = {"fast": [3, 5, 8], "slow": [15, 20], "confirm_n": [1, 3]}
_MINUTE_GRID = _GRID | {"confirm_n": [1, 2, 3, 4]}
_COLUMNS = ("run_id", "symbol", "fast", "slow", "confirm_n", "num_trades", "total_return_pct", "max_drawdown_pct", "final_cash")


def _sweep_sql(grid: dict, trading: str, bars: str = BARS, settings: list[dict] | None = None, drawn: list[dict] | None = None) -> str:
    """The runs of a grid of ribbons (and of settings), or of drawn ones, as (runs): each is one more symbol of the fold."""
    combos = drawn or [c | t for c in search.expand_grid(grid) for t in settings or [{}]]
    means = ", ".join(recursive_mean(f"m{p}", "n", "close", f"(2.0 / {p + 1})") for p in sorted({c[k] for c in combos for k in ("fast", "slow")}))
    parts, last = [], []
    for k, c in enumerate(combos):
        fast, slow = c["fast"], c["slow"]
        own = "".join(f", {v}::DOUBLE AS {n}" for n, v in c.items() if n not in grid)
        parts.append(f"x{k} AS (SELECT n.*, CASE WHEN rn >= {fast} THEN close - m{fast}.y END AS d, rn >= {slow} AND close > m{slow}.y AS above FROM n JOIN m{fast} USING (symbol, rn) JOIN m{slow} USING (symbol, rn)), y{k} AS (SELECT symbol || '/{k}' AS symbol, open_time, rn, close, high, low{own}, coalesce(lag(d) OVER ({W}) <= 0 AND d > 0, false) AND {_rows('above', c.get('confirm_n', 3))} AS up, coalesce(lag(d) OVER ({W}) >= 0 AND d < 0, false) AS down FROM x{k})")
        last.append(f"SELECT * FROM y{k}")
    names = list(combos[0])
    values = ", ".join(f"({k}, {', '.join(str(v) for v in c.values())})" for k, c in enumerate(combos))
    kinds = ", ".join(f"CAST({n} AS {'BIGINT' if n in grid else 'DOUBLE'}) AS {n}" for n in names)
    told = ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for e, (n, _) in _TOLD.items())
    return f"WITH RECURSIVE {bars}, {means}, {', '.join(parts)}, f AS ({' UNION ALL '.join(last)}), {trading}, g(k, {', '.join(names)}) AS (VALUES {values}), runs AS (SELECT CAST(g.k AS BIGINT) AS run_id, split_part(symbol, '/', 1) AS symbol, {kinds}, {told} FROM told JOIN g ON g.k = CAST(split_part(symbol, '/', 2) AS INTEGER))"


_RUNS = ", ".join([*_COLUMNS[:6], *[f"round({c}, 4) AS {c}" for c in _COLUMNS[6:]]])
_GRID_SQL = _sweep_sql(_GRID, _RISK_SQL)


def _sweep(spark: SparkSession, d: str) -> DataFrame:
    return search.run_grid(_bars(spark, d), Y.EmaRibbon, _GRID, _RISK)


def _short(runs: DataFrame) -> DataFrame:
    return runs.select(*_COLUMNS[:6], *[F.round(c, 4).alias(c) for c in _COLUMNS[6:]])


@query("grid_sweep", f"{_sweep_sql(_GRID, _trading(fee=0.001))} SELECT {_RUNS} FROM runs")
def grid_sweep(spark, d):
    return _short(search.run_grid(_bars(spark, d), Y.EmaRibbon, _GRID, BacktestConfig(fee_bps=10)))


@query("grid_sweep_exits", f"{_GRID_SQL} SELECT run_id, symbol, fast, slow, confirm_n, " + ", ".join(f"round({n}, {min(k, 4)}) AS {n}" for n, k in _TOLD.values() if n != "total_pnl") + " FROM runs")
def grid_sweep_exits(spark, d):
    return _sweep(spark, d).select(*_COLUMNS[:5], *[F.round(n, min(k, 4)).alias(n) for n, k in _TOLD.values() if n != "total_pnl"])


@query("sweep_topk", f"{_GRID_SQL} SELECT {_RUNS} FROM runs WHERE num_trades >= 3 ORDER BY runs.total_return_pct DESC, run_id LIMIT 15")
def sweep_topk(spark, d):
    return _short(search.top(_sweep(spark, d), 15, "total_return_pct", min_trades=3))


@query("sweep_pivot", f"{_GRID_SQL} SELECT confirm_n, " + ", ".join(f'round(max(total_return_pct) FILTER (fast = {v}), 4) AS "{v}"' for v in _GRID["fast"]) + " FROM runs GROUP BY 1")
def sweep_pivot(spark, d):
    out = search.sweep_table(_sweep(spark, d), "fast", "confirm_n", "total_return_pct", _GRID["fast"])
    return out.select("confirm_n", *[F.round(str(v), 4).alias(str(v)) for v in _GRID["fast"]])


@query("sweep_minute", f"{_sweep_sql(_MINUTE_GRID, _trading(fee=0.001), _MINUTES)} SELECT {_RUNS} FROM runs")
def sweep_minute(spark, d):
    return _short(search.run_grid(_bars(spark, d, "1min"), Y.EmaRibbon, _MINUTE_GRID, BacktestConfig(fee_bps=10)))


_EXITS = search.expand_grid({"sl_value": [0.4, 0.8], "tp_value": [1.5, 3.0]})
_EXIT_SQL = _trading("e * (1 - sl_value / 100)", "e + (e - s) * tp_value", _BY_RISK, 0.0008, 0.00015, extra=("sl_value", "tp_value"))


@query("experiment_rank", f"{_sweep_sql({'fast': [3, 8], 'slow': [20]}, _EXIT_SQL, settings=_EXITS)}, enough AS (SELECT *, num_trades >= 3 AS kept, bool_or(num_trades >= 3) OVER () AS any_kept FROM runs) SELECT run_id, symbol, fast, slow, sl_value, tp_value, num_trades, round(total_return_pct, 4) AS total_return_pct, round(sharpe, 4) AS sharpe, round(sortino, 4) AS sortino, CASE WHEN NOT isinf(profit_factor) THEN round(profit_factor, 4) END AS profit_factor FROM enough WHERE kept OR NOT any_kept")
def experiment_rank(spark, d):
    e = search.Experiment("exits", Y.EmaRibbon, _RISK, strategy_space={"fast": [3, 8], "slow": [20]}, cfg_space={"sl_value": [0.4, 0.8], "tp_value": [1.5, 3.0]}, min_trades=3, valid=lambda p: p["tp_value"] > p["sl_value"])
    return e.run(_bars(spark, d)).select("run_id", "symbol", "fast", "slow", "sl_value", "tp_value", "num_trades", *[F.round(c, 4).alias(c) for c in ("total_return_pct", "sharpe", "sortino", "profit_factor")])


_SPACE = {"fast": (3, 9), "slow": (12, 30), "confirm_n": [1, 2, 3]}
_DRAWN = search.draws(_SPACE, 8, random.Random(1))


@query("random_search", f"{_sweep_sql(_SPACE, _RISK_SQL, drawn=_DRAWN)} SELECT {_RUNS} FROM runs")
def random_search(spark, d):
    return _short(search.random_search(_bars(spark, d), Y.EmaRibbon, _SPACE, _RISK, n_trials=8, seed=1))


def _rung_sql(share: float) -> str:
    """All drawn runs over the head of the bars."""
    head = f"FROM bars WHERE epoch(open_time) <= (SELECT epoch(min(open_time)) + floor((epoch(max(open_time)) - epoch(min(open_time))) * {share}) FROM bars))"
    return f"{_sweep_sql(_SPACE, _RISK_SQL, bars=BARS.replace('FROM bars)', head), drawn=_DRAWN)} SELECT * FROM runs"


def _best_sql(rows: str, k: int) -> str:
    return f"SELECT run_id FROM {rows} GROUP BY run_id ORDER BY avg(total_return_pct) DESC NULLS LAST, run_id LIMIT {k}"


@query("halving_search", f"WITH r0 AS ({_rung_sql(0.25)}), s0 AS ({_best_sql('r0', 4)}), r1 AS (SELECT * FROM ({_rung_sql(0.5)}) WHERE run_id IN (SELECT run_id FROM s0)), s1 AS ({_best_sql('r1', 2)}), r2 AS (SELECT * FROM ({_rung_sql(1)}) WHERE run_id IN (SELECT run_id FROM s1)), runs AS (SELECT *, 0 AS rung FROM r0 UNION ALL SELECT *, 1 FROM r1 UNION ALL SELECT *, 2 FROM r2) SELECT CAST(rung AS BIGINT) AS rung, {_RUNS} FROM runs")
def halving_search(spark, d):
    """Eight trials on a quarter of the time, the best four on half of it, the best two on all."""
    out = search.halving_search(_bars(spark, d), Y.EmaRibbon, _SPACE, _RISK, "total_return_pct", n_trials=8, seed=1)
    return out.select(F.col("rung").cast("long").alias("rung"), *_COLUMNS[:6], *[F.round(c, 4).alias(c) for c in _COLUMNS[6:]])


@query("model_search")
def model_search(spark, d):
    """A study of twelve trials, the last eight drawn by what did well; kept as a table and gone on with."""
    bars, find = stage(_bars(spark, d), "bars"), dict(metric="total_return_pct", batch=4, startup=4, seed=1)
    first = search.model_search(bars, Y.EmaRibbon, _SPACE, _RISK, n_trials=8, **find)
    kept = search.Study.of(stage(first.table(spark), "study"), "maximize")
    return search.model_search(bars, Y.EmaRibbon, _SPACE, _RISK, n_trials=4, study=kept, **find).table(spark)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars, a cross of a short mean, its trades, and their statistics by hour of entry."""
    bars = I.add_emas(_bars(spark, sf_dir), [5, 20])
    signals = bars.withColumns({"entry_long": S.cross_up("close", "ema_5"), "exit_long": S.cross_down("close", "ema_5")})
    return A.by_hour(run_backtest(signals, BacktestConfig(fee_bps=2)).trades)


_FLAG = f"{recursive_mean('e5', 'n', 'close', '(2.0 / 6)')}, d AS (SELECT n.*, CASE WHEN rn >= 5 THEN close - e5.y END AS d FROM n JOIN e5 USING (symbol, rn)), f AS (SELECT *, coalesce(lag(d) OVER ({W}) <= 0 AND d > 0, false) AS up, coalesce(lag(d) OVER ({W}) >= 0 AND d < 0, false) AS down FROM d), " + _FOLD.replace("0.001", "0.0002").replace("10 <= cash", "2 <= cash")
_FLAG += ", went AS (SELECT symbol, k, min(rn) AS rn, arg_min(px, rn) AS px, arg_min(qty, rn) AS qty FROM sim WHERE k > 0 AND qty > 0 GROUP BY 1, 2), came AS (SELECT w.symbol, w.k, w.rn, w.px, w.qty, coalesce(min(s.rn) FILTER (s.qty = 0 OR s.k > w.k), max(s.rn), w.rn) AS out FROM went w LEFT JOIN sim s ON s.symbol = w.symbol AND s.rn > w.rn GROUP BY 1, 2, 3, 4, 5), trades AS (SELECT i.open_time AS entry_time, (o.close - px) * qty - o.close * qty * 0.0002 - 2 AS pnl FROM came JOIN f i ON i.symbol = came.symbol AND i.rn = came.rn JOIN f o ON o.symbol = came.symbol AND o.rn = came.out)"


@query("flagship_by_hour", f"WITH RECURSIVE {BARS}, {_FLAG} SELECT hour(entry_time) AS hour, {_STATS} FROM trades GROUP BY 1")
def flagship_by_hour(spark, d):
    return _told(flagship(spark, d), "hour")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
