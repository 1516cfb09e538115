"""Reports: small tables of a backtest as text or as one HTML page with drawings. Only aggregates are collected."""

from __future__ import annotations

from html import escape
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import KEY, TIME
from barloom.operators import attribution as A
from barloom.operators import statistics as M
from barloom.operators.backtest import RUN, SimResult
from barloom.operators.timeframe import span
from barloom.plans import charts

#: Points that a drawing may have; the curve is cut to as many buckets before it is collected.
POINTS = 1000
#: Runs and symbols that a page draws.
DRAWN = 20


def summary(result: SimResult, bars: DataFrame | None = None, tz: str | None = None) -> dict[str, list[dict]]:
    """Headline statistics and attribution tables as rows. Each has at most a few dozen rows a symbol."""
    trades = result.trades
    tables = {"stats": M.compute_stats(result), "hour": A.by_hour(trades, tz).orderBy("hour"), "weekday": A.by_weekday(trades, tz).orderBy("weekday"), "month": A.by_month(trades, tz).orderBy("month"), "session": A.by_session(trades, tz), "close_reason": A.close_reasons(trades), "monthly": M.monthly_table(result.equity).orderBy(RUN, KEY, "year")}
    if bars is not None:
        tables["regime"] = A.by_regime(trades, bars).orderBy("regime")
    return {name: [r.asDict() for r in t.collect()] for name, t in tables.items()}


def best(tables: dict[str, list[dict]]) -> dict[str, str]:
    """The weekday and the session with the highest total."""
    out = {}
    for name, label in (("weekday", "day"), ("session", "session")):
        rows = [r for r in tables[name] if r["n_trades"]]
        if rows:
            out[name] = max(rows, key=lambda r: r["total_pnl"])[label]
    return out


def curve(result: SimResult, points: int = POINTS, column: str = "equity") -> DataFrame:
    """Each series in at most `points` buckets of its rows: first time, lowest, highest and last value."""
    from pyspark.sql import Window

    w = Window.partitionBy(RUN, KEY).orderBy("t")
    place = F.row_number().over(w) - 1
    total = F.count(F.lit(1)).over(Window.partitionBy(RUN, KEY))
    cut = result.equity.withColumn("_b", F.floor(place / F.ceil(total / points)))
    return cut.groupBy(RUN, KEY, "_b").agg(F.min("t").alias("t"), F.min(column).alias("low"), F.max(column).alias("high"), F.max_by(column, "t").alias("last")).drop("_b")


def price_and_trades(bars: DataFrame, trades: DataFrame, rule: str) -> tuple[DataFrame, DataFrame]:
    """Candles of a rule's length, and the trades' entries and exits as points of a chart."""
    from barloom.operators.timeframe import resample

    assert span(rule)
    marks = trades.select(KEY, F.explode(F.array(F.struct(F.lit("entry").alias("what"), F.col("entry_time").alias(TIME), F.col("entry_price").alias("price"), "side"), F.struct(F.lit("exit").alias("what"), F.col("exit_time").alias(TIME), F.col("exit_price").alias("price"), "side"))).alias("m"))
    return resample(bars, rule), marks.select(KEY, "m.*")


def _cell(v) -> str:
    return f"{v:,.4g}" if isinstance(v, float) else "" if v is None else escape(str(v))


def _table(rows: list[dict]) -> str:
    if not rows:
        return "<p>no rows</p>"
    head = "".join(f"<th>{escape(c)}</th>" for c in rows[0])
    return f"<table><tr>{head}</tr>" + "".join("<tr>" + "".join(f"<td>{_cell(v)}</td>" for v in r.values()) + "</tr>" for r in rows) + "</table>"


def print_summary(result: SimResult, tz: str | None = None) -> dict[str, list[dict]]:
    """The main numbers of each symbol and the best weekday and session, printed; gives all tables."""
    tables = summary(result, tz=tz)
    for r in tables["stats"]:
        print(f"{r[KEY]}: {r['num_trades']:.0f} trades, {r['win_rate_pct']:.1f} % won, return {r['total_return_pct']:.2f} %, profit factor {r['profit_factor']:.2f}, sharpe {r['sharpe']:.2f}, drawdown {r['max_drawdown_pct']:.2f} %")
    for name, value in best(tables).items():
        print(f"best {name}: {value}")
    return tables


def to_html(result: SimResult, path: str, title: str = "Backtest", bars: DataFrame | None = None, tz: str | None = None) -> str:
    """One self-contained page: all tables, and the drawings of the first DRAWN runs and symbols."""
    tables = summary(result, bars, tz)
    parts = [f"<h1>{escape(title)}</h1>"]
    for run, symbol in [(r[RUN], r[KEY]) for r in result.accounts.orderBy(RUN, KEY).limit(DRAWN).collect()]:
        parts += [charts.equity_and_drawdown(result.equity, symbol, run), charts.monthly_heatmap(result.equity, symbol, run)]
        if bars is not None:
            parts.append(charts.price_and_trades(bars, result.trades.where(F.col(RUN) == run), symbol))
    parts.append(charts.hour_weekday_heatmap(result.trades, tz=tz))
    parts += [f"<h2>{escape(name)}</h2>{_table(rows)}" for name, rows in tables.items()]
    style = "body{font:14px sans-serif;margin:2em}td,th{padding:2px 8px;text-align:right;border-bottom:1px solid #ddd}"
    Path(path).write_text(f"<!doctype html><meta charset=utf-8><title>{escape(title)}</title><style>{style}</style>{''.join(parts)}")
    return path
