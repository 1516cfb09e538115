"""Charts as self-contained SVG. Spark cuts what is drawn down to the viewport first, so that a chart of any
number of bars collects a few thousand points."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from datetime import datetime
from html import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import KEY, TIME
from barloom.functions.indicators import add_emas
from barloom.operators import attribution as A
from barloom.operators import statistics as M
from barloom.operators.backtest import RUN
from barloom.operators.timeframe import shape, viewport

UP, DOWN, PRICE, STOP = "#2a7f4f", "#b5413a", "#35618f", "#c98a1b"
COLOURS = ("#7a4fa3", "#c0762c", "#2f8c8c", "#8c2f5d", "#5d7a2f")
#: Points of a line, candles, and trades that one chart draws at most; of more trades those with the largest result.
POINTS, CANDLES, MARKS = 1500, 400, 2000
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def _seconds(t: datetime) -> float:
    return (t - datetime(1970, 1, 1)).total_seconds()


@dataclass
class Axes:
    """A box of the drawing with ranges of time and value."""

    x0: float
    x1: float
    y0: float
    y1: float
    width: int = 960
    height: int = 420
    top: int = 24

    def x(self, t: datetime) -> float:
        return round(40 + (self.width - 60) * (_seconds(t) - self.x0) / ((self.x1 - self.x0) or 1.0), 1)

    def y(self, v: float) -> float:
        return round(self.top + (self.height - 24) * (1 - (v - self.y0) / ((self.y1 - self.y0) or 1.0)), 1)

    def line(self, points: Iterable[tuple[datetime, float]], colour: str, width: float = 1.2) -> str:
        path = " ".join(f"{self.x(t)},{self.y(v)}" for t, v in points)
        return f'<polyline fill="none" stroke="{colour}" stroke-width="{width}" points="{path}"/>'

    def frame(self) -> str:
        return "".join(f'<text x="2" y="{self.y(v)}" font-size="10">{v:,.5g}</text>' for v in (self.y0, (self.y0 + self.y1) / 2, self.y1))


def axes(times: list[datetime], values: list[float], height: int = 420, top: int = 24) -> Axes:
    known = [v for v in values if v is not None and math.isfinite(v)] or [0.0]
    when = [_seconds(t) for t in times] or [0.0]
    return Axes(min(when), max(when), min(known), max(known), height=height, top=top)


def svg(parts: list[str], title: str, height: int, width: int = 960) -> str:
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width} {height}" width="{width}" height="{height}" font-family="sans-serif"><title>{escape(title)}</title><text x="40" y="14" font-size="13">{escape(title)}</text>{"".join(parts)}</svg>'


@dataclass
class Chart:
    """A price chart of one symbol: candles or a line, further lines, means and trades, over a span that can be
    changed. Each show() reads the span's bars anew, in as fine steps as the chart has room for."""

    bars: DataFrame
    symbol: str
    candles: bool = True
    title: str = "Price"
    first_bars: int = 400
    _lines: list[tuple[str, str]] = field(default_factory=list)
    _trades: DataFrame | None = None
    _span: tuple[str, str] | None = None

    def __post_init__(self) -> None:
        if TIME not in self.bars.columns:
            raise ValueError(f"the table has no column {TIME}")
        self.bars = self.bars.where(F.col(KEY) == self.symbol)

    def add_line(self, column: str, name: str | None = None) -> Chart:
        if column not in self.bars.columns:
            raise ValueError(f"the table has no column {column}")
        self._lines.append((column, name or column))
        return self

    def add_ema(self, period: int, source: str = "close") -> Chart:
        if f"ema_{period}" not in self.bars.columns:
            self.bars = add_emas(self.bars, [period], source)
        return self.add_line(f"ema_{period}", f"EMA {period}")

    def add_trades(self, trades: DataFrame) -> Chart:
        self._trades = trades.where(F.col(KEY) == self.symbol)
        return self

    def zoom(self, start: str | None = None, end: str | None = None) -> Chart:
        """Show the closed span; without limits, all bars."""
        lo, hi = self.bars.agg(F.min(TIME), F.max(TIME)).first()
        self._span = (str(start or lo), str(end or hi))
        return self

    def _recent(self) -> tuple[str, str] | None:
        """The span of the last first_bars bars."""
        lo, hi = self.bars.select(TIME).orderBy(F.desc(TIME)).limit(self.first_bars).agg(F.min(TIME), F.max(TIME)).first()
        return None if lo is None else (str(lo), str(hi))

    def show(self) -> str:
        """The chart as SVG; without bars, an empty one."""
        span = self._span or self._recent()
        if span is None:
            return svg([], self.title, 460)
        start, end = (F.lit(t).cast("timestamp_ntz") for t in span)
        inside = self.bars.where(F.col(TIME).between(start, end))
        shown = sorted(viewport(self.bars, *span, CANDLES).collect(), key=lambda r: r[TIME])  # about CANDLES rows
        # two candidates a bucket, four for each point that stays
        minutes = max(1, math.ceil((_seconds(datetime.fromisoformat(span[1])) - _seconds(datetime.fromisoformat(span[0]))) / 60 / (POINTS * 2)))
        lines = [("close", "close"), *self._lines] if not self.candles or not shown else self._lines
        drawn = {name: sorted((r[TIME], r[column]) for r in shape(inside, f"{minutes}min", POINTS, column).collect()) for column, name in lines}
        box = axes([r[TIME] for r in shown], [v for r in shown for v in (r.low, r.high) if v is not None] + [v for p in drawn.values() for _, v in p])
        parts = [box.frame()]
        half = max(0.5, 0.35 * (box.width - 60) / max(1, len(shown)))
        for r in shown if self.candles else []:
            if None in (r.open, r.high, r.low, r.close):
                continue
            x, colour = box.x(r[TIME]), UP if r.close >= r.open else DOWN
            a, b = sorted((box.y(r.open), box.y(r.close)))
            parts.append(f'<path class="candle" stroke="{colour}" fill="{colour}" d="M{x} {box.y(r.high)}V{box.y(r.low)}M{x - half:.1f} {a}h{2 * half:.1f}v{max(b - a, 0.5):.1f}h{-2 * half:.1f}z"/>')
        for k, (name, points) in enumerate(drawn.items()):
            colour = PRICE if name == "close" else COLOURS[k % len(COLOURS)]
            parts += [f'<g class="line">{box.line(points, colour)}</g>', f'<text x="{760 - 90 * k}" y="14" font-size="11" fill="{colour}">{escape(name)}</text>']
        if self._trades is not None:
            near = self._trades.where((F.col("exit_time") >= start) & (F.col("entry_time") <= end))
            parts += trade_marks(box, near)
        return svg(parts, self.title, 460)


def trade_marks(box: Axes, trades: DataFrame) -> list[str]:
    """Entries, exits and stops of trades, with their numbers as tooltips."""
    parts = []
    columns = [c for c in ("side", "entry_time", "exit_time", "entry_price", "exit_price", "pnl", "stop_price", "close_reason") if c in trades.columns]
    for r in trades.select(*columns).orderBy(F.desc(F.abs("pnl"))).limit(MARKS).collect():
        t = r.asDict()
        told = escape(f"{t['side']}: {t['entry_price']:.6g} at {t['entry_time']} to {t['exit_price']:.6g} at {t['exit_time']}, {t['pnl']:.4g} {t.get('close_reason') or ''}")
        x, y, tip = box.x(t["entry_time"]), box.y(t["entry_price"]), -7 if t["side"] == "long" else 7
        parts.append(f'<path class="entry" fill="{UP if tip < 0 else DOWN}" d="M{x} {y}l-4 {-tip}h8z"><title>{told}</title></path>')
        x, y = box.x(t["exit_time"]), box.y(t["exit_price"])
        parts.append(f'<path class="exit" stroke="{UP if t["pnl"] > 0 else DOWN}" stroke-width="2" d="M{x - 4} {y - 4}l8 8m0 -8l-8 8"><title>{told}</title></path>')
        if t.get("stop_price") is not None and math.isfinite(t["stop_price"]):
            parts.append(f'<path class="stop" stroke="{STOP}" stroke-dasharray="2 2" d="M{box.x(t["entry_time"])} {box.y(t["stop_price"])}H{box.x(t["exit_time"])}"/>')
    return parts


def price_chart(bars: DataFrame, symbol: str, emas: Iterable[int] = (), lines: Iterable[str] = (), trades: DataFrame | None = None, candles: bool = True, span: tuple[str | None, str | None] | None = None) -> str:
    """A chart in one call."""
    chart = Chart(bars, symbol, candles)
    for p in emas:
        chart.add_ema(p)
    for c in lines:
        chart.add_line(c)
    if trades is not None:
        chart.add_trades(trades)
    return (chart.zoom(*span) if span else chart).show()


def price_and_trades(bars: DataFrame, trades: DataFrame, symbol: str) -> str:
    """The close of all bars as a line, and all trades."""
    return price_chart(bars, symbol, trades=trades, candles=False, span=(None, None))


def equity_and_drawdown(equity: DataFrame, symbol: str, run: int = 0) -> str:
    """The equity curve, and below it how far it has fallen."""
    own = equity.where((F.col(KEY) == symbol) & (F.col(RUN) == run)).withColumnRenamed("t", TIME)
    lo, hi = own.agg(F.min(TIME), F.max(TIME)).first()
    if lo is None:
        return svg([], "Equity", 420)
    minutes = max(1, math.ceil((_seconds(hi) - _seconds(lo)) / 60 / (POINTS * 2)))
    points = {c: sorted((r[TIME], r[c]) for r in shape(own, f"{minutes}min", POINTS, c).collect()) for c in ("equity", "drawdown")}
    top = axes([lo, hi], [v for _, v in points["equity"]], height=260)
    low = axes([lo, hi], [0.0, *[-100 * v for _, v in points["drawdown"]]], height=150, top=280)
    return svg([top.frame(), top.line(points["equity"], PRICE), low.frame(), low.line([(t, -100 * v) for t, v in points["drawdown"]], DOWN)], f"Equity and drawdown in %: {symbol}", 440)


def heatmap(rows: list[str], columns: list[str], value: Callable[[int, int], float | None], title: str) -> str:
    """A table of coloured cells: green above 0, red below, by size."""
    cells = [[value(i, j) for j in range(len(columns))] for i in range(len(rows))]
    most = max((abs(v) for line in cells for v in line if v is not None and math.isfinite(v)), default=0.0) or 1.0
    parts = [f'<text x="{64 + 60 * j}" y="34" font-size="11">{escape(c)}</text>' for j, c in enumerate(columns)]
    for i, name in enumerate(rows):
        parts.append(f'<text x="4" y="{56 + 26 * i}" font-size="11">{escape(name)}</text>')
        for j, v in enumerate(cells[i]):
            if v is not None and math.isfinite(v):
                shade = f'fill="{UP if v > 0 else DOWN}" fill-opacity="{0.1 + 0.8 * abs(v) / most:.2f}"'
                parts.append(f'<rect class="cell" x="{56 + 60 * j}" y="{40 + 26 * i}" width="58" height="24" {shade}/><text x="{64 + 60 * j}" y="{56 + 26 * i}" font-size="10">{v:.4g}</text>')
    return svg(parts, title, 60 + 26 * len(rows), 80 + 60 * len(columns))


def monthly_heatmap(equity: DataFrame, symbol: str, run: int = 0) -> str:
    """Returns by year and month, in percent."""
    table = M.monthly_table(equity.where((F.col(KEY) == symbol) & (F.col(RUN) == run))).orderBy("year").collect()  # a row a year
    return heatmap([str(r["year"]) for r in table], list(MONTHS), lambda i, j: table[i][str(j + 1)], f"Monthly returns in %: {symbol}")


def hour_weekday_heatmap(trades: DataFrame, metric: str = "total_pnl", tz: str | None = None) -> str:
    """A trade metric by weekday and hour of entry."""
    table = A.hour_weekday(trades, metric, tz).orderBy("weekday").collect()  # seven rows
    return heatmap([d[:3] for d in A.DAYS], [f"{h:02d}" for h in range(24)], lambda i, j: table[i][f"h{j:02d}"], f"{metric} by weekday and hour")


def sweep_heatmap(results: DataFrame, x: str, y: str, z: str, agg: Callable[[str], Column] = F.max) -> str:
    """A result by two swept parameters."""
    pairs = {(r[0], r[1]): r[2] for r in results.groupBy(x, y).agg(agg(z).alias("z")).collect()}  # a row a combination
    xs, ys = sorted({k[0] for k in pairs}), sorted({k[1] for k in pairs})
    return heatmap([f"{y} {v}" for v in ys], [f"{x} {v}" for v in xs], lambda i, j: pairs.get((xs[j], ys[i])), f"{z} by {x} and {y}")
