"""Strategies: rules from bars to the four signals. Each is a plan of expressions; nothing runs until asked."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions import signals as S
from barloom.functions import time_filters as D
from barloom.functions.columns import KEY, TIME
from barloom.functions.indicators import add_atr, add_ema, add_emas, add_heikin_ashi, add_macd, add_rsi, add_supertrend, add_swings
from barloom.operators.backtest import SIGNALS, SimResult, run_backtest
from barloom.operators.config import BacktestConfig
from barloom.operators.timeframe import build_mtf

Rules = tuple[Column | None, Column | None, Column | None, Column | None]


@dataclass
class Strategy:
    """prepare() adds the columns that build_signals() reads; time filters hold back entries only."""

    session: str | None = None
    hours: tuple[int, int] | None = None
    weekdays: tuple[int, ...] | None = None
    avoid_weekends: bool = False
    filter_tz: str | None = None

    name = "strategy"

    def prepare(self, bars: DataFrame) -> DataFrame:
        return bars

    def build_signals(self, bars: DataFrame) -> Rules:
        """Entry and exit of longs, entry and exit of shorts; None for never."""
        raise NotImplementedError

    def time_mask(self) -> Column | None:
        masks = []
        if self.session:
            masks.append(D.in_session(self.session, tz=self.filter_tz))
        if self.hours:
            masks.append(D.hour_between(*self.hours, tz=self.filter_tz))
        if self.weekdays:
            masks.append(D.weekday_in(self.weekdays, tz=self.filter_tz))
        if self.avoid_weekends:
            masks.append(D.not_weekend(tz=self.filter_tz))
        return S.all_of(*masks) if masks else None

    def signal_rules(self, prepared: DataFrame) -> list[Column]:
        """The four signals as expressions, with the time filters on the entries."""
        rules = [S.sure(r) if r is not None else F.lit(False) for r in self.build_signals(prepared)]
        mask = self.time_mask()
        return rules if mask is None else [r & mask if k % 2 == 0 else r for k, r in enumerate(rules)]

    def signals(self, prepared: DataFrame) -> DataFrame:
        """Prepared bars with the four boolean columns."""
        return prepared.withColumns(dict(zip(SIGNALS, self.signal_rules(prepared), strict=True)))

    def params(self) -> dict:
        return asdict(self)

    def backtest(self, bars: DataFrame, cfg: BacktestConfig, price: str = "close") -> SimResult:
        return run_backtest(self.signals(self.prepare(bars)), cfg, price)


@dataclass
class EmaRibbon(Strategy):
    """Price crosses its fast mean upwards while it has been above the slow one; out on the way down."""

    name = "ema_ribbon"
    fast: int = 50
    slow: int = 200
    confirm_n: int = 3
    source: str = "close"

    def prepare(self, bars: DataFrame) -> DataFrame:
        return add_emas(bars, [self.fast, self.slow], self.source)

    def build_signals(self, bars: DataFrame) -> Rules:
        fast, slow = f"ema_{self.fast}", f"ema_{self.slow}"
        return S.cross_up(self.source, fast) & S.last_all_above(self.source, slow, self.confirm_n), S.cross_down(self.source, fast), None, None


@dataclass
class EmaCross(Strategy):
    """Entries and exits around one mean, on plain or averaged candles, with a bias of a higher timeframe."""

    name = "ema_cross"
    ema_period: int = 50
    entry_mode: str = "cross"
    confirm_n: int = 1
    confirm_color: bool = False
    use_heikin_ashi: bool = False
    allow_long: bool = True
    allow_short: bool = True
    htf: str | None = None
    htf_ema: int | None = None
    exit_mode: str = "opposite"
    exit_ema: int | None = None
    swings_left: int = 12
    swings_right: int = 12

    def __post_init__(self) -> None:
        if self.entry_mode not in ("cross", "close", "full_candle"):
            raise ValueError(f"bad entry_mode {self.entry_mode!r}")
        if self.exit_mode not in ("opposite", "none", "ha_flip", "below_ema"):
            raise ValueError(f"bad exit_mode {self.exit_mode!r}")

    def _candle(self) -> dict[str, str]:
        return {c: f"ha_{c}" if self.use_heikin_ashi else c for c in ("open", "high", "low", "close")}

    def _mean(self, period: int | None) -> str:
        return f"mean_{'ha' if self.use_heikin_ashi else 'px'}_{int(period or 0)}"

    def prepare(self, bars: DataFrame) -> DataFrame:
        if self.use_heikin_ashi or self.exit_mode == "ha_flip":
            bars = add_heikin_ashi(bars)
        source = self._candle()["close"]
        periods = [self.ema_period] + ([self.exit_ema] if self.exit_mode == "below_ema" and self.exit_ema else [])
        for p in dict.fromkeys(periods):
            bars = add_ema(bars, int(p), source, self._mean(p))
        bars = add_atr(add_swings(bars, self.swings_left, self.swings_right), 14)
        if self.htf and self.htf_ema:
            bars = build_mtf(bars, {self.htf: lambda d: add_emas(d, [int(self.htf_ema)])})
        return bars

    def _enter(self, up: bool) -> Column:
        c, mean = self._candle(), self._mean(self.ema_period)
        held = S.last_all_above if up else S.last_all_below
        if self.entry_mode == "cross":
            rule = S.cross_up(c["close"], mean) if up else S.cross_down(c["close"], mean)
        elif self.entry_mode == "close":
            rule = held(c["close"], mean, self.confirm_n)
        else:
            rule = held(c["low"] if up else c["high"], mean, self.confirm_n)
        if self.confirm_color:
            rule &= (S.consecutive_green if up else S.consecutive_red)(self.confirm_n, c["open"], c["close"])
        if self.htf and self.htf_ema:
            rule &= (S.above if up else S.below)(c["close"], f"{self.htf}__ema_{int(self.htf_ema)}")
        return rule

    def _leave(self, up: bool) -> Column | None:
        c = self._candle()
        against = S.below if up else S.above
        if self.exit_mode == "opposite":
            return against(c["close"], self._mean(self.ema_period))
        if self.exit_mode == "ha_flip":
            return against("ha_close", "ha_open")
        if self.exit_mode == "below_ema":
            return against(c["high"] if up else c["low"], self._mean(self.exit_ema))
        return None

    def build_signals(self, bars: DataFrame) -> Rules:
        longs = (self._enter(True), self._leave(True)) if self.allow_long else (None, None)
        shorts = (self._enter(False), self._leave(False)) if self.allow_short else (None, None)
        return *longs, *shorts


@dataclass
class RsiReversal(Strategy):
    """Against stretched moves: some bars below the oversold level, out above the middle; mirrored for shorts."""

    name = "rsi_reversal"
    period: int = 14
    oversold: float = 30.0
    overbought: float = 70.0
    long_consec: int = 3
    short_consec: int = 5
    exit_mid: float = 50.0
    allow_short_signals: bool = False

    def prepare(self, bars: DataFrame) -> DataFrame:
        return add_rsi(bars, self.period)

    def build_signals(self, bars: DataFrame) -> Rules:
        r = f"rsi_{self.period}"
        longs = S.last_all_below(r, self.oversold, self.long_consec), S.above(r, self.exit_mid)
        shorts = (S.last_all_above(r, self.overbought, self.short_consec), S.below(r, self.exit_mid)) if self.allow_short_signals else (None, None)
        return *longs, *shorts


@dataclass
class MacdTrend(Strategy):
    """The difference of means crosses its signal, on its own side of zero if asked."""

    name = "macd_trend"
    fast: int = 12
    slow: int = 26
    signal: int = 9
    require_zero_side: bool = True
    allow_short_signals: bool = False

    def prepare(self, bars: DataFrame) -> DataFrame:
        return add_macd(bars, self.fast, self.slow, self.signal)

    def build_signals(self, bars: DataFrame) -> Rules:
        up, down = S.cross_up("macd", "macd_signal"), S.cross_down("macd", "macd_signal")
        side = (S.above("macd", 0), S.below("macd", 0)) if self.require_zero_side else (F.lit(True), F.lit(True))
        shorts = (down & side[1], up) if self.allow_short_signals else (None, None)
        return up & side[0], down, *shorts


@dataclass
class HeikinAshiTrend(Strategy):
    """Averaged candles of one colour in a row; out on the other colour."""

    name = "heikin_ashi"
    n_consec: int = 3
    allow_short_signals: bool = False

    def prepare(self, bars: DataFrame) -> DataFrame:
        return add_heikin_ashi(bars)

    def build_signals(self, bars: DataFrame) -> Rules:
        green, red = S.above("ha_close", "ha_open"), S.below("ha_close", "ha_open")
        shorts = (S.holds_for(red, self.n_consec), green) if self.allow_short_signals else (None, None)
        return S.holds_for(green, self.n_consec), red, *shorts


@dataclass
class SupertrendFlip(Strategy):
    """The trailing band changes sides."""

    name = "supertrend"
    period: int = 10
    multiplier: float = 3.0
    allow_short_signals: bool = False

    def prepare(self, bars: DataFrame) -> DataFrame:
        return add_supertrend(bars, self.period, self.multiplier)

    def build_signals(self, bars: DataFrame) -> Rules:
        up, down = S.cross_up("st_dir", 0), S.cross_down("st_dir", 0)
        return up, down, *((down, up) if self.allow_short_signals else (None, None))


@dataclass
class MtfTrend(Strategy):
    """A trigger on the base, a trend of five minutes, a momentum of fifteen.

    The momentum is a step on the base's grid, so it rises only on the first bar after it has changed.
    """

    name = "mtf_trend"
    fast_1m: int = 50
    trend_5m_fast: int = 50
    trend_5m_slow: int = 200
    mom_15m: int = 50
    rules: tuple[str, str] = ("5min", "15min")

    def prepare(self, bars: DataFrame) -> DataFrame:
        trend, momentum = self.rules
        return build_mtf(add_emas(bars, [self.fast_1m]), {trend: lambda d: add_emas(d, [self.trend_5m_fast, self.trend_5m_slow]), momentum: lambda d: add_emas(d, [self.mom_15m])})

    def build_signals(self, bars: DataFrame) -> Rules:
        trend, momentum = self.rules
        fast = f"ema_{self.fast_1m}"
        go = S.all_of(S.cross_up("close", fast), S.above(f"{trend}__ema_{self.trend_5m_fast}", f"{trend}__ema_{self.trend_5m_slow}"), S.rising(f"{momentum}__ema_{self.mom_15m}", 1))
        return go, S.cross_down("close", fast), None, None


@dataclass
class KeyLevelBounce(Strategy):
    """A green candle just above the last swing low; out just below the last swing high."""

    name = "key_level"
    left: int = 10
    right: int = 10
    near_pct: float = 0.15

    def prepare(self, bars: DataFrame) -> DataFrame:
        return add_swings(bars, self.left, self.right)

    def build_signals(self, bars: DataFrame) -> Rules:
        near = lambda gap: S.sure((gap / F.col("close") >= 0) & (gap / F.col("close") <= self.near_pct / 100))
        return near(F.col("close") - F.col("swing_last_low")) & S.is_green(), near(F.col("swing_last_high") - F.col("close")), None, None


REGISTRY: dict[str, type[Strategy]] = {c.name: c for c in (EmaRibbon, EmaCross, RsiReversal, MacdTrend, HeikinAshiTrend, SupertrendFlip, MtfTrend, KeyLevelBounce)}


def signal_counts(signals: DataFrame) -> DataFrame:
    """How often each signal is on, by symbol."""
    return signals.groupBy(KEY).agg(F.count(TIME).alias("n_bars"), *[F.sum(F.col(c).cast("long")).alias(c) for c in SIGNALS])
