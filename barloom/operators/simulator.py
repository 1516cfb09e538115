"""One account traded over one series of bars: an ordered fold over its signals.

Bars on which nothing is open and no entry is wanted are skipped in one step, so the work is in proportion
to the bars that positions are held for. On a bar, in this order: mark to market, margin stop-out, risk
exits (trailing first), rule exits, one entry.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import isnan, nan

import numpy as np

from barloom.operators.config import BacktestConfig

STOP, TARGET, RULE, MARGIN, FORCED = "stop_loss", "take_profit", "signal", "margin_call", "forced_close_end"
_DUST = 1e-12


@dataclass
class Trade:
    """A position from its entry on; qty is what was bought, gross and fees add up over partial closes."""

    side: int
    entry_i: int
    entry_price: float
    qty: float
    entry_fee: float
    stop_price: float
    exit_i: int = -1
    exit_price: float = nan
    gross: float = 0.0
    exit_fee: float = 0.0
    reason: str = ""
    entry_time: object = None
    exit_time: object = None

    @property
    def pnl(self) -> float:
        return self.gross - self.entry_fee - self.exit_fee


@dataclass
class _Held:
    trade: Trade
    left: float
    stop: float
    best: float
    ladder: list[tuple[float, object]]


@dataclass
class Outcome:
    trades: list[Trade]
    equity: np.ndarray
    open_trades: np.ndarray
    cash: float


class Account:
    """Cash, open positions and finished trades under one configuration."""

    def __init__(self, cfg: BacktestConfig) -> None:
        self.cfg = cfg
        self.cash = float(cfg.initial_cash)
        self.slip, self.fee = cfg.slippage_bps / 10_000.0, cfg.fee_bps / 10_000.0
        self.half = cfg.spread * 0.5
        self.held: list[_Held] = []
        self.opened: list[Trade] = []
        self.closed: list[Trade] = []

    def costs(self, price: float, qty: float) -> float:
        return price * qty * self.fee + self.cfg.commission_per_lot * (qty / self.cfg.lot)

    def worth(self, price: float) -> float:
        """Equity at a price."""
        gain = 0.0
        for h in self.held:
            gain += h.trade.side * (price - h.trade.entry_price) * h.left
        return self.cash + gain

    def margin(self) -> float:
        """What the open positions bind."""
        return sum((h.trade.entry_price * h.left / self.cfg.gearing for h in self.held), 0.0)

    def reduce(self, h: _Held, base: float, qty: float) -> float:
        """Sell (or buy back) qty at a base price with slippage and spread; gives the fill."""
        t = h.trade
        price = base * (1.0 - t.side * self.slip) - t.side * self.half
        gross = t.side * (price - t.entry_price) * qty
        fee = self.costs(price, qty)
        self.cash += gross - fee
        t.gross += gross
        t.exit_fee += fee
        return price

    def finish(self, h: _Held, base: float, i: int, reason: str) -> None:
        self._done(h, self.reduce(h, base, h.left), i, reason)

    def _done(self, h: _Held, price: float, i: int, reason: str) -> None:
        h.trade.exit_i, h.trade.exit_price, h.trade.reason = i, price, reason
        self.closed.append(h.trade)

    # ---- exits

    def stopped_out(self, px: float, equity: float, i: int) -> bool:
        """Whether the broker closed everything because equity fell to the stop-out share of the margin."""
        if not (self.cfg.margin_enabled and self.held):
            return False
        used = self.margin()
        if used <= 0 or equity > self.cfg.stop_out_level / 100.0 * used:
            return False
        for h in self.held:
            self.finish(h, px, i, MARGIN)
        self.held = []
        return True

    def _trail(self, h: _Held, high: float, low: float) -> None:
        cfg, side = self.cfg, h.trade.side
        h.best = max(h.best, high) if side > 0 else min(h.best, low)
        away = h.best * (1.0 - side * cfg.trail_value / 100.0) if cfg.trail_mode == "pct" else h.best - side * cfg.trail_value
        self._tighten(h, away)

    @staticmethod
    def _tighten(h: _Held, stop: float) -> None:
        """A stop only ever moves towards the price."""
        if isnan(h.stop) or h.trade.side * (stop - h.stop) > 0:
            h.stop = stop

    def _move_stop(self, h: _Held, level) -> None:
        entry, side = h.trade.entry_price, h.trade.side
        if level.move_stop_mode == "breakeven":
            self._tighten(h, entry)
        elif level.move_stop_mode == "entry_pct":
            self._tighten(h, entry * (1.0 + side * level.move_stop_value / 100.0))
        elif level.move_stop_mode == "price_abs":
            self._tighten(h, entry + side * level.move_stop_value)

    def risk_exit(self, h: _Held, high: float, low: float, i: int) -> bool:
        """Trail, then stop or take profit as the bar's range has it; true when nothing is left."""
        cfg, side = self.cfg, h.trade.side
        if cfg.trail_mode != "none":
            self._trail(h, high, low)
        through = lambda stop: not isnan(stop) and (low <= stop if side > 0 else high >= stop)
        reached = [x for x in h.ladder if (high >= x[0] if side > 0 else low <= x[0])]
        hit = through(h.stop)
        if hit and (not reached or cfg.intrabar_priority == "stop_first"):
            self.finish(h, h.stop, i, STOP)
            return True
        for rung in reached:
            price, level = rung
            h.ladder.remove(rung)
            qty = h.left * min(max(level.close_pct / 100.0, 0.0), 1.0)
            if qty <= _DUST:
                continue
            fill = self.reduce(h, price, qty)
            h.left -= qty
            self._move_stop(h, level)
            if h.left <= _DUST:
                self._done(h, fill, i, TARGET)
                return True
        if hit and through(h.stop):
            self.finish(h, h.stop, i, STOP)
            return True
        return False

    # ---- entries

    def _plain_stop(self, entry: float, side: int, mode: str, value: float) -> float:
        return entry * (1.0 - side * (value / 100.0)) if mode == "entry_pct" else entry - side * value

    def stop_for(self, entry: float, side: int, ref: float) -> float:
        """The stop of a new position; a reference level that is unusable or too far gives the fallback."""
        cfg = self.cfg
        if not cfg.exit_enabled or cfg.sl_mode == "none":
            return nan
        if cfg.sl_mode != "ref_col":
            return self._plain_stop(entry, side, cfg.sl_mode, cfg.sl_value)
        if ref > 0.0:
            stop = ref * (1.0 - side * (cfg.sl_buffer_pct / 100.0))
            risk = side * (entry - stop) / entry * 100.0
            if side * (entry - stop) > 0 and not (cfg.sl_max_ref_risk_pct > 0.0 and risk > cfg.sl_max_ref_risk_pct):
                return stop
        return self._plain_stop(entry, side, cfg.sl_fallback_mode, cfg.sl_fallback_value)

    def size_for(self, entry: float, stop: float, equity: float) -> float:
        cfg = self.cfg
        if cfg.sizing_mode == "lots":
            return cfg.sizing_value * cfg.lot
        most = equity * (cfg.max_notional_pct / 100.0)
        if not cfg.allow_leverage and most > self.cash:
            most = self.cash
        if not cfg.exit_enabled or cfg.sizing_mode == "cash":
            spend = cfg.trade_cash
            if cfg.exit_enabled and not cfg.margin_enabled:
                spend = min(spend, most)
            return spend / entry
        if isnan(stop) or stop == entry:
            return 0.0
        risk = equity * (cfg.sizing_value / 100.0) if cfg.sizing_mode == "risk_pct_equity" else cfg.sizing_value
        qty = risk / abs(entry - stop)
        return qty if cfg.margin_enabled else min(qty, most / entry)

    def _ladder(self, entry: float, side: int, stop: float) -> list[tuple[float, object]]:
        out = []
        for level in self.cfg.targets if self.cfg.exit_enabled else ():
            if level.mode == "entry_pct":
                price = entry * (1.0 + side * level.value / 100.0)
            elif level.mode == "price_abs":
                price = entry + side * level.value
            elif level.mode == "rr" and not isnan(stop):
                price = entry + side * abs(entry - stop) * level.value
            else:
                continue
            out.append((price, level))
        return out

    def enter(self, side: int, px: float, ref: float, equity: float, i: int) -> None:
        """Open a position if it can be sized and paid for."""
        entry = px * (1.0 + side * self.slip) + side * self.half
        stop = self.stop_for(entry, side, ref)
        qty = self.size_for(entry, stop, equity)
        if not qty > 0.0:
            return
        fee = self.costs(entry, qty)
        if fee > self.cash:
            return
        if self.cfg.margin_enabled and entry * qty / self.cfg.gearing > self.worth(px) - self.margin():
            return
        self.cash -= fee
        trade = Trade(side, i, entry, qty, fee, stop)
        self.opened.append(trade)
        self.held.append(_Held(trade, qty, stop, entry, self._ladder(entry, side, stop)))


class Simulation:
    """An account fed with a series piece by piece. Only what is open is carried from one piece to the next."""

    def __init__(self, cfg: BacktestConfig) -> None:
        self.cfg, self.account = cfg, Account(cfg)
        self.offset = 0
        self.last: tuple[float, int, object] | None = None

    def feed(self, bars: dict[str, np.ndarray], signals: dict[str, np.ndarray], times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, list[Trade]]:
        """Equity and number of open trades of each bar, and the trades that ended.

        bars: close, high, low and, for ref_col stops, ref_long and ref_short. signals: four boolean arrays. A
        bar whose close is NaN shows the cash as equity and changes nothing.
        """
        cfg, account, base = self.cfg, self.account, self.offset
        close = np.asarray(bars["close"], float)
        n = len(close)
        known = ~np.isnan(close)
        high = np.where(np.isnan(bars["high"]), close, bars["high"])
        low = np.where(np.isnan(bars["low"]), close, bars["low"])
        none = np.full(n, nan)
        ref_long, ref_short = bars.get("ref_long", none), bars.get("ref_short", none)
        go_long = np.asarray(signals["entry_long"], bool)
        go_short = np.asarray(signals["entry_short"], bool) & cfg.allow_short
        wanted = np.flatnonzero((go_long | go_short) & known)
        equity, counts = np.empty(n), np.zeros(n, np.int64)
        rule = not cfg.exit_enabled or cfg.allow_rule_close
        leave = {1: np.asarray(signals["exit_long"], bool).tolist(), -1: np.asarray(signals["exit_short"], bool).tolist()}
        px, hi, lo, want_long, want_short, ok = close.tolist(), high.tolist(), low.tolist(), go_long.tolist(), go_short.tolist(), known.tolist()
        able = cfg.max_open_trades > 0 and cfg.trade_cash > 0.0
        # without margin and trailing stops a position waits for a known price, a signal, its stop or a target
        waits = not cfg.margin_enabled and (cfg.trail_mode == "none" or not cfg.exit_enabled)
        no_exit = np.zeros(n, bool)
        marks = {s: np.asarray(signals["exit_long" if s > 0 else "exit_short"], bool) if rule else no_exit for s in (1, -1)}
        wants = go_long | go_short
        i = at = 0
        while i < n:
            if not account.held:  # on to the next entry
                while at < len(wanted) and wanted[at] < i:
                    at += 1
                to = int(wanted[at]) if at < len(wanted) and able and account.cash > 0.0 else n
                if to > i:
                    equity[i:to] = account.cash
                    i = to
                    continue
            elif waits and (to := self._wait(i, close, high, low, known, marks, wants if able else no_exit)) > i:
                gain = np.zeros(to - i)
                for h in account.held:
                    gain += h.trade.side * (close[i:to] - h.trade.entry_price) * h.left
                equity[i:to] = account.cash + gain
                counts[i:to] = len(account.held)
                i = to
                continue
            p = px[i]
            if not ok[i]:
                equity[i] = account.cash
                counts[i] = len(account.held)
                i += 1
                continue
            now = account.worth(p)
            equity[i] = now
            if account.held:
                if account.stopped_out(p, now, base + i):
                    i += 1
                    continue
                if cfg.exit_enabled:
                    account.held = [h for h in account.held if not account.risk_exit(h, hi[i], lo[i], base + i)]
                if rule:
                    rest = []
                    for h in account.held:
                        if leave[h.trade.side][i]:
                            account.finish(h, p, base + i, RULE)
                        else:
                            rest.append(h)
                    account.held = rest
            if able and (want_long[i] or want_short[i]) and len(account.held) < cfg.max_open_trades and account.cash > 0.0:
                side = 1 if want_long[i] else -1
                account.enter(side, p, float(ref_long[i] if side > 0 else ref_short[i]), now, base + i)
            counts[i] = len(account.held)
            i += 1
        valid = np.flatnonzero(known)
        if len(valid):
            k = int(valid[-1])
            self.last = (px[k], base + k, None if times is None else times[k])
        self.offset += n
        return equity, counts, self._ended(times, base)

    def _wait(self, i: int, close: np.ndarray, high: np.ndarray, low: np.ndarray, known: np.ndarray, leave: dict[int, np.ndarray], wants: np.ndarray) -> int:
        """The first bar from i on at which anything can happen to what is held, or a new entry."""
        held, n, width = self.account.held, len(close), 32
        room = len(held) < self.cfg.max_open_trades
        sides = {h.trade.side for h in held}
        while i < n:
            part = slice(i, min(n, i + width))
            event = ~known[part]
            for s in sides:
                event |= leave[s][part]
            if room:
                event |= wants[part]
            if self.cfg.exit_enabled:
                for h in held:
                    adverse, good = (low[part], high[part]) if h.trade.side > 0 else (-high[part], -low[part])
                    event |= adverse <= h.trade.side * h.stop  # never, where there is no stop
                    for price, _ in h.ladder:
                        event |= good >= h.trade.side * price
            if event.any():
                return i + int(event.argmax())
            i, width = part.stop, min(2 * width, 8192)
        return n

    def _ended(self, times: np.ndarray | None, base: int) -> list[Trade]:
        account = self.account
        if times is not None:
            for t in account.opened:
                t.entry_time = times[t.entry_i - base]
            for t in account.closed:
                if t.exit_time is None:
                    t.exit_time = times[t.exit_i - base]
        ended, account.opened, account.closed = account.closed, [], []
        return ended

    def finish(self) -> list[Trade]:
        """Close what is open at the last known price."""
        for h in self.account.held:
            price, i, time = self.last
            self.account.finish(h, price, i, FORCED)
            h.trade.exit_time = time
        self.account.held = []
        return self._ended(None, 0)


def simulate(bars: dict[str, np.ndarray], signals: dict[str, np.ndarray], cfg: BacktestConfig, times: np.ndarray | None = None) -> Outcome:
    """A whole series at once; trades in order of entry."""
    run = Simulation(cfg)
    equity, counts, trades = run.feed(bars, signals, times)
    trades = sorted(trades + run.finish(), key=lambda t: t.entry_i)
    return Outcome(trades, equity, counts, run.account.cash)
