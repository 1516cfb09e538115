"""The searches that come with the library."""

from __future__ import annotations

from collections.abc import Callable

from barloom.operators.config import BacktestConfig
from barloom.operators.search import Experiment
from barloom.plans.strategies import EmaRibbon, MtfTrend

# Accounts, parameter spaces and objectives of the experiments.
_BASE = BacktestConfig(initial_cash=10_000, fee_bps=8, slippage_bps=1.5, exit_enabled=True, sl_mode="entry_pct", sl_value=0.6, tp_mode="rr", tp_value=2.0, sizing_mode="risk_pct_equity", sizing_value=1.0)
_MEANS = {"fast_1m": [20, 50, 100], "trend_5m_fast": [20, 50], "trend_5m_slow": [100, 200], "mom_15m": [50, 100]}
_ENTRY = {"fast": [50], "slow": [200], "confirm_n": [5]}
_SESSIONS = [None, "london", "newyork", "tokyo", "sydney"]
_EXITS = {"sl_value": [0.3, 0.5, 0.75, 1.0, 1.5], "tp_value": [1.0, 1.5, 2.0, 3.0], "tp_mode": ["rr"]}


def ema_mtf() -> Experiment:
    """Means of three timeframes."""
    return Experiment("ema_mtf", MtfTrend, _BASE, "Which means of three timeframes go together.", strategy_space=_MEANS, min_trades=20, valid=lambda p: p["trend_5m_fast"] < p["trend_5m_slow"])


def session_timing() -> Experiment:
    """Sessions of entry."""
    return Experiment("session_timing", EmaRibbon, _BASE, "In which session entries pay most.", strategy_space=_ENTRY | {"session": _SESSIONS}, metric="total_return_pct", min_trades=10)


def exit_design() -> Experiment:
    """Stops and targets under one set of entries; only they close trades."""
    account = _BASE.replace(sl_value=0.0, tp_mode="none", tp_value=0.0, allow_rule_close=False)
    return Experiment("exit_design", EmaRibbon, account, "Which stop and target go with an entry.", strategy_space=_ENTRY, cfg_space=_EXITS, metric="sharpe", min_trades=20)


EXPERIMENTS: dict[str, Callable[[], Experiment]] = {f.__name__: f for f in (ema_mtf, session_timing, exit_design)}
