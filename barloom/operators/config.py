"""Settings of a simulated account: costs, exits, sizing, margin."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields

#: The choices of each mode.
STOP_MODES = ("none", "entry_pct", "price_abs", "ref_col")
TARGET_MODES = ("none", "entry_pct", "price_abs", "rr")
MOVE_MODES = ("none", "breakeven", "entry_pct", "price_abs")
TRAIL_MODES = ("none", "pct", "price_abs")
SIZING_MODES = ("cash", "risk_pct_equity", "risk_amount", "lots")
FALLBACK_MODES = ("entry_pct", "price_abs")
PRIORITIES = ("stop_first", "take_profit_first")
#: Further take-profit levels are ignored.
MAX_TARGETS = 6


@dataclass(frozen=True)
class TakeProfit:
    """A level at which close_pct percent of what is left is closed, and where the stop moves then.

    The level's price is fixed at entry; rr counts in distances to the stop set at entry.
    """

    mode: str
    value: float
    close_pct: float = 100.0
    move_stop_mode: str = "none"
    move_stop_value: float = 0.0


@dataclass(frozen=True)
class BacktestConfig:
    """An account. Percentages are in percent, basis points are a side, spread is in units of price."""

    # account
    initial_cash: float = 10_000.0
    cash_per_trade: float | None = None
    max_open_trades: int = 1
    allow_short: bool = True
    # costs
    fee_bps: float = 0.0
    slippage_bps: float = 0.0
    spread: float = 0.0
    commission_per_lot: float = 0.0
    # exits: all but rule closes need exit_enabled
    exit_enabled: bool = False
    sl_mode: str = "none"
    sl_value: float = 0.0
    sl_buffer_pct: float = 0.0
    sl_max_ref_risk_pct: float = 0.0
    sl_fallback_mode: str = "entry_pct"
    sl_fallback_value: float = 0.75
    sl_ref_long_col: str | None = None
    sl_ref_short_col: str | None = None
    trail_mode: str = "none"
    trail_value: float = 0.0
    take_profits: tuple[TakeProfit, ...] = ()
    tp_mode: str = "none"
    tp_value: float = 0.0
    allow_rule_close: bool = True
    intrabar_priority: str = "stop_first"
    # sizing
    sizing_mode: str = "cash"
    sizing_value: float = 1.0
    max_notional_pct: float = 100.0
    allow_leverage: bool = False
    # margin
    margin_enabled: bool = False
    leverage: float = 1.0
    contract_size: float = 1.0
    stop_out_level: float = 0.0
    margin_call_level: float = 0.0

    def __post_init__(self) -> None:
        choices = {"sl_mode": STOP_MODES, "sl_fallback_mode": FALLBACK_MODES, "trail_mode": TRAIL_MODES, "tp_mode": TARGET_MODES, "sizing_mode": SIZING_MODES, "intrabar_priority": PRIORITIES}
        for name, allowed in choices.items():
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {', '.join(allowed)}, not {getattr(self, name)!r}")
        for t in self.take_profits:
            if t.mode not in TARGET_MODES or t.move_stop_mode not in MOVE_MODES:
                raise ValueError(f"bad take-profit {t}")

    @property
    def trade_cash(self) -> float:
        """What a trade may spend when sized by cash."""
        return float(self.initial_cash) / max(int(self.max_open_trades), 1) if self.cash_per_trade is None else float(self.cash_per_trade)

    @property
    def targets(self) -> tuple[TakeProfit, ...]:
        """The ladder of take-profits, or the single one of tp_mode."""
        own = self.take_profits or ((TakeProfit(self.tp_mode, self.tp_value),) if self.tp_mode != "none" else ())
        return own[:MAX_TARGETS]

    @property
    def lot(self) -> float:
        return float(self.contract_size) if self.contract_size > 0 else 1.0

    @property
    def gearing(self) -> float:
        return float(self.leverage) if self.leverage > 0 else 1.0

    def to_dict(self) -> dict:
        return asdict(self)

    def replace(self, **changes) -> BacktestConfig:
        """A copy with some settings changed; unknown names are errors."""
        known = {f.name: getattr(self, f.name) for f in fields(self)}
        if bad := set(changes) - set(known):
            raise ValueError(f"unknown settings: {', '.join(sorted(bad))}")
        return BacktestConfig(**(known | changes))
