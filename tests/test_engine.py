"""The simulator against fixed results, hand-computed costs and margin rules; one run through Spark."""

import numpy as np
import pandas as pd
import pytest

from barloom.operators.backtest import run_backtest
from barloom.operators.config import BacktestConfig, TakeProfit
from barloom.operators.simulator import simulate
from barloom.operators.statistics import compute_stats
from tests.frames import series, to_spark, walk

RISK = dict(fee_bps=8, slippage_bps=1.5, exit_enabled=True, sl_mode="entry_pct", sl_value=0.6, sizing_mode="risk_pct_equity", sizing_value=1.0)


def crosses(pdf: pd.DataFrame) -> dict:
    gap = (pdf["close"] - pdf["close"].ewm(span=20, adjust=False, min_periods=20).mean()).to_numpy()
    before = np.concatenate([[np.nan], gap[:-1]])
    none = np.zeros(len(pdf), bool)
    return {"entry_long": (before <= 0) & (gap > 0), "exit_long": (before >= 0) & (gap < 0), "entry_short": none, "exit_short": none}


def run(pdf, cfg, signals=None, **refs):
    bars = {c: pdf[c].to_numpy(float) for c in ("close", "high", "low")} | refs
    return simulate(bars, signals or crosses(pdf), cfg)


# Seeded series, accounts, and what must come of them.
A0, A3 = (0.001, 0.0006), (0.0012, 0.0007)
GOLDEN = {
    "signal only": (walk(3000, 0, *A0), BacktestConfig(fee_bps=10, slippage_bps=1), 200, 5187.067737),
    "stop and target": (walk(3000, 3, *A0), BacktestConfig(**(RISK | {"sl_value": 0.5}), tp_mode="rr", tp_value=2.0, allow_rule_close=False), 49, 9398.038573),
    "ladder, breakeven": (walk(4000, 2, *A3), BacktestConfig(**RISK, take_profits=(TakeProfit("entry_pct", 0.4, 50, "breakeven"), TakeProfit("entry_pct", 1.0, 100)), allow_rule_close=False), 101, 7926.780413),
    "ladder, rr": (walk(4000, 4, *A3), BacktestConfig(**RISK, take_profits=(TakeProfit("rr", 1.0, 50), TakeProfit("rr", 2.5, 100)), allow_rule_close=False), 60, 8670.953423),
    "reference stop": (walk(4000, 5, *A3), BacktestConfig(**(RISK | {"sl_mode": "ref_col", "sl_value": 0.0}), sl_buffer_pct=0.05, sl_fallback_value=0.8, sl_ref_long_col="ref", take_profits=(TakeProfit("rr", 2.0, 100),)), 266, 6936.231323),
}


@pytest.mark.parametrize("name", GOLDEN)
def test_golden(name):
    pdf, cfg, n, cash = GOLDEN[name]
    refs = {"ref_long": pdf["low"].rolling(30, min_periods=1).min().to_numpy()} if cfg.sl_ref_long_col else {}
    out = run(pdf, cfg, **refs)
    assert len(out.trades) == n
    assert out.cash == pytest.approx(cash, abs=1e-3)


def once(n=20, at=1, off=2):
    none = np.zeros(n, bool)
    enter, leave = none.copy(), none.copy()
    enter[at] = True
    if off is not None:
        leave[off] = True
    return {"entry_long": enter, "exit_long": leave, "entry_short": none, "exit_short": none}


@pytest.mark.parametrize(
    ("price", "cfg", "pnl"),
    [
        (100.0, dict(sizing_mode="lots", sizing_value=1, contract_size=1, spread=0.5), -0.5),
        (100.0, dict(sizing_mode="lots", sizing_value=2, contract_size=100, commission_per_lot=3.5), -14.0),
        (1.1, dict(sizing_mode="lots", sizing_value=1, contract_size=100_000, spread=0.00012), -12.0),
        (1.1, dict(sizing_mode="lots", sizing_value=0.1, contract_size=100_000, spread=0.00012), -1.2),
        (100.0, dict(), 0.0),
    ],
)
def test_costs(price, cfg, pnl):
    out = run(series([price] * 20), BacktestConfig(initial_cash=1e6, **cfg), once())
    assert out.trades[0].pnl == pytest.approx(pnl, abs=1e-9)


def test_margin_stop_out():
    pdf = series(np.concatenate([[100.0] * 50, np.linspace(100, 80, 50)]))
    pdf["high"], pdf["low"] = pdf["close"] * 1.0002, pdf["close"] * 0.9998
    out = run(pdf, BacktestConfig(initial_cash=1000, sizing_mode="lots", sizing_value=1, contract_size=100, leverage=100, margin_enabled=True, stop_out_level=50), once(100, 1, None))
    assert [t.reason for t in out.trades] == ["margin_call"]
    assert 88 <= out.trades[0].exit_price <= 92


@pytest.mark.parametrize(("cash", "lots", "leverage", "qty"), [(50, 1, 10, None), (10_000, 0.5, 100, 50), (1000, 2, 100, 200)])
def test_margin_sizes(cash, lots, leverage, qty):
    out = run(series([100.0] * 60), BacktestConfig(initial_cash=cash, sizing_mode="lots", sizing_value=lots, contract_size=100, leverage=leverage, margin_enabled=True), once(60, 1, None))
    assert [t.qty for t in out.trades] == ([] if qty is None else [qty])


def test_take_profit_first_rechecks_the_moved_stop():
    pdf = series([100, 100, 100], high=[100, 100, 102], low=[100, 100, 98])
    cfg = BacktestConfig(exit_enabled=True, sl_mode="entry_pct", sl_value=1, take_profits=(TakeProfit("entry_pct", 1, 50, "breakeven"),), intrabar_priority="take_profit_first", allow_rule_close=False)
    out = run(pdf, cfg, once(3, 1, None))
    assert out.trades[0].reason == "stop_loss"
    assert out.trades[0].exit_price == pytest.approx(100)
    assert out.trades[0].gross == pytest.approx(50)


def test_trailing_ratchets_on_the_same_bar():
    pdf = series([100, 100, 109, 104], high=[100, 100, 110, 105], low=[100, 100, 108, 103])
    out = run(pdf, BacktestConfig(exit_enabled=True, trail_mode="pct", trail_value=5, allow_rule_close=False), once(4, 1, None))
    assert out.trades[0].exit_i == 3
    assert out.trades[0].exit_price == pytest.approx(104.5)


def test_unknown_prices_and_no_bars():
    pdf = series([100, np.nan, 101, np.nan])
    out = run(pdf, BacktestConfig(), once(4, 0, None))
    assert out.trades[0].exit_i == 2 and out.trades[0].reason == "forced_close_end"
    assert out.equity[1] == out.equity[3] == 10_000 and list(out.open_trades) == [1, 1, 1, 1]
    assert simulate({"close": np.zeros(0), "high": np.zeros(0), "low": np.zeros(0)}, once(0, slice(0, 0), None), BacktestConfig()).cash == 10_000


def test_bad_settings():
    with pytest.raises(ValueError):
        BacktestConfig(sl_mode="percent")
    with pytest.raises(ValueError):
        BacktestConfig().replace(stop=1)
    assert BacktestConfig(max_open_trades=4).trade_cash == 2500
    assert len(BacktestConfig(take_profits=tuple(TakeProfit("rr", k) for k in range(1, 9))).targets) == 6


def test_spark_runs_symbols_apart(spark):
    pdf, cfg, n, cash = GOLDEN["signal only"]
    parts = []
    for k, symbol in enumerate(("A", "B")):
        part = pdf.assign(symbol=symbol, **{c: v for c, v in crosses(pdf).items() if c.endswith("long")})
        part[["open", "high", "low", "close"]] *= 1 + k
        parts.append(part)
    result = run_backtest(to_spark(spark, pd.concat(parts)), cfg)
    stats = compute_stats(result).toPandas().set_index("symbol")
    assert stats["num_trades"].tolist() == [n, n]
    assert stats["final_cash"].tolist() == pytest.approx([cash, cash], abs=1e-3)
    assert result.equity.count() == 2 * len(pdf)
    trades = result.trades.where("symbol = 'A'").toPandas()
    assert trades["exit_time"].notna().all() and set(trades["side"]) == {"long"}
    own = run(pdf, cfg)
    a = stats.loc["A"]
    pnl = np.array([t.pnl for t in own.trades])
    move = np.diff(own.equity) / own.equity[:-1]
    assert a["sharpe"] == pytest.approx(move.mean() / move.std(ddof=1) * np.sqrt(365.25 * 1440))
    assert a["profit_factor"] == pytest.approx(pnl[pnl > 0].sum() / -pnl[pnl < 0].sum())
    assert a["median_pnl"] == pytest.approx(np.median(pnl))


def test_missing_columns(spark):
    with pytest.raises(ValueError):
        run_backtest(spark.createDataFrame([("S", 1.0)], "symbol string, close double"), BacktestConfig())


def test_pieces_give_the_same_as_the_whole():
    from barloom.operators.simulator import Simulation

    pdf, cfg, n, cash = GOLDEN["ladder, breakeven"]
    signals = crosses(pdf)
    run_ = Simulation(cfg)
    times = pdf["open_time"].to_numpy()
    trades, equity = [], []
    for a in range(0, len(pdf), 37):
        part = slice(a, a + 37)
        e, _, ended = run_.feed({c: pdf[c].to_numpy(float)[part] for c in ("close", "high", "low")}, {k: v[part] for k, v in signals.items()}, times[part])
        equity.append(e)
        trades += ended
    trades += run_.finish()
    assert len(trades) == n and run_.account.cash == pytest.approx(cash, abs=1e-3)
    np.testing.assert_array_equal(np.concatenate(equity), run(pdf, cfg).equity)
    assert all(t.entry_time == times[t.entry_i] and t.exit_time == times[t.exit_i] for t in trades)


def test_small_batches_through_spark(spark):
    pdf, cfg, n, cash = GOLDEN["signal only"]
    table = to_spark(spark, pdf.assign(**{c: v for c, v in crosses(pdf).items() if c.endswith("long")}))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        result = run_backtest(table, cfg)
        assert result.trades.count() == n and result.equity.count() == len(pdf)
        assert result.accounts.first()["final_cash"] == pytest.approx(cash, abs=1e-3)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
