"""What keeps long series and large stores workable: rolling values, quantiles, linked trades, as-of joins by block,
commits."""

import re
import threading
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions import indicators as I
from barloom.functions import signals as S
from barloom.operators import backtest, linked, quantiles, rolling
from barloom.operators import timeframe as R
from barloom.operators.config import BacktestConfig
from barloom.operators.simulator import simulate
from barloom.sources import commits
from barloom.sources import providers as P
from barloom.sources import store as ST
from tests.frames import column, series, to_spark, walk

# ---- rolling values


@pytest.mark.parametrize("short", [1, 32])
def test_rolling_matches_pandas(spark, monkeypatch, short):
    monkeypatch.setattr(rolling, "SHORT", short)
    pdf = walk(700, 4)
    pdf.loc[100:130, "close"] = np.nan
    both = pd.concat([pdf, walk(90, 6).assign(symbol="T")])
    sizes = (2, 7, 50, 64)
    df = rolling.rolling(to_spark(spark, both), {f"{kind}_{n}": (kind, F.col("close"), n) for n in sizes for kind in ("mean", "min", "max")})
    got = column(df, *[f"{kind}_{n}" for n in sizes for kind in ("mean", "min", "max")])
    for symbol, own in both.groupby("symbol"):
        mine = got[got["symbol"] == symbol].reset_index(drop=True)
        for n in sizes:
            for kind in ("mean", "min", "max"):
                want = getattr(own["close"].rolling(n), kind)().reset_index(drop=True)
                assert (mine[f"{kind}_{n}"].isna() == want.isna()).all()
                np.testing.assert_allclose(mine[f"{kind}_{n}"].dropna(), want.dropna(), rtol=1e-12)


def test_long_means_do_not_drift(spark):
    pdf = series(np.concatenate([[1e15] * 40, np.full(400, 0.1)]))
    got = column(I.add_smas(to_spark(spark, pdf), [40]), "sma_40")["sma_40"]
    assert got.iloc[79] == pytest.approx(0.1, rel=1e-12) and got.iloc[-1] == pytest.approx(0.1, rel=1e-12)


@pytest.mark.parametrize("short", [1, 32])
@pytest.mark.parametrize(("left", "right"), [(2, 3), (5, 0), (20, 20)])
def test_swings_by_force(spark, monkeypatch, short, left, right):
    monkeypatch.setattr(rolling, "SHORT", short)
    pdf = walk(300, 9).round(2)
    got = column(I.add_swings(to_spark(spark, pdf), left, right), "swing_high", "swing_low", "swing_last_high")
    high, low = pdf["high"].to_numpy(), pdf["low"].to_numpy()
    last = None
    for i in range(len(pdf)):
        at = i - right
        whole = at - left >= 0
        up = whole and high[at] == high[at - left : i + 1].max()
        assert got["swing_high"][i] == up and got["swing_low"][i] == (whole and low[at] == low[at - left : i + 1].min())
        last = high[at] if up else last
        assert (got["swing_last_high"][i] == last) if last is not None else pd.isna(got["swing_last_high"][i])


def test_counts_of_bars_use_growing_frames_only(spark):
    df = to_spark(spark, walk(200, 1))
    out = df.select(S.last_all_above("close", 100, 50).alias("a"), S.prev_all_below("close", 100, 40).alias("b"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    frames = set(re.findall(r"specifiedwindowframe\(([^)]*)\)", plan))
    assert frames and all("unboundedpreceding" in f for f in frames)


# ---- quantiles


@pytest.mark.parametrize("make", [lambda r: r.normal(size=5000), lambda r: np.exp(r.normal(0, 30, 3000)), lambda r: r.integers(0, 4, 2000).astype(float), lambda r: np.concatenate([np.zeros(999), [1e300, -1e300]]), lambda r: np.array([3.0]), lambda r: np.concatenate([r.random(100), [np.inf, np.inf, -np.inf]])])
def test_quantiles_are_exact(spark, monkeypatch, make):
    monkeypatch.setattr(quantiles, "FEW", 300)
    monkeypatch.setattr(quantiles, "ACCURACY", 50)
    x = make(np.random.default_rng(7))
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "x double")
    shares = [0.0, 0.1, 1 / 3, 0.5, 2 / 3, 1.0]
    got, n = quantiles.exact_quantiles(df, F.col("x"), shares)
    assert n == len(x)
    y = np.sort(x)
    for q, v in zip(shares, got, strict=True):
        place = q * (len(y) - 1)
        a, b = int(np.floor(place)), int(np.ceil(place))
        assert v == (y[a] if a == b else (b - place) * y[a] + (place - a) * y[b])


def test_quantiles_of_nothing(spark):
    assert quantiles.exact_quantiles(spark.createDataFrame([(None,)], "x double"), F.col("x"), [0.5]) == ([None], 0)


# ---- trades as linked intervals


def random_signals(n, seed, share):
    r = np.random.default_rng(seed)
    pdf = walk(n, seed)
    pdf.loc[r.random(n) < 0.03, "close"] = np.nan
    return pdf.assign(**{c: r.random(n) < share for c in backtest.SIGNALS})


FREE = [
    BacktestConfig(fee_bps=10, slippage_bps=2, spread=0.01),
    BacktestConfig(allow_short=False, cash_per_trade=2500.0, commission_per_lot=0.5, contract_size=10),
    BacktestConfig(exit_enabled=True, sizing_mode="lots", sizing_value=0.3, contract_size=100, fee_bps=3),
]


@pytest.mark.parametrize("size", [7, 4096])
@pytest.mark.parametrize("cfg", FREE)
def test_linked_trades_equal_the_fold(spark, monkeypatch, cfg, size):
    monkeypatch.setattr(linked, "SIZE", size)
    assert linked.cash_free(cfg)
    frames = [random_signals(400, 1, 0.2).assign(symbol="A"), random_signals(90, 2, 0.02).assign(symbol="B"), random_signals(40, 3, 0.0).assign(symbol="C"), random_signals(60, 4, 0.5).assign(symbol="D", close=np.nan)]
    frames[0]["open_time"] = pd.date_range("2025-01-25", periods=400, freq="1h")
    result = backtest.run_backtest(to_spark(spark, pd.concat(frames)), cfg)
    assert isinstance(result, backtest.LinkedResult)
    trades, equity, accounts = (x.toPandas() for x in (result.trades, result.equity, result.accounts))
    assert "MapInPandas" not in result.trades._jdf.queryExecution().toString()
    for pdf in frames:
        symbol = pdf["symbol"].iloc[0]
        want = simulate({c: pdf[c].to_numpy(float) for c in ("close", "high", "low")}, {c: pdf[c].to_numpy(bool) for c in backtest.SIGNALS}, cfg, pdf["open_time"].to_numpy())
        mine = trades[trades["symbol"] == symbol].sort_values("entry_i").reset_index(drop=True)
        assert mine["entry_i"].tolist() == [t.entry_i for t in want.trades] and mine["exit_i"].tolist() == [t.exit_i for t in want.trades]
        assert mine["close_reason"].tolist() == [t.reason for t in want.trades] and mine["side"].tolist() == ["long" if t.side > 0 else "short" for t in want.trades]
        for c, f in (("entry_price", lambda t: t.entry_price), ("exit_price", lambda t: t.exit_price), ("qty", lambda t: t.qty), ("pnl", lambda t: t.pnl), ("gross_pnl", lambda t: t.gross), ("fees", lambda t: t.entry_fee + t.exit_fee)):
            np.testing.assert_allclose(mine[c], [f(t) for t in want.trades], rtol=1e-9, atol=1e-9)
        assert mine["entry_time"].tolist() == [pd.Timestamp(t.entry_time) for t in want.trades] and mine["exit_time"].tolist() == [pd.Timestamp(t.exit_time) for t in want.trades]
        line = equity[equity["symbol"] == symbol].sort_values("t")
        np.testing.assert_allclose(line["equity"], want.equity, rtol=1e-11)
        assert line["open_trades"].tolist() == want.open_trades.tolist()
        top = np.maximum.accumulate(want.equity)
        np.testing.assert_allclose(line["drawdown"], (top - want.equity) / top, atol=1e-11)
        row = accounts[accounts["symbol"] == symbol].iloc[0]
        assert row["final_cash"] == pytest.approx(want.cash, rel=1e-11) and row["n_bars"] == len(pdf)


@pytest.mark.parametrize(
    ("cfg", "folded"),
    [
        (BacktestConfig(initial_cash=1000.0, cash_per_trade=60_000.0, fee_bps=50), False),  # a fee that is never below the cash
        (BacktestConfig(initial_cash=1000.0, cash_per_trade=1e6, fee_bps=0, spread=0.1), False),  # no cash left
        (BacktestConfig(initial_cash=59.9, sizing_mode="lots", sizing_value=1, contract_size=300, fee_bps=20), True),
    ],
)
def test_accounts_that_run_out_of_cash(spark, cfg, folded):
    ruined = random_signals(300, 5, 0.3).assign(symbol="A")
    fine = random_signals(300, 6, 0.0).assign(symbol="B")
    if folded:  # the first entry's fee is just above the cash, a later one's below
        first = ruined[(ruined["entry_long"] | ruined["entry_short"]) & ruined["close"].notna()]["close"].iloc[0]
        cfg = cfg.replace(initial_cash=float(first * 300 * 0.002 * 0.9999))
    result = backtest.run_backtest(to_spark(spark, pd.concat([ruined, fine])), cfg)
    want = simulate({c: ruined[c].to_numpy(float) for c in ("close", "high", "low")}, {c: ruined[c].to_numpy(bool) for c in backtest.SIGNALS}, cfg, ruined["open_time"].to_numpy())
    got = result.trades.toPandas().sort_values("entry_i")
    assert got["entry_i"].tolist() == [t.entry_i for t in want.trades] and len(got) < 40
    assert (result._linked.refused is not None) == folded
    cash = {r.symbol: r.final_cash for r in result.accounts.collect()}
    assert cash["A"] == pytest.approx(want.cash) and cash["B"] == cfg.initial_cash
    line = result.equity.where("symbol = 'A'").toPandas().sort_values("t")
    np.testing.assert_allclose(line["equity"], want.equity, rtol=1e-9)
    assert line["open_trades"].tolist() == want.open_trades.tolist()


def test_cash_free_accounts():
    assert not linked.cash_free(BacktestConfig(max_open_trades=2))
    assert not linked.cash_free(BacktestConfig(exit_enabled=True, sl_mode="entry_pct", sl_value=1, sizing_mode="lots"))
    assert not linked.cash_free(BacktestConfig(exit_enabled=True))
    assert not linked.cash_free(BacktestConfig(margin_enabled=True))


# ---- as-of joins


@pytest.mark.parametrize("block", ["hour", "month", None])
def test_asof_by_blocks(spark, block):
    pdf = walk(400, 3).drop(index=range(100, 280))
    left = to_spark(spark, pdf)
    right = to_spark(spark, walk(400, 5).iloc[::61]).withColumn("v", F.when(F.col("close") % 2 > 1, F.col("close"))).select("symbol", "open_time", "v", F.col("low").alias("u"))
    got = column(R.asof_join(left, right, ["v", "u"], block=block), "v", "u")
    want = pd.merge_asof(pdf[["open_time"]], right.toPandas().sort_values("open_time")[["open_time", "v", "u"]], on="open_time")
    assert got["v"].isna().tolist() == want["v"].isna().tolist() and 0 < got["v"].isna().sum() < len(got)
    np.testing.assert_allclose(got["u"].to_numpy(float), want["u"].to_numpy(float))


def test_asof_of_one_symbol_is_many_tasks(spark):
    bars = spark.range(20_000).select(F.lit("S").alias("symbol"), F.expr("timestamp_ntz'2025-01-01' + make_dt_interval(0, cast(id as int))").alias("open_time"), F.col("id").cast("double").alias("v"))
    out = R.asof_join(bars.drop("v"), bars.where("v % 7 = 0"), ["v"], block="day")
    plan = out._jdf.queryExecution().toString()
    assert "hashpartitioning(_key" in plan and "_block" in plan.split("hashpartitioning(_key")[1][:40]
    assert out.where("v <> floor(hour(open_time) * 0 + v)").count() == 0 and out.where("v is null").count() == 0


# ---- commits


def test_two_writers_of_one_month_both_survive(spark, tmp_path):
    store = ST.BarStore(spark, str(tmp_path / "bars"))
    pdf = walk(400, 2)
    store.write(to_spark(spark, pdf.iloc[:10]), "1m")
    both = threading.Barrier(4)
    put = commits.CommitLog.put
    errors, met = [], set()

    def late(self, rows, order):
        commit = put(self, rows, order)
        if threading.get_ident() not in met:
            met.add(threading.get_ident())
            both.wait(120)  # all have read the same version before any publishes
        return commit

    def write(k):
        try:
            ST.BarStore(spark, str(tmp_path / "bars")).write(to_spark(spark, pdf.iloc[100 * k : 100 * (k + 1)].assign(close=float(k))), "1m")
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    commits.CommitLog.put = late
    try:
        threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
        for t in threads:
            t.start()
        for t in threads:
            t.join()
    finally:
        commits.CommitLog.put = put
    assert not errors
    assert store.load("S", "1m").count() == 400 and store.catalog().first()["n_bars"] == 400
    assert store.load("S", "1m").groupBy("close").count().where("close in (1, 2, 3)").agg(F.sum("count")).first()[0] == 300
    assert store.log.version() == 5


def test_readers_see_whole_commits_only(spark, tmp_path):
    store = ST.BarStore(spark, str(tmp_path / "bars"))
    store.write(to_spark(spark, walk(50, 2)), "1m")
    before = store.load("S", "1m")
    log = store.log
    log.put(to_spark(spark, walk(90, 3)).withColumns({"source": F.lit("binance"), "market": F.lit("spot"), "tf": F.lit("1m"), "month": F.lit("2025-01")}), ["open_time"])
    assert store.load("S", "1m").count() == store.table().count() == 50
    store.write(to_spark(spark, walk(70, 4)), "1m")
    assert before.count() == 50 and store.load("S", "1m").count() == 70
    assert log.vacuum(hours=0) == 2 and store.load("S", "1m").count() == 70
    store.write(to_spark(spark, walk(9, 4)).limit(0), "1m")
    assert log.version() == 2


def test_logs_are_summed_up(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commits, "EVERY", 2)
    store = ST.BarStore(spark, str(tmp_path / "bars"))
    for k in range(5):
        store.write(to_spark(spark, walk(20 + k, k)).withColumn("open_time", F.expr(f"open_time + interval {20 * k} days")), "1m")
    assert len(list((tmp_path / "bars" / "_commits").glob("*.full"))) == 2
    for old in ("000000000001.json", "000000000002.json", "000000000003.json"):
        (tmp_path / "bars" / "_commits" / old).unlink()
    assert store.table().count() == sum(20 + k for k in range(5)) and store.log.version() == 5


@pytest.mark.parametrize("how", ["rubbish", "gone", "other rows"])
def test_damage_inside_is_found_and_fetched_again(spark, tmp_path, how):
    store = ST.BarStore(spark, str(tmp_path / "bars"))
    ask = lambda: P.get_ohlcv(store, "abc", "1h", "2025-01-30 00:00:00", "2025-03-02 00:00:00", P.KlineProvider("tests.test_scale:hourly_page"))
    assert ask().count() == 31 * 24 + 1
    file = next((tmp_path / "bars").rglob("month=2025-02/*.parquet"))
    if how == "rubbish":
        file.write_bytes(b"PAR1" + b"x" * (file.stat().st_size - 8) + b"PAR1")
    elif how == "gone":
        file.unlink()
    else:
        file.write_bytes(next((tmp_path / "bars").rglob("month=2025-03/*.parquet")).read_bytes())
    for crc in file.parent.glob(".*.crc"):
        crc.unlink()
    if how == "rubbish":
        with pytest.raises(Exception, match="(?i)parquet"):
            store.load("abc", "1h").count()
        with pytest.raises(ST.DamagedError, match="2025-02"):
            store.write(store.load("abc", "1h", "2025-03-01 00:00:00").drop("source", "market", "tf", "month").withColumn("open_time", F.expr("open_time - interval 5 days")), "1h")
    rows = ask()
    assert rows.count() == 31 * 24 + 1 and rows.select("open_time").distinct().count() == 31 * 24 + 1
    assert store.repair("abc", "1h", deep=True) == [] and not store.incomplete("binance", "spot", "ABC", "1h")


def test_deep_checks_tell_other_values(spark, tmp_path):
    store = ST.BarStore(spark, str(tmp_path / "bars"))
    for close in (1.0, 2.0):
        store.write(to_spark(spark, series([close, close])).withColumn("open_time", F.expr(f"open_time + interval {40 * int(close)} days")), "1m")
    a, b = (next((tmp_path / "bars").rglob(f"month=2025-{m}/*.parquet")) for m in ("02", "03"))
    b.write_bytes(a.read_bytes())
    for crc in b.parent.glob(".*.crc"):
        crc.unlink()
    assert store.repair("s", "1m") == [] and store.repair("s", "1m", deep=True) == ["2025-03"]
    assert store.load("S", "1m").count() == 2


def hourly_page(symbol, tf, start, end, limit):
    hour = 3_600_000
    first = -(-start // hour)
    return [[k * hour, "1", "2", "0.5", "1.5", "3", 0, "4", 5, "6", "7", "0"] for k in range(first, min(end // hour, first + limit - 1) + 1)]


def test_times_in_logs_keep_their_microseconds(spark, tmp_path):
    store = ST.BarStore(spark, str(tmp_path / "bars"))
    store.write(to_spark(spark, series([1.0])).withColumn("open_time", F.expr("timestamp_ntz'2025-01-01 00:00:00.123456'")), "1m")
    assert store.catalog().first()["last_time"] == datetime(2025, 1, 1, 0, 0, 0, 123456)


# ---- curves and charts


def shape_by_force(points, m):
    """(x, v) pairs in order: the largest triangle of each of m - 2 equal rows."""
    n = len(points)
    if n <= m:
        return points
    every = (n - 2) / (m - 2)
    at = lambda i: int(i * every) + 1
    out = [points[0]]
    for i in range(m - 2):
        after = points[at(i + 1) : min(at(i + 2), n)] if i < m - 3 else points[-1:]
        x, v = sum(p[0] for p in after) / len(after), sum(p[1] for p in after) / len(after)
        a = out[-1]
        out.append(max(points[at(i) : at(i + 1)], key=lambda q: (abs((a[0] - x) * (q[1] - a[1]) - (a[0] - q[0]) * (v - a[1])), -q[0])))
    return [*out, points[-1]]


@pytest.mark.parametrize("m", [3, 17, 400])
def test_shape_by_force(spark, m):
    pdf = pd.concat([walk(300, 3), walk(5, 4).assign(symbol="T")])
    got = R.shape(to_spark(spark, pdf), "2min", m).toPandas()
    for symbol, own in pdf.groupby("symbol"):
        cand = set()
        for _, g in own.groupby(own["open_time"].dt.floor("2min")):
            pairs = [(t.value / 1000, c) for t, c in zip(g["open_time"], g["close"], strict=True)]
            cand |= {min(pairs, key=lambda p: (p[1], p[0])), max(pairs, key=lambda p: (p[1], p[0]))}
        mine = sorted((t.value / 1000, c) for t, c in zip(got[got["symbol"] == symbol]["open_time"].astype("datetime64[ns]"), got[got["symbol"] == symbol]["close"], strict=True))
        assert mine == shape_by_force(sorted(cand), m)


def test_curves_are_summed_up_by_blocks(spark):
    from barloom.operators.statistics import curve_stats

    r = np.random.default_rng(3)
    t = pd.to_datetime("2024-11-03") + pd.to_timedelta(np.cumsum(r.integers(1, 90, 900)), "h")
    frames = [pd.DataFrame({"run_id": k, "symbol": "S", "t": t[:n], "equity": 1000 * np.exp(np.cumsum(r.normal(0, 0.02, n))), "open_trades": 0}) for k, n in enumerate((900, 2, 1))]
    df = spark.createDataFrame(pd.concat(frames), "run_id long, symbol string, t timestamp_ntz, equity double, open_trades long")
    curve = backtest.with_drawdown(df)
    got = {x.run_id: x for x in curve_stats(curve).collect()}
    for k, own in enumerate(frames):
        e = own["equity"]
        moves = e.pct_change().dropna()
        fall = ((e.cummax() - e) / e.cummax()).max()
        assert got[k].max_drawdown_pct == pytest.approx(100 * fall, rel=1e-12)
        spacing = own["t"].diff().dt.total_seconds().dropna()
        year = backtest.YEAR / spacing.median() if len(own) >= 3 else 0.0
        assert got[k].periods_per_year == pytest.approx(year)
        want = moves.mean() / moves.std() * year**0.5 if len(moves) > 1 else 0.0
        assert got[k].sharpe == pytest.approx(want, rel=1e-9)
        down = moves[moves < 0].std()
        assert got[k].sortino == pytest.approx(moves.mean() / down * year**0.5 if len(moves) > 1 and down > 0 else 0.0, rel=1e-9)
    plan = curve_stats(curve)._jdf.queryExecution().executedPlan().toString()
    assert all("_b" in w or "_t#" not in w for w in re.findall(r"Window \[lag\(equity[^\n]*", plan))


# ---- sweeps


def test_sweeps_are_staged_part_by_part(spark, monkeypatch):
    from barloom.operators import search
    from barloom.plans import strategies as Y

    bars = to_spark(spark, walk(500, 3))
    cfg = BacktestConfig(fee_bps=5, exit_enabled=True, sl_mode="entry_pct", sl_value=0.5)
    grid = {"fast": [3, 4, 5], "slow": [15, 20], "confirm_n": [1, 2]}
    whole = search.run_grid(bars, Y.EmaRibbon, grid, cfg).orderBy("run_id").toPandas()
    monkeypatch.setattr(search, "VARIANTS", 5)
    parts = search.run_grid(bars, Y.EmaRibbon, grid, cfg)
    pd.testing.assert_frame_equal(whole, parts.orderBy("run_id").toPandas())
    plan = search.top(parts, 3, "total_return_pct")._jdf.queryExecution().toString()
    assert "MapInPandas" not in plan and "Union" not in plan and "NestedLoop" not in plan


def test_a_sweep_of_two_thousand_runs(spark):
    from barloom.operators import search
    from barloom.plans import strategies as Y

    bars = to_spark(spark, walk(60, 3))
    configs = [({"sl_value": 0.1 + k / 100}, BacktestConfig(exit_enabled=True, sl_mode="entry_pct", sl_value=0.1 + k / 100)) for k in range(500)]
    got = search.sweep(bars, [({"fast": f}, Y.EmaRibbon(fast=f, slow=9)) for f in (2, 3, 4, 5)], configs)
    assert got.count() == 2000 and got.select("run_id").distinct().count() == 2000
    assert "Union" not in got._jdf.queryExecution().toString()


# ---- searches in rungs, and studies gone on with


def test_halving_hands_on_the_best(spark):
    from barloom.operators import search
    from barloom.plans.strategies import EmaRibbon

    pdf = walk(1200, 12, step=0.004)
    bars = to_spark(spark, pd.concat([pdf, pdf.assign(symbol="B", close=pdf["close"].to_numpy()[::-1])], ignore_index=True)).cache()
    space, cfg = {"fast": (2, 8), "slow": (9, 20), "confirm_n": [1, 2]}, BacktestConfig(fee_bps=2)
    rows = search.halving_search(bars, EmaRibbon, space, cfg, "total_return_pct", n_trials=6, seed=3, keep=0.5).toPandas()
    per = rows.groupby("rung")["run_id"].agg(lambda x: sorted(set(x)))
    assert [len(per[k]) for k in range(3)] == [6, 3, 1]
    for k in range(2):
        means = rows[rows["rung"] == k].groupby("run_id")["total_return_pct"].mean().sort_values(ascending=False)
        assert per[k + 1] == sorted(means.index[: len(per[k + 1])])
    last = rows[rows["rung"] == 2]
    trial = search.draws(space, 6, search.random.Random(3))[last["run_id"].iloc[0]]
    whole = search.sweep(bars, [(trial, EmaRibbon(**trial))], [({}, cfg)]).toPandas()
    np.testing.assert_allclose(sorted(last["final_cash"]), sorted(whole["final_cash"]))
    assert all(last[c].iloc[0] == v for c, v in trial.items())
    with pytest.raises(ValueError, match="rungs"):
        search.halving_search(bars, EmaRibbon, space, cfg, rungs=0)
    with pytest.raises(ValueError, match="no valid"):
        search.halving_search(bars, EmaRibbon, space, cfg, valid=lambda p: False)


def test_a_study_is_kept_and_gone_on_with(spark):
    from barloom.operators import search
    from barloom.plans.strategies import EmaRibbon

    bars = to_spark(spark, walk(400, 13, step=0.004)).cache()
    space = {"fast": (2, 5), "slow": (6, 9), "confirm_n": [1]}
    find = dict(metric="total_return_pct", batch=4, startup=2, seed=1)
    study = search.model_search(bars, EmaRibbon, space, BacktestConfig(), n_trials=4, **find)
    table = study.table(spark)
    again = search.Study.of(table, "maximize")
    assert again == study
    more = search.model_search(bars, EmaRibbon, space, BacktestConfig(), n_trials=4, study=again, **find)
    assert more.trials[:4] == study.trials and [t.number for t in more.trials] == list(range(8))
    assert len({str(t.params) for t in more.trials}) == 8 and more.best_value >= study.best_value
    with pytest.raises(ValueError, match="goes for"):
        search.model_search(bars, EmaRibbon, space, BacktestConfig(), direction="minimize", n_trials=1, study=more)
    assert search.Study.of(table.limit(0), "maximize").trials == []


# ---- levels of detail


def test_a_viewport_of_levels_is_that_of_the_bars(spark, tmp_path, monkeypatch):
    from barloom.operators import levels

    pdf = walk(4000, 21)
    r = np.random.default_rng(1)
    pdf.loc[r.random(len(pdf)) < 0.02, "open"] = np.nan
    pdf.loc[r.random(len(pdf)) < 0.02, "close"] = np.nan
    rare = pdf.iloc[r.choice(len(pdf), 40, replace=False)].assign(symbol="rare")
    df = to_spark(spark, pd.concat([pdf, rare], ignore_index=True))
    odd = df.limit(1).withColumn("symbol", F.lit(None).cast("string")).unionByName(df.limit(1).withColumn("open_time", F.lit(None).cast("timestamp_ntz")))
    kept = levels.Levels(spark, str(tmp_path / "levels"), ("5min", "30min", "1h")).write(df.unionByName(odd))
    key = lambda d: sorted(map(str, d.collect()))
    spans = [("2025-01-01 00:07:00", "2025-01-03 11:13:00", 50), ("2025-01-01 00:00:00", "2025-01-03 18:00:00", 60), ("2025-01-01 05:03:00", "2025-01-01 09:00:00", 48), ("2025-01-02 00:01:00", "2025-01-02 00:04:00", 2), ("2024-12-01 00:00:00", "2025-02-01 00:00:00", 30), ("2026-01-01 00:00:00", "2026-01-02 00:00:00", 10)]
    used = []
    for start, end, target in spans:
        got = kept.viewport(start, end, target)
        assert key(got) == key(R.viewport(df, start, end, target)), (start, end, target)
        used += [n for n in ("5min", "30min", "1h") if f"every-{n}" in " ".join(got.inputFiles())]
    assert {"5min", "30min", "1h"} & set(used)
    wide = kept.viewport("2024-12-30 00:00:00", "2025-01-05 00:00:00", 72)
    assert any("every-1h" in f for f in wide.inputFiles())
    monkeypatch.setattr(levels, "NAMED", 0)
    assert key(kept.viewport(*spans[1])) == key(R.viewport(df, *spans[1]))
    empty = levels.Levels(spark, str(tmp_path / "empty"), ("1h",)).write(df.limit(0))
    assert empty.viewport("2025-01-01 00:00:00", "2025-01-03 00:00:00", 24).count() == 0
    for rules in (("1h", "90min"), ("1W",), ("1h", "1h")):
        with pytest.raises(ValueError):
            levels.Levels(spark, "x", rules)
