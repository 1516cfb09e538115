"""Command line: fetch bars into a store, run a strategy over it, write a report, run a named experiment.

python -m barloom.cli backtest --store PATH --symbol S --tf 1h --strategy ema_ribbon --params '{"fast": 10}' --sl entry_pct:0.6
"""

from __future__ import annotations

import argparse
import json
from datetime import UTC, datetime

from barloom.operators.config import BacktestConfig
from barloom.plans.experiments import EXPERIMENTS
from barloom.plans.report import print_summary, to_html
from barloom.plans.strategies import REGISTRY
from barloom.session import local_session
from barloom.settings import Settings
from barloom.sources.providers import fetch_by_month, get_ohlcv, get_provider, last
from barloom.sources.store import BarStore


def mode_value(text: str) -> tuple[str, float]:
    """MODE:VALUE, or MODE alone."""
    mode, _, value = text.partition(":")
    return mode, float(value or 0)


def build_config(args: argparse.Namespace) -> BacktestConfig:
    changes: dict = {"initial_cash": args.cash, "fee_bps": args.fee_bps, "slippage_bps": args.slippage_bps, "spread": args.spread}
    for name, prefix in (("sl", "sl"), ("tp", "tp"), ("trail", "trail"), ("sizing", "sizing")):
        if getattr(args, name):
            changes[f"{prefix}_mode"], changes[f"{prefix}_value"] = mode_value(getattr(args, name))
    changes["exit_enabled"] = bool(args.sl or args.tp or args.trail)
    return BacktestConfig().replace(**changes)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="barloom", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("fetch", "backtest", "report", "experiment"):
        p = sub.add_parser(name)
        p.add_argument("--store", default=Settings.load().store)
        p.add_argument("--symbol", required=True)
        p.add_argument("--tf", default="1h")
        p.add_argument("--start")
        p.add_argument("--last", help="instead of a start: 2weeks, 5d, 36h")
        p.add_argument("--end")
        p.add_argument("--source", default="binance")
        p.add_argument("--market", default="spot")
        p.add_argument("--master", default="*")
        if name == "fetch":
            p.add_argument("--by-month", action="store_true", help="keep each month before the next is fetched")
        if name in ("backtest", "report"):
            p.add_argument("--strategy", required=True, choices=sorted(REGISTRY))
            p.add_argument("--params", default="{}", help="JSON")
            for option, default in (("cash", 10_000.0), ("fee-bps", 0.0), ("slippage-bps", 0.0), ("spread", 0.0)):
                p.add_argument(f"--{option}", type=float, default=default)
            for option in ("sl", "tp", "trail", "sizing"):
                p.add_argument(f"--{option}", help="MODE:VALUE")
        if name == "report":
            p.add_argument("--out", default="report.html")
        if name == "experiment":
            p.add_argument("--name", required=True, choices=sorted(EXPERIMENTS))
            p.add_argument("--out", default="experiment")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = local_session(args.master)
    store = BarStore(spark, args.store)
    if args.last:
        args.start = str(last(args.last))
    if args.command == "fetch":
        if args.by_month:
            until = datetime.fromisoformat(args.end) if args.end else datetime.now(UTC).replace(tzinfo=None, microsecond=0)
            return 0 if fetch_by_month(store, args.symbol, args.tf, datetime.fromisoformat(args.start), until, get_provider(args.source), args.market) else 1
        rows = get_ohlcv(store, args.symbol, args.tf, args.start, args.end, get_provider(args.source), args.market)
        print(f"{rows.count()} bars")
        return 0
    bars = store.load(args.symbol, args.tf, args.start, args.end, source=args.source, market=args.market)
    if args.command == "experiment":
        e = EXPERIMENTS[args.name]()
        e.write(e.run(bars), args.out)
        print(args.out)
        return 0
    result = REGISTRY[args.strategy](**json.loads(args.params)).backtest(bars, build_config(args))
    if args.command == "report":
        print(to_html(result, args.out, f"{args.strategy} on {args.symbol} {args.tf}", bars))
    else:
        print_summary(result)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
