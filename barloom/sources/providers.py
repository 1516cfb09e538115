"""Market data providers behind a Python data source: one input partition for each missing range.

A provider turns (symbol, tf, start, end) into pages of raw rows. Pages are fetched in the tasks that read
them, with retries; a lost executor's range is fetched again by the task that replaces it.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from barloom.functions.columns import KEY, TIME
from barloom.settings import get_logger
from barloom.sources.store import BarStore, merge_bars, missing_ranges, pages_needed, show_last, validate_ohlcv
from barloom.staging import drop, stage

#: Timeframes and request limits of the providers.
KLINE_INTERVALS = ("1m", "3m", "5m", "15m", "30m", "1h", "2h", "4h", "6h", "8h", "12h", "1d", "3d", "1w", "1M")
KLINE_COLUMNS = ("open_time", "open", "high", "low", "close", "volume", "close_time", "quote_volume", "num_trades", "taker_buy_base", "taker_buy_quote", "ignore")
KLINE_LIMIT = 1000
RETRY_STATUS = frozenset((418, 429, 500, 502, 503, 504))
FX_INTERVALS = {"1m": "1m", "5m": "5m", "10m": "10m", "15m": "15m", "30m": "30m", "1h": "1h", "4h": "4h", "1d": "1d"}
FX_SYMBOLS = {"GOLD": "XAU/USD", "XAUUSD": "XAU/USD", "SILVER": "XAG/USD", "XAGUSD": "XAG/USD"}
#: Pages of one task, at most: long ranges are cut.
PAGES_A_TASK = 50

_KLINES = "symbol string, open_time timestamp_ntz, open double, high double, low double, close double, volume double, quote_volume double, num_trades long, taker_buy_base double, taker_buy_quote double"


class HttpError(Exception):
    def __init__(self, status: int, retry_after: float | None = None) -> None:
        super().__init__(f"status {status}")
        self.status, self.retry_after = status, retry_after


class IncompleteError(Exception):
    """Some pages could not be fetched; the others are in the store."""


def spacing_seconds(tf: str) -> int:
    """Seconds of a bar."""
    return show_last(tf.replace("M", "mo"))


def wait_for(attempt: int, base: float = 1.0, most: float = 60.0, retry_after: float | None = None) -> float:
    """Seconds before the next try: what the server asks for, or twice as long each time, up to a limit."""
    return min(most, retry_after) if retry_after is not None else min(most, base * 2 ** (attempt - 1))


def with_retries(fetch: Callable[[], list], tries: int = 5, sleep: Callable[[float], None] = time.sleep) -> list:
    """A page, asked for again after errors that pass."""
    for attempt in range(1, tries + 1):
        try:
            return fetch()
        except HttpError as e:
            if e.status not in RETRY_STATUS or attempt == tries:
                raise
            sleep(wait_for(attempt, retry_after=e.retry_after))
        except (TimeoutError, ConnectionError):
            if attempt == tries:
                raise
            sleep(wait_for(attempt))
    return []


Page = Callable[[str, str, int, int, int], list]  # symbol, tf, start ms, end ms, limit -> kline rows


def kline_rows(symbol: str, tf: str, start: int, end: int, page: Page, limit: int = KLINE_LIMIT, sleep: Callable[[float], None] = time.sleep, keep: bool = False) -> Iterator[tuple]:
    """All rows from start to end (milliseconds, both included), page after page.

    If a page fails for good: an error, or with keep the rows so far and a row without a time, as a mark.
    """
    at = start
    while at <= end:
        try:
            rows = with_retries(lambda: page(symbol, tf, at, end, limit), sleep=sleep)  # noqa: B023
        except (HttpError, TimeoutError, ConnectionError):
            if not keep:
                raise
            yield (symbol, *[None] * 10)
            return
        for r in rows:
            when = datetime.fromtimestamp(int(r[0]) / 1000, UTC).replace(tzinfo=None)
            yield (symbol, when, *[float(x) for x in r[1:6]], float(r[7]), int(r[8]), float(r[9]), float(r[10]))
        if len(rows) < limit:
            return
        at = int(rows[-1][0]) + 1


def cut_ranges(ranges: list[tuple[int, int]], tf: str, bars: int) -> list[tuple[int, int]]:
    """Ranges (milliseconds, both ends included) of at most that many bars each; empty ones go."""
    unit = {"m": 60, "h": 3600, "d": 86_400, "w": 604_800, "M": 2_592_000}[tf[-1]]
    width = int(tf[:-1]) * unit * 1000 * bars
    return [(at, min(int(b), at + width - 1)) for a, b in ranges for at in range(int(a), int(b) + 1, width)]


@dataclass
class _Range(InputPartition):
    start: int
    end: int


class KlineSource(DataSource):
    """spark.read.format("klines") with options symbol, tf, ranges (JSON pairs of ms), page (module:function), limit,
    pages (of a task), and keep (true: see kline_rows)."""

    @classmethod
    def name(cls) -> str:
        return "klines"

    def schema(self) -> str:
        return _KLINES

    def reader(self, schema) -> DataSourceReader:
        return _KlineReader(self.options)


class _KlineReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.symbol, self.tf = options["symbol"], options["tf"]
        self.ranges = json.loads(options["ranges"])
        self.page = options["page"]
        self.limit = int(options.get("limit", KLINE_LIMIT))
        self.pages = int(options.get("pages", PAGES_A_TASK))
        self.keep = options.get("keep", "false") == "true"

    def partitions(self) -> list[InputPartition]:
        return [_Range(a, b) for a, b in cut_ranges(self.ranges, self.tf, self.limit * self.pages)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        import importlib

        module, _, name = self.page.partition(":")
        yield from kline_rows(self.symbol, self.tf, partition.start, partition.end, getattr(importlib.import_module(module), name), self.limit, keep=self.keep)


def http_page(symbol: str, tf: str, start: int, end: int, limit: int) -> list:  # pragma: no cover - needs a network
    """A page of a public kline endpoint, whose address is in BARLOOM_KLINES_URL."""
    import os
    import urllib.error
    import urllib.parse
    import urllib.request

    query = urllib.parse.urlencode({"symbol": symbol, "interval": tf, "startTime": start, "endTime": end, "limit": limit})
    try:
        with urllib.request.urlopen(f"{os.environ['BARLOOM_KLINES_URL']}?{query}", timeout=30) as answer:
            return json.load(answer)
    except urllib.error.HTTPError as e:
        after = e.headers.get("Retry-After")
        raise HttpError(e.code, float(after) if after else None) from e


def generated_page(symbol: str, tf: str, start: int, end: int, limit: int) -> list:
    """A page of one-minute klines that depend on their minute alone: a source for tests and trials."""
    first = -(-start // 60_000)
    minutes = range(first, min(end // 60_000, first + limit - 1) + 1)
    return [[k * 60_000, str(100 + k % 97 / 10), "120", "90", str(100 + k % 89 / 10), str(k % 13), k * 60_000 + 59_999, "0", k % 7, "0", "0", "0"] for k in minutes]


def parse_klines(raw: DataFrame, column: str, symbol: str | Column) -> DataFrame:
    """Bars from a column of JSON pages: arrays of arrays of twelve values. symbol: a name, or a column of raw."""
    name = F.lit(symbol) if isinstance(symbol, str) else symbol
    rows = raw.select(name.alias("s"), F.explode(F.from_json(column, "array<array<string>>")).alias("r"))
    value = lambda name, kind: F.get("r", F.lit(KLINE_COLUMNS.index(name))).try_cast(kind).alias(name)
    when = F.timestamp_millis(F.get("r", F.lit(0)).try_cast("long")).cast("timestamp_ntz").alias(TIME)
    kinds = {"num_trades": "long"}
    return rows.select(F.col("s").alias(KEY), when, *[value(c, kinds.get(c, "double")) for c in ("open", "high", "low", "close", "volume", "quote_volume", "num_trades", "taker_buy_base", "taker_buy_quote")])


class Provider(Protocol):
    """Where bars come from: a table of bars for each of some ranges of time."""

    name: str

    def fetch(self, spark: SparkSession, symbol: str, tf: str, ranges: list[tuple[datetime, datetime]]) -> DataFrame: ...


def _ms(t: datetime) -> int:
    return int(t.replace(tzinfo=UTC).timestamp() * 1000)


@dataclass
class KlineProvider:
    """Paged klines; page names the function that fetches one, as module:function."""

    page: str = "barloom.sources.providers:http_page"
    limit: int = KLINE_LIMIT
    pages_a_task: int = PAGES_A_TASK
    name: str = "binance"

    def fetch(self, spark: SparkSession, symbol: str, tf: str, ranges: list[tuple[datetime, datetime]]) -> DataFrame:
        if tf not in KLINE_INTERVALS:
            raise ValueError(f"unknown interval {tf!r}")
        spark.dataSource.register(KlineSource)
        pairs = json.dumps([[_ms(a), _ms(b)] for a, b in ranges])
        return spark.read.format("klines").options(symbol=symbol.upper(), tf=tf, ranges=pairs, page=self.page, limit=str(self.limit), pages=str(self.pages_a_task), keep="true").load()


def fx_symbol(symbol: str) -> str:
    """A pair of six characters, with or without a slash, as XXX/YYY, and some names of metals; others are errors."""
    s = symbol.upper().replace("/", "")
    if s not in FX_SYMBOLS and len(s) != 6:
        raise ValueError(f"no instrument is known for {symbol!r}")
    return FX_SYMBOLS.get(s, f"{s[:3]}/{s[3:]}")


def normalise(raw: DataFrame, symbol: str | Column) -> DataFrame:
    """A provider's frame as bars: names in lower case, its time column found, volume 0 where there is none. symbol: a
    name, or a column of raw."""
    lower = raw.toDF(*[c.lower() for c in raw.columns])
    times = [c for c in ("open_time", "timestamp", "time", "date", "datetime", "index") if c in lower.columns]
    if not times:
        raise ValueError("no time column")
    volume = F.coalesce(F.col("volume").cast("double"), F.lit(0.0)) if "volume" in lower.columns else F.lit(0.0)
    rows = lower.select(F.upper(F.lit(symbol) if isinstance(symbol, str) else symbol).alias(KEY), F.col(times[0]).cast("timestamp_ntz").alias(TIME), *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close")], volume.alias("volume"))
    return validate_ohlcv(rows)


@dataclass
class FxProvider:
    """Bid or ask bars from a function (instrument, interval, side, start, end) -> DataFrame."""

    call: Callable[[SparkSession, str, str, str, datetime, datetime], DataFrame] | None = None
    offer: str = "bid"
    name: str = "dukascopy"

    def fetch(self, spark: SparkSession, symbol: str, tf: str, ranges: list[tuple[datetime, datetime]]) -> DataFrame:
        if tf not in FX_INTERVALS:
            raise ValueError(f"unknown interval {tf!r}")
        if self.call is None:
            raise RuntimeError("no client for this provider is installed")
        side = "ask" if self.offer.lower() == "ask" else "bid"
        frames = [normalise(self.call(spark, fx_symbol(symbol), FX_INTERVALS[tf], side, a, b), symbol) for a, b in ranges]
        return merge_bars(*frames)


@dataclass
class TableProvider:
    """Bars of a table that Spark reads, as if they were far away: of a symbol, only the ranges that are asked for."""

    bars: DataFrame
    name: str = "table"

    def fetch(self, spark: SparkSession, symbol: str, tf: str, ranges: list[tuple[datetime, datetime]]) -> DataFrame:
        wanted = reduce(lambda x, y: x | y, [F.col(TIME).between(F.lit(a).cast("timestamp_ntz"), F.lit(b).cast("timestamp_ntz")) for a, b in ranges])
        return self.bars.where((F.upper(KEY) == symbol.upper()) & wanted)


_PROVIDERS: dict[str, Callable[[], Provider]] = {"binance": KlineProvider, "dukascopy": FxProvider}


def register_provider(name: str, make: Callable[[], Provider]) -> None:
    _PROVIDERS[name.lower()] = make


def get_provider(name: str) -> Provider:
    if name.lower() not in _PROVIDERS:
        raise ValueError(f"unknown source {name!r}: {', '.join(sorted(_PROVIDERS))}")
    return _PROVIDERS[name.lower()]()


def get_ohlcv(store: BarStore, symbol: str, tf: str, start: str, end: str | None = None, provider: Provider | None = None, market: str = "spot", tz: str = "UTC", columns: list[str] | None = None, refresh: bool = False) -> DataFrame:
    """Bars from start to end, both included, with their local time t. Only what the store lacks is fetched.

    Months whose files are damaged are fetched again. If pages fail for good, what was fetched is put into the store all the same, and IncompleteError is raised:
    the next call fetches the rest.
    """
    provider = provider or get_provider("binance")
    where = {"source": provider.name, "market": market}
    until = end or datetime.now(UTC).replace(tzinfo=None).isoformat(sep=" ", timespec="seconds")
    series = (provider.name, market, symbol.upper(), tf)
    if bad := store.repair(symbol, tf, **where):
        get_logger("barloom.fetch").warning("%s %s: damaged months are fetched again: %s", symbol, tf, ", ".join(bad))
    if refresh or store.incomplete(*series) or not store.covers(symbol, tf, start, end, **where):
        have = store.load(symbol, tf, **where).limit(0) if refresh else store.load(symbol, tf, **where)
        ranges = [(r["from"], r["to"]) for r in missing_ranges(have, tf, start, until, symbol.upper()).collect()]
        if ranges:
            log = get_logger("barloom.fetch")
            step = int(spacing_seconds(tf))
            log.info("%s %s: %d ranges, about %d pages", symbol, tf, len(ranges), sum(pages_needed(_ms(a) // 1000, _ms(b) // 1000, step, KLINE_LIMIT) for a, b in ranges))
            got = stage(provider.fetch(store.spark, symbol, tf, ranges), "fetched")  # once, however often it is read below
            store.write(got.where(F.col(TIME).isNotNull()), tf, **where)
            failed = got.where(F.col(TIME).isNull()).count()
            drop(got)
            if failed or store.incomplete(*series):
                store.incomplete(*series, set_to=failed > 0)
            if failed:
                raise IncompleteError(f"{symbol} {tf}: {failed} ranges broke off; what was fetched is kept")
    rows = store.load(symbol, tf, start, until, columns, **where)
    return rows.withColumn("t", F.convert_timezone(F.lit("UTC"), F.lit(tz), F.col(TIME)))


def month_ends(start: datetime, end: datetime) -> list[datetime]:
    """Ends of growing spans, a month at a time: what is fetched up to one of them is kept if the next fails."""
    out, at = [], start
    while at < end:
        at = min(end, (at.replace(day=1) + timedelta(days=32)).replace(day=1))
        out.append(at)
    return out


def fetch_by_month(store: BarStore, symbol: str, tf: str, start: datetime, end: datetime, provider: Provider | None = None, market: str = "spot") -> bool:
    """Fetch a long span month by month, each kept before the next is asked for; whether all of it is there.

    After a failure the next call goes on where this one stopped.
    """
    log = get_logger("barloom.fetch")
    for until in month_ends(start, end):
        try:
            get_ohlcv(store, symbol, tf, str(start), str(until), provider, market)
        except (IncompleteError, HttpError, TimeoutError, ConnectionError) as e:
            log.error("%s %s stopped before %s (%s); call again to go on", symbol, tf, until, e)
            return False
        log.info("%s %s is there until %s", symbol, tf, until)
    return True


def last(text: str, now: datetime | None = None) -> datetime:
    """The start of the span before now that a text such as 2weeks or 36h names."""
    return (now or datetime.now(UTC).replace(tzinfo=None, microsecond=0)) - timedelta(seconds=show_last(text))
