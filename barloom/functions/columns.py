"""The bar table, operands of expressions, and the window all ordered expressions share."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY, TIME = "symbol", "open_time"
PRICES = ("open", "high", "low", "close")
BASE = (KEY, TIME, *PRICES, "volume")
#: Columns of a bar table that are not features of it.
CORE = frozenset((*BASE, "t", "tf", "quote_volume", "num_trades", "taker_buy_base", "taker_buy_quote"))

BAR_SCHEMA = T.StructType([T.StructField(KEY, T.StringType()), T.StructField(TIME, T.TimestampNTZType()), *[T.StructField(c, T.DoubleType()) for c in (*PRICES, "volume")]])

Ref = str | int | float | Column


def bars_window(*extra: str) -> WindowSpec:
    """Bars of one symbol in order of time."""
    return Window.partitionBy(KEY, *extra).orderBy(TIME)


def operand(ref: Ref) -> Column:
    """A column by name, a number, or a column as it is."""
    if isinstance(ref, Column):
        return ref
    return F.col(ref) if isinstance(ref, str) else F.lit(float(ref))


def sure(condition: Column) -> Column:
    """The condition with unknown taken as false: what is not yet warm never signals."""
    return F.coalesce(condition, F.lit(False))


def every(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def without_nan(df: DataFrame) -> DataFrame:
    """NaN in DOUBLE columns becomes null: Spark orders NaN above all numbers, null means unknown."""
    return df.select(*[F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name) for f in df.schema.fields])


def feature_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    """Columns that are neither prices nor keys, in order."""
    return [c for c in df.columns if c not in CORE and c not in exclude]


#: While variants of a plan are put together: what each feature column was made by.
_MADE: ContextVar[dict[str, tuple] | None] = ContextVar("made", default=None)


@contextmanager
def reusing_columns() -> Iterator[dict[str, tuple]]:
    """Inside, an indicator that a frame already has with the same parameters is not added again.

    Gives what each feature column was made by.
    """
    made: dict[str, tuple] = {}
    token = _MADE.set(made)
    try:
        yield made
    finally:
        _MADE.reset(token)


def indicator(names: Callable[..., list[str]]) -> Callable:
    """Marks a function from bars to bars; names gives the columns that a call adds.

    Columns are told apart by what made them, not by name alone: other parameters under the same name are
    computed anew.
    """

    def wrap(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @functools.wraps(f)
        def call(df: DataFrame, *args, **kwargs) -> DataFrame:
            made = _MADE.get()
            if made is None:
                return f(df, *args, **kwargs)
            own = names(*args, **kwargs)
            basis = tuple(made.get(a) for a in (*args, *kwargs.values()) if isinstance(a, str) and a not in own)
            key = (f.__name__, repr(args), repr(sorted(kwargs.items())), basis)
            if all(c in df.columns and made.get(c) == (key, c) for c in own):
                return df
            token = _MADE.set(None)  # helpers inside make columns that are dropped again
            try:
                out = f(df, *args, **kwargs)
            finally:
                _MADE.reset(token)
            made.update({c: (key, c) for c in own})
            return out

        return call

    return wrap
