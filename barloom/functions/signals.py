"""Signal predicates: boolean columns that are never null. An unknown operand gives false."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from barloom.functions.columns import Ref, bars_window, every, operand, sure
from barloom.operators.rolling import count_of_last


def above(a: Ref, b: Ref) -> Column:
    return sure(operand(a) > operand(b))


def below(a: Ref, b: Ref) -> Column:
    return sure(operand(a) < operand(b))


def above_all(a: Ref, refs: list[Ref]) -> Column:
    """a is above each of refs; true if there are none."""
    return every([above(a, r) for r in refs])


def below_all(a: Ref, refs: list[Ref]) -> Column:
    return every([below(a, r) for r in refs])


def _difference(a: Ref, b: Ref, back: int = 0) -> Column:
    d = operand(a) - operand(b)
    return F.lag(d, back).over(bars_window()) if back else d


def _crossing(a: Ref, b: Ref, back: int, up: bool) -> Column:
    now, before = _difference(a, b, back), _difference(a, b, back + 1)
    return sure((before <= 0) & (now > 0) if up else (before >= 0) & (now < 0))


def cross_up(a: Ref, b: Ref) -> Column:
    """a was at or below b a bar ago and is above it now; false on a symbol's first bar."""
    return _crossing(a, b, 0, True)


def cross_down(a: Ref, b: Ref) -> Column:
    return _crossing(a, b, 0, False)


def crossed_up_within(a: Ref, b: Ref, lookback: int = 1) -> Column:
    """A cross up on one of the last lookback bars, this one included."""
    return reduce(lambda x, y: x | y, [_crossing(a, b, k, True) for k in range(lookback)], F.lit(False))


def holds_for(condition: Column, n: int, include_current: bool = True) -> Column:
    """The condition held on each of n bars in a row: up to this one, or up to the one before."""
    if n <= 0:
        return F.lit(False)
    return count_of_last(sure(condition), n, 0 if include_current else -1) == n


def last_all_above(x: Ref, level: Ref, n: int, include_current: bool = True) -> Column:
    return holds_for(operand(x) > operand(level), n, include_current)


def last_all_below(x: Ref, level: Ref, n: int, include_current: bool = True) -> Column:
    return holds_for(operand(x) < operand(level), n, include_current)


def prev_all_above(x: Ref, level: Ref, n: int) -> Column:
    return last_all_above(x, level, n, include_current=False)


def prev_all_below(x: Ref, level: Ref, n: int) -> Column:
    return last_all_below(x, level, n, include_current=False)


def is_green(open_col: Ref = "open", close_col: Ref = "close") -> Column:
    return above(close_col, open_col)


def is_red(open_col: Ref = "open", close_col: Ref = "close") -> Column:
    return below(close_col, open_col)


def consecutive_green(n: int, open_col: Ref = "open", close_col: Ref = "close") -> Column:
    return holds_for(is_green(open_col, close_col), n)


def consecutive_red(n: int, open_col: Ref = "open", close_col: Ref = "close") -> Column:
    return holds_for(is_red(open_col, close_col), n)


def _steps(x: Ref, n: int, up: bool) -> Column:
    if n <= 0:
        return F.lit(False)
    w = bars_window()
    at = [operand(x), *[F.lag(operand(x), k).over(w) for k in range(1, n + 1)]]
    return every([sure(a > b if up else a < b) for a, b in zip(at, at[1:], strict=False)])


def rising(x: Ref, n: int = 1) -> Column:
    """n successive increases up to this bar."""
    return _steps(x, n, True)


def falling(x: Ref, n: int = 1) -> Column:
    return _steps(x, n, False)


def refs_ordered(refs: list[Ref], descending: bool = True) -> Column:
    """Each of refs is at least (or at most) the next one; equal values are in order."""
    pairs = zip(refs, refs[1:], strict=False)
    return every([sure(operand(a) >= operand(b) if descending else operand(a) <= operand(b)) for a, b in pairs])


def _some(masks: tuple[Column, ...]) -> list[Column]:
    if not masks:
        raise ValueError("at least one condition is needed")
    return [sure(m) for m in masks]


def all_of(*masks: Column) -> Column:
    return every(_some(masks))


def any_of(*masks: Column) -> Column:
    return reduce(lambda a, b: a | b, _some(masks))


def none_of(*masks: Column) -> Column:
    """No condition holds; what is not known does not hold."""
    return ~any_of(*masks)


def shifted(x: Ref, n: int = 1) -> Column:
    """The value n bars ago."""
    return F.lag(operand(x), n).over(bars_window())


def change(x: Ref) -> Column:
    """The difference from the bar before."""
    return operand(x) - shifted(x)


def forward_fill(x: Ref) -> Column:
    """The last value that is not null, up to this bar."""
    return F.last(operand(x), ignorenulls=True).over(bars_window().rowsBetween(Window.unboundedPreceding, 0))
