"""Rolling means and extremes of the last n bars, in time that does not grow with n.

Spark works a sliding frame out anew for each row. Here a series is cut into blocks of n bars: the last n bars
are the end of one block and the beginning of the next, so a running value from each block's start and one
from its end, both of them growing frames, are all that is needed. Sums run over a block at most: nothing
drifts. Counts are differences of running counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import KEY, TIME, bars_window

#: Frames of up to so many bars are left to Spark: sorting blocks costs more than going over them.
SHORT = 32
_FOLDS = {"mean": (F.sum, lambda a, b: a + b), "min": (F.min, F.least), "max": (F.max, F.greatest)}


def count_of_last(condition: Column, n: int, upto: int = 0) -> Column:
    """On how many of n bars the condition holds; the last of them is `upto` bars from this one (0, -1, ...)."""
    w = bars_window()
    seen = lambda end: F.coalesce(F.sum(condition.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, end)), F.lit(0))
    return seen(upto) - seen(upto - n)


def _sliding(kind: str, source: Column, n: int) -> Column:
    frame = bars_window().rowsBetween(-(n - 1), 0)
    return (F.avg if kind == "mean" else _FOLDS[kind][0])(source).over(frame)


def rolling(df: DataFrame, wanted: dict[str, tuple[str, Column, int]]) -> DataFrame:
    """df with a column for each of wanted: name -> (mean, min or max; source; n). Null unless the source is known
    on all of the last n bars. Sources may refer to columns of df, not to each other."""
    names = [c for c in df.columns if c not in wanted]
    full = {out: count_of_last(source.isNotNull(), n) == n for out, (_, source, n) in wanted.items()}
    short = {out: F.when(full[out], _sliding(*of)).alias(out) for out, of in wanted.items() if of[2] <= SHORT}
    long = {out: of for out, of in wanted.items() if of[2] > SHORT}
    if not long:
        return df.select(*names, *short.values())
    w = bars_window()
    value = {out: f"_{out}_v" for out in long}
    df = df.select(*names, *short.values(), F.row_number().over(w).alias("_rn"), *[source.alias(value[out]) for out, (_, source, _) in long.items()], *[full[out].alias(f"_{out}_full") for out in long])
    ahead, behind = {}, {}
    for out, (kind, _, n) in long.items():
        block = Window.partitionBy(KEY, F.expr(f"(_rn - 1) div {n}"))
        grown = _FOLDS[kind][0](F.col(value[out]))
        ahead[f"_{out}_a"] = grown.over(block.orderBy(TIME))
        behind[f"_{out}_b"] = grown.over(block.orderBy(F.desc(TIME)))
    df = df.withColumns(behind).withColumns(ahead)
    made = []
    for out, (kind, _, n) in long.items():
        head, tail = F.col(f"_{out}_a"), F.lag(f"_{out}_b", n - 1).over(w)
        both = F.when(F.col("_rn") % n == 0, head).otherwise(_FOLDS[kind][1](tail, head))
        made.append(F.when(F.col(f"_{out}_full"), both / n if kind == "mean" else both).alias(out))
    return df.select(*names, *short, *made)
