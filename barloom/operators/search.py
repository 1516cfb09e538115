"""Parameter search: grids, random search, experiments. Runs are data: one row each, ranked by Spark."""

from __future__ import annotations

import itertools
import json
import math
import random
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.columns import KEY, TIME, reusing_columns
from barloom.operators.backtest import _FAST, RUN, run_many
from barloom.operators.config import BacktestConfig
from barloom.plans.strategies import Strategy
from barloom.staging import drop, stage, stage_parts

#: Distinct signal variants in one plan; larger grids are run in parts of this size.
VARIANTS = 48


def expand_grid(grid: dict[str, list]) -> list[dict]:
    """Every combination of the values, the last key changing fastest."""
    return [dict(zip(grid, values, strict=True)) for values in itertools.product(*grid.values())]


def _flags(bars: DataFrame, variants: list[Strategy], extra: list[str]) -> DataFrame:
    """Bars with one hexadecimal digit for each variant in `flags`, and the columns that stops refer to.

    Indicators that variants share are computed once. Those of other parameters under the same name are not
    mixed up: each variant's flags are fixed before the next one's columns replace its own.
    """
    kept = [KEY, TIME, "open", "high", "low", "close", "volume"]
    table = bars.select(*[c for c in bars.columns if c in kept or c in extra])
    pending: dict[str, Column] = {}
    with reusing_columns() as made:
        for k, s in enumerate(variants):
            before = dict(made)
            prepared = s.prepare(table)
            if pending and any(made[c] != v for c, v in before.items()):
                # other parameters under a name that is in use: first fix the flags that read the old columns
                table, pending = table.withColumns(pending), {}
                made.clear()
                made.update(before)
                prepared = s.prepare(table)
            table = prepared
            pending[f"_f{k}"] = sum((r.cast("int") * (1 << bit) for bit, r in enumerate(s.signal_rules(table))), F.lit(0)).cast("tinyint")
        table = table.withColumns(pending)
    flags = F.concat(*[F.hex(F.col(f"_f{k}").cast("long")) for k in range(len(variants))])
    return table.select(*[c for c in table.columns if c in kept or c in extra], flags.alias("flags"))


def _labelled(stats: DataFrame, runs: dict[int, dict]) -> DataFrame:
    """Statistics with the parameters of their run as columns (a table of one row a run)."""
    names = list(dict.fromkeys(n for p in runs.values() for n in p))
    rows = [(k, *[json.dumps(p.get(n)) if isinstance(p.get(n), (list, tuple, dict)) else p.get(n) for n in names]) for k, p in runs.items()]
    kind = lambda i: next(("boolean" if isinstance(r[i], bool) else "long" if isinstance(r[i], int) else "double" if isinstance(r[i], float) else "string" for r in rows if r[i] is not None), "string")
    kinds = [kind(i) for i in range(1, len(names) + 1)]
    kinds = ["double" if k == "long" and any(isinstance(r[i], float) for r in rows) else k for i, k in enumerate(kinds, 1)]
    rows = [(r[0], *[float(v) if k == "double" and v is not None else v for v, k in zip(r[1:], kinds, strict=True)]) for r in rows]
    table = stats.sparkSession.createDataFrame(rows, ", ".join([f"{RUN} long", *[f"`{n}` {k}" for n, k in zip(names, kinds, strict=True)]]))
    return table.join(stats, RUN).select(RUN, KEY, *names, *_FAST)


def _parts(bars: DataFrame, strategies: list[Strategy], configs: list[BacktestConfig], first: int = 0) -> Iterator[DataFrame]:
    """Statistics of every strategy under every configuration, VARIANTS strategies at a time; runs are numbered
    from first on. A part's bars with flags are kept until its statistics are read."""
    refs = sorted({c for cfg in configs for c in (cfg.sl_ref_long_col, cfg.sl_ref_short_col) if c})
    for start in range(0, len(strategies), VARIANTS):
        part = strategies[start : start + VARIANTS]
        table = stage(_flags(bars, part, refs), "flags")  # read for the spacing and for the runs
        runs = {k * 100_000 + j: cfg for k in range(len(part)) for j, cfg in enumerate(configs)}
        number = F.lit(first + start * len(configs)) + F.expr(f"({RUN} div 100000) * {len(configs)} + {RUN} % 100000")
        yield run_many(table, runs).withColumn(RUN, number)
        drop(table)


def sweep(bars: DataFrame, strategies: list[tuple[dict, Strategy]], configs: list[tuple[dict, BacktestConfig]]) -> DataFrame:
    """Every strategy under every configuration: one row for each run and symbol. Signals are made once a strategy.

    Runs at once: the statistics are staged part by part, so a plan that reads them knows nothing of the runs.
    """
    labels = dict(enumerate(s | c for s, _ in strategies for c, _ in configs))
    return _labelled(stage_parts(_parts(bars, [s for _, s in strategies], [c for _, c in configs]), "runs"), labels)


def run_grid(bars: DataFrame, strategy: type[Strategy], grid: dict[str, list], cfg: BacktestConfig, valid: Callable[[dict], bool] | None = None) -> DataFrame:
    """One row for each combination of strategy parameters and symbol."""
    combos = [c for c in expand_grid(grid) if valid is None or valid(c)]
    if not combos:
        raise ValueError("the grid has no valid combination")
    return sweep(bars, [(c, strategy(**c)) for c in combos], [({}, cfg)])


def rank(results: DataFrame, metric: str = "sharpe", direction: str = "max", min_trades: int = 0) -> DataFrame:
    """Runs with enough trades (all, if none has), infinities as unknown, those without the metric left out.

    Looks into the results at once, whether any run has enough; those of sweep() are staged.
    """
    enough = results.where(F.col("num_trades") >= min_trades)
    kept = results if enough.isEmpty() else enough
    finite = [F.when(F.abs(c.name) != float("inf"), F.col(c.name)).alias(c.name) if c.dataType.typeName() == "double" else F.col(c.name) for c in kept.schema.fields]
    order = F.desc(metric) if direction in ("max", "maximize") else F.asc(metric)
    return kept.select(*finite).where(F.col(metric).isNotNull()).orderBy(order, RUN)


def top(results: DataFrame, k: int, metric: str = "sharpe", direction: str = "max", min_trades: int = 0) -> DataFrame:
    return rank(results, metric, direction, min_trades).limit(k)


def sweep_table(results: DataFrame, x: str, y: str, z: str, values: list, agg: Callable[[str], Column] = F.max) -> DataFrame:
    """A row for each value of y, a column for each of the values of x."""
    return results.groupBy(y).pivot(x, values).agg(agg(z))


def _draw(spec, r: random.Random):
    """Two numbers are a range, anything else a choice."""
    numbers = isinstance(spec, (list, tuple)) and len(spec) == 2 and all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in spec)
    if not numbers:
        return r.choice(list(spec))
    return r.randint(*spec) if all(isinstance(v, int) for v in spec) else r.uniform(*map(float, spec))


def draws(space: dict[str, list], n: int, r: random.Random, valid: Callable[[dict], bool] | None = None, seen: set[str] | None = None) -> list[dict]:
    """n different random points of a space, or as many as fifty times as many tries find."""
    seen = set() if seen is None else seen
    out: list[dict] = []
    for _ in range(50 * n):
        if len(out) == n:
            break
        p = {k: _draw(v, r) for k, v in space.items()}
        mark = json.dumps(p, sort_keys=True, default=str)
        if mark not in seen and (valid is None or valid(p)):
            seen.add(mark)
            out.append(p)
    return out


def random_search(bars: DataFrame, strategy: type[Strategy], space: dict[str, list], cfg: BacktestConfig, metric: str = "sharpe", direction: str = "max", n_trials: int = 50, valid: Callable[[dict], bool] | None = None, seed: int = 0, rounds: int = 1, keep: float = 0.25) -> DataFrame:
    """Random trials in batches; later rounds draw ranges around the best of the rounds before.

    Every batch is one Spark job over all symbols; a trial's value is its mean metric over symbols. Returns
    all trials' rows with the round they were drawn in.
    """
    r = random.Random(seed)
    narrowed = dict(space)
    seen: set[str] = set()
    out, first = None, 0
    for turn in range(max(1, rounds)):
        trials = draws(narrowed, -(-n_trials // max(1, rounds)), r, valid, seen)
        if not trials:
            break
        rows = sweep(bars, [(p, strategy(**p)) for p in trials], [({}, cfg)]).withColumn(RUN, F.col(RUN) + first).withColumn("round", F.lit(turn))
        first += len(trials)
        out = rows if out is None else out.unionByName(rows)
        if turn + 1 < rounds:
            mean = rows.groupBy(RUN).agg(F.avg(metric).alias("m")).where("m is not null")
            best = mean.orderBy(F.desc("m") if direction in ("max", "maximize") else F.asc("m")).limit(max(1, int(keep * len(trials)))).collect()  # at most n_trials rows
            good = [trials[b[RUN] - (first - len(trials))] for b in best]
            for k, spec in space.items():
                if good and len(spec) == 2 and all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in spec):
                    room = (spec[1] - spec[0]) / 8
                    lo, hi = min(g[k] for g in good), max(g[k] for g in good)
                    if all(isinstance(v, int) for v in spec):
                        room = max(1, round(room))
                    narrowed[k] = (max(spec[0], lo - room), min(spec[1], hi + room))
    if out is None:
        raise ValueError("no valid trial")
    return out


def halving_search(bars: DataFrame, strategy: type[Strategy], space: dict[str, list], cfg: BacktestConfig, metric: str = "sharpe", direction: str = "max", n_trials: int = 64, valid: Callable[[dict], bool] | None = None, seed: int = 0, rungs: int = 3, keep: float = 0.5) -> DataFrame:
    """Successive halving: random trials on a short head of the bars; the best go on to a longer one, the last few
    to all of it.

    Rung k of n reads the bars in the first keep ** (n - 1 - k) of the time that all bars span, to the second, and
    every rung but the last hands on the best keep of its trials (one at least) by their mean metric over symbols,
    ties by number; trials without a value come last. Each rung is one sweep, so a trial is simulated from the
    start in every rung that it reaches. Returns the rows of all rungs, with their rung.
    """
    if rungs < 1 or not 0 < keep <= 1:
        raise ValueError("rungs must be at least 1, keep above 0 and at most 1")
    trials = dict(enumerate(draws(space, n_trials, random.Random(seed), valid)))
    if not trials:
        raise ValueError("no valid trial")
    span = bars.agg(F.unix_seconds(F.min(TIME).cast("timestamp")).alias("a"), F.unix_seconds(F.max(TIME).cast("timestamp")).alias("b")).first()
    out = None
    for rung in range(rungs):
        head = bars
        if rung < rungs - 1 and span.a is not None:
            until = span.a + math.floor((span.b - span.a) * keep ** (rungs - 1 - rung))
            head = bars.where(F.col(TIME) <= F.timestamp_seconds(F.lit(until)).cast("timestamp_ntz"))
        numbers = F.array(*[F.lit(k).cast("long") for k in trials])
        rows = sweep(head, [(p, strategy(**p)) for p in trials.values()], [({}, cfg)]).withColumn(RUN, F.element_at(numbers, (F.col(RUN) + 1).cast("int"))).withColumn("rung", F.lit(rung))
        out = rows if out is None else out.unionByName(rows)
        if rung < rungs - 1:
            told = _means(rows, metric)
            sign = -1 if direction in ("max", "maximize") else 1
            ranked = sorted(trials, key=lambda k: (told.get(k) is None, sign * (told.get(k) or 0.0), k))  # noqa: B023
            trials = {k: trials[k] for k in sorted(ranked[: max(1, int(keep * len(trials)))])}
    return out


def _means(rows: DataFrame, metric: str) -> dict[int, float]:
    """Each run's mean over symbols of the metric, infinities left out: one number a trial."""
    value = F.when(F.abs(metric) != float("inf"), F.col(metric))
    return {x[RUN]: x["m"] for x in rows.groupBy(RUN).agg(F.avg(value).alias("m")).collect()}


@dataclass
class Trial:
    """Parameters, and the metric's mean over symbols; None where no symbol has it."""

    number: int
    params: dict
    value: float | None


@dataclass
class Study:
    """Trials of a search in order."""

    direction: str
    trials: list[Trial] = field(default_factory=list)

    def table(self, spark: SparkSession) -> DataFrame:
        """The trials as rows of number, params (JSON) and value, to be kept wherever Spark writes."""
        return spark.createDataFrame([(t.number, json.dumps(t.params), t.value) for t in self.trials], "number long, params string, value double")

    @classmethod
    def of(cls, table: DataFrame, direction: str) -> Study:
        """The study whose trials are the rows of a table."""
        rows = table.select("number", "params", "value").sort("number", "params").collect()  # one row a trial
        return cls(direction, [Trial(k, json.loads(r.params), r.value) for k, r in enumerate(rows)])

    def ranked(self) -> list[Trial]:
        """Trials with a value, the best first."""
        known = [t for t in self.trials if t.value is not None]
        return sorted(known, key=lambda t: -t.value if self.direction in ("max", "maximize") else t.value)

    @property
    def best_trial(self) -> Trial:
        if not self.ranked():
            raise ValueError("no trial has a value")
        return self.ranked()[0]

    @property
    def best_params(self) -> dict:
        return self.best_trial.params

    @property
    def best_value(self) -> float:
        return self.best_trial.value


def _is_range(spec) -> bool:
    return isinstance(spec, (list, tuple)) and len(spec) == 2 and all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in spec)


def _log_density(spec, value, seen: list) -> float:
    """Log density of a value by a Parzen estimate over the values seen and one wide prior."""
    if not _is_range(spec):
        return math.log((sum(v == value for v in seen) + 1 / len(spec)) / (len(seen) + 1))
    room = float(spec[1] - spec[0]) or 1.0
    width = room / (1 + len(seen)) ** 0.5
    bells = [math.exp(-0.5 * ((value - m) / s) ** 2) / s for m, s in [(spec[0] + room / 2, room), *((v, width) for v in seen)]]
    return math.log(sum(bells) / len(bells) + 1e-300)


def _propose(space: dict[str, list], good: list[dict], rest: list[dict], r: random.Random, draws: int = 24) -> dict:
    """Of draws near good trials, parameter by parameter, the one that is likelier among these than among the rest."""
    out = {}
    for name, spec in space.items():
        near = []
        for _ in range(draws):
            base = r.choice([*good, None])
            if base is None or not _is_range(spec):
                near.append(_draw(spec, r) if base is None else base[name])
            else:
                v = r.gauss(base[name], (spec[1] - spec[0]) / (1 + len(good)) ** 0.5)
                v = min(max(v, spec[0]), spec[1])
                near.append(round(v) if all(isinstance(x, int) for x in spec) else v)
        out[name] = max(near, key=lambda v: _log_density(spec, v, [g[name] for g in good]) - _log_density(spec, v, [b[name] for b in rest]))  # noqa: B023
    return out


def model_search(bars: DataFrame, strategy: type[Strategy], space: dict[str, list], cfg: BacktestConfig, metric: str = "sharpe", direction: str = "maximize", n_trials: int = 50, valid: Callable[[dict], bool] | None = None, seed: int = 0, batch: int = 8, startup: int = 10, good_share: float = 0.25, study: Study | None = None) -> Study:
    """A study whose trials are drawn by a model of which parameters did well (tree-structured Parzen estimates).

    The first startup trials are random. Then trials with a value are parted into a good share and the rest, and
    each parameter is drawn where the good ones are likelier than the others. Trials run batch by batch, each
    batch one Spark job over all symbols; one row a trial is collected.

    study: one to go on with, or earlier trials to begin from (in the same direction): n_trials are added to it,
    none of which repeats one of its own.
    """
    study = Study(direction) if study is None else study
    if study.direction not in (("max", "maximize") if direction in ("max", "maximize") else ("min", "minimize", direction)):
        raise ValueError(f"the study goes for {study.direction!r}")
    r = random.Random(f"{seed}/{len(study.trials)}") if study.trials else random.Random(seed)
    seen: set[str] = {json.dumps(t.params, sort_keys=True, default=str) for t in study.trials}
    n_trials += len(study.trials)
    while len(study.trials) < n_trials:
        ranked = study.ranked()
        n_good = max(1, math.ceil(good_share * len(ranked)))
        wanted = min(batch, n_trials - len(study.trials))
        params: list[dict] = []
        for attempt in range(200 * wanted):
            if len(params) == wanted:
                break
            # where the model only draws what has been tried, chance finds the rest
            random_ = len(study.trials) < startup or len(ranked) < 2 or attempt > 20 * wanted
            p = {k: _draw(v, r) for k, v in space.items()} if random_ else _propose(space, [t.params for t in ranked[:n_good]], [t.params for t in ranked[n_good:]], r)
            mark = json.dumps(p, sort_keys=True, default=str)
            if mark not in seen and (valid is None or valid(p)):
                seen.add(mark)
                params.append(p)
        if not params:
            break  # the space has no further valid point that was found
        rows = sweep(bars, [(p, strategy(**p)) for p in params], [({}, cfg)])
        told = _means(rows, metric)
        study.trials += [Trial(len(study.trials) + k, p, told.get(k)) for k, p in enumerate(params)]
    if not study.trials:
        raise ValueError("no valid trial")
    return study


@dataclass
class Experiment:
    """A named search over strategy parameters and account settings, ranked by a metric."""

    name: str
    strategy: type[Strategy]
    base_cfg: BacktestConfig = field(default_factory=BacktestConfig)
    description: str = ""
    strategy_space: dict[str, list] = field(default_factory=dict)
    cfg_space: dict[str, list] = field(default_factory=dict)
    fixed: dict = field(default_factory=dict)
    metric: str = "sharpe"
    direction: str = "max"
    min_trades: int = 0
    valid: Callable[[dict], bool] | None = None

    def run(self, bars: DataFrame) -> DataFrame:
        """All runs, ranked. valid() sees parameters and settings together."""
        fits = self.valid or (lambda p: True)
        strategies = expand_grid(self.strategy_space)
        settings = expand_grid(self.cfg_space)
        groups: dict[tuple[int, ...], list[dict]] = {}
        for s in strategies:
            groups.setdefault(tuple(k for k, c in enumerate(settings) if fits({**s, **c})), []).append(s)
        groups.pop((), None)
        if not groups:
            raise ValueError("the experiment has no valid run")
        runs = [s | settings[k] for allowed, members in groups.items() for s in members for k in allowed]
        first = itertools.accumulate((len(allowed) * len(members) for allowed, members in groups.items()), initial=0)
        parts = (_parts(bars, [self.strategy(**(self.fixed | s)) for s in members], [self.base_cfg.replace(**settings[k]) for k in allowed], at) for (allowed, members), at in zip(groups.items(), first, strict=False))
        out = _labelled(stage_parts(itertools.chain.from_iterable(parts), "runs"), dict(enumerate(runs)))
        return rank(out, self.metric, self.direction, self.min_trades)

    def write(self, ranked: DataFrame, folder: str, best: int = 15) -> None:
        """results (CSV, written by Spark), best.json and report.md with the first rows."""
        ranked.write.mode("overwrite").option("header", True).csv(f"{folder}/results")
        head = [r.asDict() for r in ranked.limit(best).collect()]
        Path(folder, "best.json").write_text(json.dumps(head[0] if head else {}, default=str, indent=2))
        names = list(head[0]) if head else []
        lines = [f"# {self.name}", "", self.description, "", f"Ranked by {self.metric} ({self.direction}), at least {self.min_trades} trades.", "", "| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
        lines += ["| " + " | ".join(f"{v:.4g}" if isinstance(v, float) else str(v) for v in r.values()) + " |" for r in head]
        Path(folder, "report.md").write_text("\n".join(lines) + "\n")
