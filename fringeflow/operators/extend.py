"""Where a user's own code goes: layers, group workers, statistics plug-ins, tasks and parallel algorithms."""

from __future__ import annotations

import functools
import inspect
import logging
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Layer = Callable[[DataFrame], DataFrame]
_LAYERS: dict[str, Callable[..., Layer]] = {}
LOG = logging.getLogger("fringeflow")


def layer(name: str) -> Callable:
    """Registers a maker of layers: a function of parameters that gives a function from DataFrame to DataFrame."""

    def keep(make: Callable[..., Layer]) -> Callable[..., Layer]:
        _LAYERS[name] = make
        return make

    return keep


@layer("pass_through")
def _pass_through() -> Layer:
    return lambda df: df


def stack(df: DataFrame, *layers: tuple[str, dict] | Layer) -> DataFrame:
    """A table through layers, named ones with their parameters or functions. One plan comes of it."""

    def made(x) -> Layer:
        return x if callable(x) else _LAYERS[x[0]](**x[1])

    return reduce(lambda d, x: d.transform(made(x)), layers, df)


def for_each_group(df: DataFrame, keys: list[str], work: Callable, schema: str) -> DataFrame:
    """A pandas function of each group of equal keys; a group has to fit a worker's memory."""
    return df.groupBy(*keys).applyInPandas(work, schema)


class Statistic:
    """A statistic whose state can be merged: zero(), add(state, values), merge(state, state), result(state). States are
    lists of doubles, made per batch before the shuffle, so a group is never gathered."""

    def zero(self) -> list[float]:
        raise NotImplementedError

    def add(self, state: list[float], values) -> list[float]:
        raise NotImplementedError

    def merge(self, a: list[float], b: list[float]) -> list[float]:
        raise NotImplementedError

    def result(self, state: list[float]) -> float:
        raise NotImplementedError


def plugged(df: DataFrame, keys: list[str], value: str, statistic: Statistic, name: str = "value") -> DataFrame:
    """A plug-in statistic per group: partial states per task and group, then their merger."""
    import pandas as pd

    kinds = dict(df.dtypes)
    key_schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys)

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list[float]] = {}
        for p in frames:
            for key, g in p.groupby(keys, dropna=False)[value]:
                key = key if isinstance(key, tuple) else (key,)
                held[key] = statistic.add(held.get(key) or statistic.zero(), g.to_numpy())
            if len(held) > 100_000:  # a worker holds so many states at most
                yield pd.DataFrame([(*k, s) for k, s in held.items()], columns=[*keys, "_state"])
                held = {}
        yield pd.DataFrame([(*k, s) for k, s in held.items()], columns=[*keys, "_state"])

    def final(p: pd.DataFrame) -> pd.DataFrame:
        state = reduce(statistic.merge, [list(s) for s in p["_state"]])
        return pd.DataFrame({k: [p[k].iloc[0]] for k in keys} | {name: [statistic.result(state)]})

    parts = df.select(*keys, value).mapInPandas(partial, f"{key_schema}, _state array<double>")
    return parts.groupBy(*keys).applyInPandas(final, f"{key_schema}, {name} double")


def task(function: Callable) -> Callable:
    """A function as a task: its call is logged with all parameters, and a failure too."""

    @functools.wraps(function)
    def run(*args, **kwargs):
        bound = inspect.signature(function).bind(*args, **kwargs)
        bound.apply_defaults()
        shown = ", ".join(f"{k}={v!r}" for k, v in bound.arguments.items() if not isinstance(v, (DataFrame, SparkSession)))
        LOG.info("%s(%s)", function.__name__, shown)
        try:
            return function(*args, **kwargs)
        except Exception:
            LOG.exception("%s failed", function.__name__)
            raise

    run.last_default = {k: p.default for k, p in inspect.signature(function).parameters.items() if p.default is not p.empty}
    return run


class Algorithm:
    """Work that is dealt out: get() a list of small inputs, task() one of them on an executor, put() each result."""

    schema: str = "result double"

    def get(self) -> list[Any]:
        raise NotImplementedError

    def task(self, item: Any) -> tuple:
        raise NotImplementedError


def dealt(spark: SparkSession, algorithm: Algorithm) -> DataFrame:
    """The results of an algorithm's tasks, one row each, with the input's number."""
    import pandas as pd

    items = algorithm.get()
    names = [c.strip().split()[0] for c in algorithm.schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in frames:
            yield pd.DataFrame([(i, *algorithm.task(items[i])) for i in p["id"]], columns=["item", *names])

    return spark.range(0, len(items), 1, max(1, len(items))).mapInPandas(run, f"item long, {algorithm.schema}")


def expanded(df: DataFrame, keys: list[str], lists: str, separator: str, name: str) -> DataFrame:
    """A row for each part of a text list, with its place: a table function."""
    return df.select(*keys, F.posexplode(F.split(lists, separator)).alias("place", name))


class TableSink(logging.Handler):
    """A log sink that keeps messages as rows, the newest `most` of them; rows() gives them as a table."""

    def __init__(self, most: int = 10_000):
        super().__init__()
        from collections import deque

        self.held: deque = deque(maxlen=most)

    def emit(self, record: logging.LogRecord) -> None:
        self.held.append((record.created, record.levelname, record.name, record.getMessage()))

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.held), "time double, priority string, origin string, message string")
