"""Streaming forms of the time averages. Each takes a stream (or a table) with a timestamp column and gives the same rows as the batch form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _aggregate(df: DataFrame, window: Column, keys: list[str], value: str, weight: str | None) -> DataFrame:
    w = F.col(weight) if weight else F.lit(1.0)
    g = df.groupBy(window.alias("w"), *keys).agg((F.sum(F.col(value) * w) / F.sum(w)).alias("mean"), F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "mean", "n")


def tumbling(df: DataFrame, time: str, width: str, late: str, keys: list[str], value: str, weight: str | None = None) -> DataFrame:
    """Weighted means of blocks of time. Rows later than `late` behind the newest are dropped and their state with them."""
    return _aggregate(df.withWatermark(time, late), F.window(time, width), keys, value, weight)


def sliding(df: DataFrame, time: str, width: str, slide: str, late: str, keys: list[str], value: str, weight: str | None = None) -> DataFrame:
    return _aggregate(df.withWatermark(time, late), F.window(time, width, slide), keys, value, weight)


def sessions(df: DataFrame, time: str, gap: str, late: str, keys: list[str], value: str) -> DataFrame:
    """Runs of rows without a gap as long as `gap`."""
    return _aggregate(df.withWatermark(time, late), F.session_window(time, gap), keys, value, None)


def idle_batches(df: DataFrame, time: str, keys: list[str], value: str, idle: str, late: str) -> DataFrame:
    """One row a key and run of rows, closed once the key has been idle for that long (event time): keys, first, last, n, total.

    A stream's open runs are the state: five numbers a key, however many rows a run has.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", first double, last double, n long, total double"
    gap = pd.Timedelta(idle).total_seconds()

    def run(key: tuple, frames, state: GroupState):
        first, last, n, total = state.get if state.exists else (0.0, 0.0, 0, 0.0)
        done = []
        if state.hasTimedOut:
            done, n = [(*key, first, last, n, total)], 0
            state.remove()
        else:
            rows = pd.concat(list(frames)).sort_values("_t")
            for t, v in zip(rows["_t"], rows["_v"]):
                if n and t - last > gap:
                    done.append((*key, first, last, n, total))
                    n = 0
                if not n:
                    first, total = t, 0.0
                last, n, total = t, n + 1, total + v
            state.update((first, last, n, total))
            state.setTimeoutTimestamp(max(int((last + gap) * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(done, columns=[*keys, "first", "last", "n", "total"])

    d = df.withWatermark(time, late).select(*keys, time, F.unix_micros(F.col(time).cast("timestamp")).alias("_us"), F.col(value).cast("double").alias("_v")).withColumn("_t", F.col("_us") / 1e6)
    return d.groupBy(*keys).applyInPandasWithState(run, schema, "first double, last double, n long, total double", "append", GroupStateTimeout.EventTimeTimeout)
