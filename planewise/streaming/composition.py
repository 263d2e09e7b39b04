"""Compositions of a stream of categorical events in windows or sessions, and how far they drift."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from planewise.functions.metrics import hellinger_of_roots
from planewise.shipping import ship

DRIFT = "window_start timestamp, object_id string, n long, n_before long, drift double"


def _counted(events: DataFrame, kinds: tuple[str, ...], span: Column, key: str, kind: str, time: str, late: str) -> DataFrame:
    counts = events.withWatermark(time, late).groupBy(span.alias("span"), F.col(key).alias("owner")).agg(*(F.count(F.when(F.col(kind) == k, 1)).alias(f"n{i}") for i, k in enumerate(kinds)))
    n = sum((F.col(f"n{i}") for i in range(1, len(kinds))), F.col("n0"))
    return counts.where(n > 0).select(F.col("span.start").alias("window_start"), F.col("owner").cast("string").alias("object_id"), n.alias("n"), F.array(*(F.col(f"n{i}") / n for i in range(len(kinds)))).alias("vec"))


def compositions(events: DataFrame, kinds: tuple[str, ...], key: str = "user_id", kind: str = "event_type", time: str = "ts", window: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """(window_start, object_id, n, vec): each key's shares of the kinds in tumbling windows, or sliding ones; later events than ``late`` are dropped.

    Works on a stream and on a table alike; state is one row of counts a key and open window.
    """
    timed = events.withColumn(time, F.col(time).cast("timestamp"))
    return _counted(timed, kinds, F.window(time, window, slide or window), key, kind, time, late)


def sessions(events: DataFrame, kinds: tuple[str, ...], gap: str = "6 hours", key: str = "user_id", kind: str = "event_type", time: str = "ts", late: str = "2 hours") -> DataFrame:
    """(window_start, object_id, n, vec) by sessions: a key's events without a pause of ``gap``; events of other kinds keep a session open.

    Works on a stream and on a table alike; sessions that a late event joins are merged
    while the watermark allows it.  Events without key or time are left out.
    """
    timed = events.withColumn(time, F.col(time).cast("timestamp")).where(F.col(key).isNotNull() & F.col(time).isNotNull())
    return _counted(timed, kinds, F.session_window(time, gap), key, kind, time, late)


class _Drift(StatefulProcessor):
    """Holds one row of counts a key: all kinds seen in the windows before."""

    def __init__(self, dimension: int) -> None:
        self.dimension = dimension

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("counts", ", ".join(f"n{i} long" for i in range(self.dimension)))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(list(rows)).sort_values("window_start", kind="stable")  # a key's windows that close in one trigger
        shares = np.vstack(new["vec"].to_numpy())
        counts = np.rint(shares * new["n"].to_numpy()[:, None]).astype(np.int64)
        before = np.array(self.held.get(), np.int64) if self.held.exists() else np.zeros(self.dimension, np.int64)
        until = before + np.cumsum(counts, axis=0)
        self.held.update(tuple(int(x) for x in until[-1]))
        seen = np.vstack([before, until[:-1]])
        n_before = seen.sum(axis=1)
        with np.errstate(invalid="ignore", divide="ignore"):
            apart = np.minimum(np.sqrt(((np.sqrt(shares) - np.sqrt(seen / n_before[:, None])) ** 2).sum(axis=1) / 2), 1.0)
        yield pd.DataFrame({"window_start": new["window_start"].to_numpy(), "object_id": key[0], "n": new["n"].to_numpy(), "n_before": n_before, "drift": [float(a) if b else None for a, b in zip(apart, n_before, strict=True)]})

    def close(self) -> None:
        """Nothing is held open."""


def drift(windows: DataFrame, dimension: int) -> DataFrame:
    """(window_start, object_id, n, n_before, drift): Hellinger distance of each window's composition to that of all the key's windows before it; null for its first.

    ``windows`` is what ``compositions`` (not sliding) or ``sessions`` gives.  On a stream
    in append mode the counts of a key are its state, kept over restarts by the checkpoint
    (the state store must be RocksDB); windows close in order of time, so a stream gives
    the rows of the table.  On a table it is a running sum over a key's windows.
    """
    if windows.isStreaming:
        ship(windows.sparkSession)
        return windows.groupBy("object_id").transformWithStateInPandas(_Drift(dimension), DRIFT, "Append", "None")
    earlier = Window.partitionBy("object_id").orderBy("window_start").rowsBetween(Window.unboundedPreceding, -1)
    counts = windows.select("window_start", "object_id", "n", "vec", F.sum("n").over(earlier).alias("before"), *(F.sum(F.round(F.col("vec")[i] * F.col("n")).cast("long")).over(earlier).alias(f"b{i}") for i in range(dimension)))
    roots = [F.sqrt(F.col("vec")[i]) for i in range(dimension)], [F.sqrt(F.col(f"b{i}") / F.col("before")) for i in range(dimension)]
    return counts.select("window_start", "object_id", "n", F.coalesce("before", F.lit(0)).alias("n_before"), F.when(F.col("before") > 0, hellinger_of_roots(*roots)).alias("drift"))
