"""Structured Streaming forms of aggregates over observations that arrive over time (an extension; nothing here waits)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_stats(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, metric, n, mean) of observations (ts, metric, score) by window; later ones than `late` are left out."""
    out = events.withWatermark("ts", late).groupBy(F.window("ts", window), "metric").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"))
    return out.select(F.col("window.start").alias("start"), "metric", "n", "mean")


def running_best(events: DataFrame) -> DataFrame:
    """(company, ts, composite) for each observation that beats all that its company had before, in the order of ts within each
    batch. A company's state is one number."""

    def beat(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        best = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).dropna(subset=["ts", "composite"]).sort_values("ts", kind="stable")
        out = []
        for ts, value in zip(rows["ts"], rows["composite"], strict=True):
            if best is None or value > best:
                best = float(value)
                out.append((key[0], ts, best))
        if best is not None:
            state.update((best,))
        yield pd.DataFrame(out, columns=["company", "ts", "composite"])

    return events.groupBy("company").applyInPandasWithState(beat, "company string, ts timestamp, composite double", "best double", "append", "NoTimeout")
