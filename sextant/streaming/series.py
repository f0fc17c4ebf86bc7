"""Stream forms of the windowed computations; each has its batch twin in operators.windows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling(rows: DataFrame, time: str, width: str, by: Sequence[str], aggregates: dict[str, Column], late: str = "10 minutes") -> DataFrame:
    out = rows.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(*[c.alias(k) for k, c in aggregates.items()])
    return out.select(F.col("window.start").alias("start"), *by, *aggregates)


def sessions(rows: DataFrame, time: str, gap_seconds: float, by: Sequence[str], aggregates: dict[str, Column], late: str = "10 minutes") -> DataFrame:
    """Sessions that a gap of ``gap_seconds`` or more ends; built-in windows merge at equality, so a microsecond less."""
    gap = f"{int(gap_seconds * 1_000_000) - 1} microseconds"
    out = rows.withWatermark(time, late).groupBy(F.session_window(time, gap), *by).agg(F.min(time).alias("start"), F.max(time).alias("end"), *[c.alias(k) for k, c in aggregates.items()])
    return out.select(*by, "start", "end", *aggregates)


def quantiles(rows: DataFrame, time: str, width: str, value: str, shares: Sequence[float], late: str = "10 minutes") -> DataFrame:
    out = rows.withWatermark(time, late).groupBy(F.window(time, width)).agg(F.percentile_approx(value, [float(s) for s in shares]).alias("quantiles"), F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("start"), "n", "quantiles")


def clock(rows: DataFrame, source: str = "source") -> DataFrame:
    """Local times (``local``, with ``sync`` on sync lines, in order of ``line``) mapped by the last sync of their source.

    State is one sync a source. Lines before a source's first sync have a null time.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sync, local = state.get if state.exists else (None, None)
        for batch in batches:
            batch, times = batch.sort_values("line"), []
            for x, s in zip(batch["local"], batch["sync"], strict=True):
                if pd.notna(s):
                    sync, local = float(s), float(x)
                times.append(None if sync is None else sync + float(x) - local)
            yield pd.DataFrame({"source": key[0], "line": batch["line"].astype("int64"), "true_time": pd.array(times, dtype="Float64").astype("float64")})
        if sync is not None:
            state.update((sync, local))

    return rows.groupBy(source).applyInPandasWithState(run, "source string, line long, true_time double", "sync double, local double", "append", GroupStateTimeout.NoTimeout)
