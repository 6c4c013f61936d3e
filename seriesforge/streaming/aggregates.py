"""Streaming twins of the bucketed aggregate and the z-score screen (beyond batch analysis)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.series import metric


def windowed(stream: DataFrame, ts: str, width: str, metrics: list[tuple[str, str]], keys: list[str], late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Metrics by time window and group; rows later than ``late`` are dropped, closed windows come out once."""
    span = F.window(ts, width, slide) if slide else F.window(ts, width)
    out = stream.withWatermark(ts, late).groupBy(span.alias("window"), *keys).agg(*[metric(a, c) for a, c in metrics])
    return out.select(*keys, F.col("window.start").alias("period"), *[c for c in out.columns if c not in ("window", *keys)])


def running_zscores(stream: DataFrame, key: str, ts: str, value: str, threshold: float = 3.0, least: int = 10) -> DataFrame:
    """Values over the threshold against the mean and deviation of all earlier ones of their key."""
    kinds = dict(stream.dtypes)

    def step(name: tuple, batches, state: GroupState):
        n, mean, m2 = state.get if state.exists else (0, 0.0, 0.0)
        rows = pd.concat(list(batches)).sort_values([ts, value])
        out = []
        for t, v in zip(rows[ts], rows[value]):
            if n >= least and m2 > 0:
                z = (v - mean) / (m2 / n) ** 0.5
                if abs(z) > threshold:
                    out.append((name[0], t, v, z))
            n += 1
            d = v - mean
            mean += d / n
            m2 += d * (v - mean)
        state.update((n, mean, m2))
        yield pd.DataFrame(out, columns=[key, ts, value, "z_score"])

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {ts} {kinds[ts]}, {value} {kinds[value]}, z_score double", "n long, mean double, m2 double", "append", GroupStateTimeout.NoTimeout)


def run_to_end(out: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a finite stream into a table in memory; for tests and small replays."""
    q = out.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return out.sparkSession.table(name)
