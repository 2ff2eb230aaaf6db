"""Series from an unbounded source: windowed values with a watermark, and anomaly flags with state per series.

The batch operators take a table of series; these feed them from a stream. `windowed` keeps only open windows as state,
`flag_changes` a few running sums for each series.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed(events: DataFrame, group: str, time: str, value: str, every: str = "1 day", late: str = "2 days") -> DataFrame:
    """group, ds, y, n: sums of `value` in tumbling windows; rows later than the watermark are left out."""
    w = events.withWatermark(time, late).groupBy(F.window(time, every), F.col(group)).agg(F.sum(F.col(value).cast("double")).alias("y"), F.count(F.lit(1)).alias("n"))
    return w.select(group, F.col("window.start").alias("ds"), "y", "n")


def flag_changes(rows: DataFrame, group: str, time: str, value: str, threshold: float = 4.0, warm_up: int = 10) -> DataFrame:
    """group, time, value, z, is_change: each value against the running mean and deviation of its series so far.

    The state of a series is (count, mean, sum of squares); rows of one micro-batch are taken in the order of time.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"{group} {kinds[group]}, {time} {kinds[time]}, {value} double, z double, is_change boolean"

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, mean, m2 = state.get if state.exists else (0, 0.0, 0.0)
        for frame in frames:
            out = []
            for t, x in frame.sort_values(time)[[time, value]].itertuples(index=False):
                sd = (m2 / (n - 1)) ** 0.5 if n > 1 else 0.0
                z = (x - mean) / sd if sd > 0 else 0.0
                out.append((key[0], t, float(x), z, bool(n >= warm_up and abs(z) > threshold)))
                n += 1
                d = x - mean
                mean += d / n
                m2 += d * (x - mean)
            yield pd.DataFrame(out, columns=[group, time, value, "z", "is_change"])
        state.update((n, mean, m2))

    picked = rows.select(group, time, F.col(value).cast("double").alias(value)).where(F.col(value).isNotNull())
    return picked.groupBy(group).applyInPandasWithState(step, schema, "n long, mean double, m2 double", "append", GroupStateTimeout.NoTimeout)
