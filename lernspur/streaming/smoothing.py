"""Exponential smoothing of a series as a stream, the twin of ``operators.trajectory.ema``."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def ema_stream(rows: DataFrame, group: str, order: str, value: str, alpha: float = 0.4, most_missed: int = 8) -> DataFrame:
    """(group, order, smooth) of every row; a missing value holds the last up to ``most_missed`` times, then resets."""
    kind, at = rows.schema[group].dataType.simpleString(), rows.schema[order].dataType.simpleString()

    def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        last, missed = held.get if held.exists else (None, 0)
        out = []
        log = pd.concat(list(batches)).sort_values(order)
        for t, v in zip(log[order], log[value], strict=True):
            if pd.isna(v):
                missed += 1
                last = None if missed > most_missed else last
            else:
                last, missed = float(v) if last is None else last + (float(v) - last) * alpha, 0
            out.append((key[0], t, last))
        held.update((last, missed))
        yield pd.DataFrame(out, columns=[group, order, "smooth"])

    return rows.groupBy(group).applyInPandasWithState(step, f"{group} {kind}, {order} {at}, smooth double", "last double, missed int", "append", GroupStateTimeout.NoTimeout)
