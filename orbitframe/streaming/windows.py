"""Temporal windows over a stream of observations: our own extension, no part of the batch processing.

A position's state is the set of months seen. A month that comes late makes the
windows around it anew, so nothing is dropped by event time; state ends only
with the position. The last word on each window is what a batch would give.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from orbitframe.functions import constants as K

OUT = "pos long, window_idx int, window_months string, version int"


def streaming_windows(observations: DataFrame, n: int = K.WINDOW_MONTHS) -> DataFrame:
    """``observations`` (streaming ``pos long, month_idx int``) -> windows that are new or changed, by ``version``."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        months, version = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        before = _runs(months, n)
        fresh = {int(m) for pdf in frames for m in pdf["month_idx"].dropna()}
        months = sorted(fresh | set(months))
        version += 1
        state.update((months, version))
        after = _runs(months, n)
        changed = [(key[0], i, w, version) for i, w in enumerate(after) if i >= len(before) or before[i] != w]
        yield pd.DataFrame(changed, columns=["pos", "window_idx", "window_months", "version"])

    return observations.groupBy("pos").applyInPandasWithState(update, OUT, "months array<int>, version int", "append", GroupStateTimeout.NoTimeout)


def _runs(months: list[int], n: int) -> list[str]:
    return [",".join(map(str, months[i : i + n])) for i in range(len(months) - n + 1)]


def latest(windows: DataFrame) -> DataFrame:
    """The last version of every window."""
    from pyspark.sql import functions as F

    return windows.groupBy("pos", "window_idx").agg(F.max_by("window_months", "version").alias("window_months"))
