"""Interval maps in keyed state: periods and gaps kept up to date as spans arrive."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

from orrery.operators.intervals import IntervalMap


def stream_periods(spans: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """A stream of (key, periods, gaps): after every micro-batch the whole interval map of each key it touched, as arrays.

    ``spans`` is a stream with a BIGINT key; start and end are BIGINT and both belong to the span; rows with either NULL, or reversed, are no spans.
    The state of a key is its disjoint intervals; each arrival finds what it overlaps by binary search.
    """

    def update(k: tuple[Any, ...], frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        m = IntervalMap.of(*state.get) if state.exists else IntervalMap()
        for frame in frames:
            for a, b in zip(frame[start], frame[end], strict=True):
                if not pd.isna(a) and not pd.isna(b):
                    m.insert(int(a), int(b))
        state.update((m.starts, m.ends))
        yield pd.DataFrame({"key": [k[0]], "periods": [[f"{a}-{b}" for a, b in m.periods()]], "gaps": [[f"{a}-{b}" for a, b in m.gaps()]]})

    rows = spans.selectExpr(f"CAST({key} AS BIGINT) AS key", f"CAST({start} AS BIGINT) AS {start}", f"CAST({end} AS BIGINT) AS {end}").filter("key IS NOT NULL")
    return rows.groupBy("key").applyInPandasWithState(update, "key bigint, periods array<string>, gaps array<string>", "starts array<bigint>, ends array<bigint>", "update", "NoTimeout")
