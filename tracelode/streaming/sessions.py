"""Stream forms of the stateful operators: sessions of alerts with late data, and alarms with a cooldown."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def session_counts(stream: DataFrame, time: str, entity: str, gap: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Sessions of an entity's events that are at most `gap` apart; events later than `late` are dropped."""
    grouped = stream.withWatermark(time, late).groupBy(entity, F.session_window(time, gap).alias("s"))
    return grouped.agg(F.count("*").alias("n")).select(entity, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def cooldown_alarms(stream: DataFrame, time: str, entity: str, seconds: int = 86_400) -> DataFrame:
    """The events that are at least `seconds` after the last one kept of their entity; that time is the only state.

    Events reach a batch in any order and are sorted within it; one that is older than the last kept is not raised."""

    def keep(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last: Any = state.get[0] if state.exists else None
        times = sorted(pd.concat([p[[time]] for p in parts])[time])
        out = []
        for t in times:
            if last is None or (t - last).total_seconds() >= seconds:
                out.append(t)
                last = t
        if last is not None:
            state.update((last.to_pydatetime() if hasattr(last, "to_pydatetime") else last,))
        yield pd.DataFrame({entity: [key[0]] * len(out), time: out})

    kind = dict(stream.dtypes)
    return stream.select(entity, time).groupBy(entity).applyInPandasWithState(keep, f"{entity} {kind[entity]}, {time} timestamp", "last timestamp", "append", GroupStateTimeout.NoTimeout)
