"""The status log as a stream: validation against the last status, and windowed counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from talentloom.operators.writes import TRANSITIONS

_ALLOWED = frozenset(TRANSITIONS)


def _judge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Accepts an entry if it may follow the last accepted one; the first is always accepted.

    All of the key's entries of a micro-batch are put in order first, however many chunks they come in.
    """
    last = state.get[0] if state.exists else None
    rows = pd.concat(list(batches)).sort_values(["changed_at", "id"])
    accepted = []
    for new in rows["new_status"]:
        ok = last is None or (last, new) in _ALLOWED
        accepted.append(ok)
        last = new if ok else last
    yield rows.assign(accepted=accepted)[["application_id", "id", "new_status", "changed_at", "accepted"]]
    state.update((last,))


def validated(log: DataFrame) -> DataFrame:
    """A log stream (application_id, id, new_status, changed_at) with ``accepted``; state is one status an application.

    It never expires: a status that ends an application refuses whatever comes after it, at any time.
    """
    return log.select("application_id", "id", "new_status", "changed_at").groupBy("application_id").applyInPandasWithState(
        _judge, "application_id long, id long, new_status string, changed_at timestamp, accepted boolean", "last string", "append", GroupStateTimeout.NoTimeout
    )


def counts_by_window(log: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Entries by status and window; rows later than the watermark are left out."""
    counted = log.withWatermark("changed_at", late).groupBy(F.window("changed_at", window), "new_status").count()
    return counted.select(F.col("window.start").alias("start"), "new_status", "count")
