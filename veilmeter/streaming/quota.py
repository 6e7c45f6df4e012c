"""Live minute quotas shared by all workers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DECISIONS = (
    "request_id bigint, tenant string, bucket bigint, rpm_count bigint, tpm_count bigint, "
    "reason string, admitted boolean"
)
_COUNTERS = "requests bigint, tokens bigint"
#: Event time a counter outlives its last request, once the watermark has passed that.
KEEP_MS = 120_000


def _admitting(event_time: str | None):
    def handle(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        requests, tokens = state.get if state.exists else (0, 0)
        rows = pd.concat(list(batches), ignore_index=True).sort_values(["ts", "request_id"])
        count = requests + np.arange(1, len(rows) + 1)
        passed = count <= rows["rpm"].to_numpy()
        spent = tokens + np.cumsum(np.where(passed, rows["tokens"].to_numpy(), 0))
        fits = passed & (spent <= rows["tpm"].to_numpy())
        state.update((int(count[-1]), int(spent[-1])))
        if event_time:
            seen = int(pd.to_datetime(rows[event_time]).max().value // 1_000_000)
            state.setTimeoutTimestamp(max(seen, state.getCurrentWatermarkMs()) + KEEP_MS)
        yield pd.DataFrame({
            "request_id": rows["request_id"].to_numpy(),
            "tenant": key[0],
            "bucket": key[1],
            "rpm_count": count,
            "tpm_count": pd.Series(spent, dtype="Int64").where(passed),
            "reason": np.where(fits, None, np.where(passed, "tpm", "rpm")),
            "admitted": fits,
        })

    return handle


def admit(requests: DataFrame, event_time: str | None = "event_time", late: str = "10 minutes") -> DataFrame:
    """Decide a stream of requests: request_id, tenant, bucket, ts, tokens, rpm, tpm, event_time.

    Counters live per tenant and minute, so a busy tenant spreads over the minutes. They are dropped
    in event time, once requests are more than ``late`` past them: a backlog or a request up to that
    late meets its minute's counts. A request later than that gets no decision, which the caller takes
    as refused. ``event_time`` names a timestamp; None keeps every counter and decides everything.
    """
    timeout = GroupStateTimeout.EventTimeTimeout if event_time else GroupStateTimeout.NoTimeout
    if event_time:
        requests = requests.withWatermark(event_time, late)
    return requests.groupBy("tenant", "bucket").applyInPandasWithState(
        _admitting(event_time), DECISIONS, _COUNTERS, "append", timeout
    )
