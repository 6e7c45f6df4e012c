"""Circuit breaker of each provider, live: opens on the error share of its last seconds.

Calls are counted by provider and second before they meet state, so a busy provider sends one row a
second to its key, whatever its traffic. Those counts leave the aggregate once the watermark has
passed their second and are final: a call later than that is dropped with its second. The breaker's
state is a list of the last ``window_s`` seconds and the end of the open interval; event-time timers
close the interval and drop the seconds of a provider that went silent.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

EVENTS = "provider string, event string, at_s bigint, until_s bigint"


class _Breaker(StatefulProcessor):
    def __init__(self, share: float, window_s: int, cooldown_s: int) -> None:
        self.share, self.window_s, self.cooldown_s = share, window_s, cooldown_s

    def init(self, handle) -> None:
        self.handle = handle
        self.recent = handle.getListState("recent", "s bigint, calls bigint, errors bigint")
        self.open = handle.getValueState("open", "until_s bigint")

    def _until(self) -> int | None:
        return self.open.get()[0] if self.open.exists() else None

    def _keep(self, recent: list[tuple[int, int, int]]) -> None:
        if recent:
            self.recent.put(recent)
            # The last of them is no context any more one window later.
            self.handle.registerTimer((recent[-1][0] + self.window_s) * 1000)
        elif self.recent.exists():
            self.recent.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seconds = pd.concat(list(rows), ignore_index=True).sort_values("s")
        recent = [tuple(r) for r in self.recent.get()] if self.recent.exists() else []
        until, out = self._until(), []
        for s, calls, errors in zip(seconds["s"].tolist(), seconds["calls"].tolist(), seconds["errors"].tolist(), strict=True):
            recent = [r for r in recent if r[0] > s - self.window_s] + [(s, calls, errors)]
            if until is not None and s >= until:
                out.append((key[0], "closed", until, until))
                until = None
            if until is None and sum(r[2] for r in recent) >= self.share * sum(r[1] for r in recent):
                until = s + self.cooldown_s
                out.append((key[0], "opened", s, until))
        self._keep(recent)
        if until is None:
            self.open.clear()
        else:
            self.open.update((until,))
            self.handle.registerTimer(until * 1000)
        yield pd.DataFrame(out, columns=["provider", "event", "at_s", "until_s"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out = expiredTimerInfo.getExpiryTimeInMs() // 1000, []
        if (until := self._until()) is not None and until <= now:
            self.open.clear()
            out.append((key[0], "closed", until, until))
        if self.recent.exists() and list(self.recent.get())[-1][0] + self.window_s <= now:
            self.recent.clear()
        yield pd.DataFrame(out, columns=["provider", "event", "at_s", "until_s"])

    def close(self) -> None:
        pass


def live_breaker(calls: DataFrame, late: str = "10 seconds", share: float = 0.5, window_s: int = 30, cooldown_s: int = 60) -> DataFrame:
    """Events of a stream of calls (provider, ts, failed): ``opened`` at a second until another, and ``closed``.

    Same rule as ``operators.finops.breaker_intervals``: a breaker opens at the first second whose last
    ``window_s`` seconds reach the error share, and may open again ``cooldown_s`` later. Calls up to
    ``late`` behind the latest are counted; a second is judged once the watermark has passed it, so an
    opening is known that much later. Rows without time are dropped; a null provider is a provider.
    Start the stream inside ``state.rocksdb``.
    """
    seconds = (
        calls.withWatermark("ts", late)
        .groupBy("provider", F.window("ts", "1 second"))
        .agg(F.count(F.lit(1)).alias("calls"), F.count_if("failed").alias("errors"))
        .select("provider", F.window_time("window").alias("ts"), F.unix_seconds("window.start").alias("s"), "calls", "errors")
    )
    return seconds.groupBy("provider").transformWithStateInPandas(
        _Breaker(share, window_s, cooldown_s), EVENTS, "append", "EventTime"
    )
