"""Silence while it lasts: an event-time timer for each venue, set anew at each message with the venue's own timeout.

A venue's timer stands at its last message plus its timeout. When the watermark passes it and no message has come, the venue
is silent and an OPEN row says so, whatever comes later. The message that ends a silence gives a CLOSED row with its length.
State is one row a venue; messages are only looked at, so a batch costs its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "venue {venue}, status string, silent_from timestamp, silent_us bigint, timeout int"
OPEN, CLOSED = "OPEN", "CLOSED"


class SilenceProcessor(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        #: The last message in microseconds, the venue's timeout in seconds, and when its timer is set for in milliseconds.
        self.last = handle.getValueState("last", "at bigint, timeout int, timer bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, timeout, timer = self.last.get() if self.last.exists() else (None, None, None)
        frame, out = pd.concat(list(rows)).sort_values("at", kind="stable"), []
        for at, seconds in zip(frame["at"].tolist(), frame["timeout"].tolist(), strict=True):
            if last is not None and at - last > seconds * 1_000_000:
                out.append((CLOSED, last, at - last, seconds))
            last, timeout = at if last is None else max(last, at), int(seconds)
        # The first whole millisecond at which the silence is longer than the timeout.
        due = (last + timeout * 1_000_000) // 1000 + 1
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        self.last.update((last, timeout, due))
        yield _frame(key[0], out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, timeout, _ = self.last.get()
        self.last.update((last, timeout, None))  # the timer is gone; the next message sets one
        yield _frame(key[0], [(OPEN, last, None, timeout)])

    def close(self) -> None:
        pass


def _frame(venue, rows: list[tuple]) -> pd.DataFrame:
    status, last, lengths, timeouts = zip(*rows, strict=True) if rows else ((), (), (), ())
    columns = {"venue": pd.Series([venue] * len(rows), dtype=object), "status": pd.Series(status, dtype=object), "silent_from": pd.to_datetime(pd.Series(last, dtype="int64"), unit="us")}
    return pd.DataFrame(columns | {"silent_us": pd.Series(lengths, dtype="Int64"), "timeout": pd.Series(timeouts, dtype="int32")})


def live_silence(messages: DataFrame, watermark: str = "1 second") -> DataFrame:
    """OPEN and CLOSED rows of a stream of messages: venue, ts, timeout (seconds, the venue's own at the time).

    A message before its venue's last one, within the watermark, ends no silence.
    """
    rows = messages.where("venue IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", watermark).select("venue", "ts", F.unix_micros("ts").alias("at"), F.col("timeout").cast("int").alias("timeout"))
    kind = messages.schema["venue"].dataType.simpleString()
    return rows.groupBy("venue").transformWithStateInPandas(SilenceProcessor(), OUTPUT.format(venue=kind), "append", "eventTime")
