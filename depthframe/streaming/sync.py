"""The sync rule of every symbol's connection as a stateful stream: messages in, actions out.

State is keyed by (venue, symbol, conn_epoch) and lives in the state store: the messages held back until a snapshot
bridges them, and where the rule stands. A batch loads one key's state, takes its messages in the order of recv_seq and
writes the state back, so batches must not overlap in recv_seq; what comes late, at or before the last one, is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from depthframe.operators.sync import ACTIONS, KEY, POLICIES, SyncState
from depthframe.types import SNAPSHOT


def _number(x) -> int:
    return 0 if x is None or pd.isna(x) else int(x)


class SyncProcessor(StatefulProcessor):
    """Emits what ``sync.sync_actions`` gives for the same messages."""

    def __init__(self, policy: str):
        self.policy = policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("place", "live boolean, last bigint, asked boolean, seq bigint")
        self.held = handle.getListState("held", "seq bigint, first bigint, final bigint, prev bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, applied, out = SyncState(POLICIES[self.policy]), None, []
        if self.place.exists():
            state.live, state.last, state.asked, applied = self.place.get()
            state.held = [tuple(m) for m in self.held.get()]
        known = list(state.held)
        frame = pd.concat(list(rows)).sort_values("recv_seq", kind="stable")
        for seq, kind, first, final, prev, last in zip(*[frame[c].tolist() for c in ("recv_seq", "kind", "first_id", "final_id", "prev_final_id", "last_update_id")], strict=True):
            if applied is not None and seq <= applied:
                continue
            made = state.connected() if applied is None else []
            applied = seq
            made += state.snapshot(seq, _number(last)) if kind == SNAPSHOT else state.update(seq, _number(first), _number(final), _number(prev))
            out += [(*key, seq, i, a, m) for i, (a, m) in enumerate(made)]
        if state.held != known:
            if state.held:
                self.held.put(state.held)
            else:
                self.held.clear()
        self.place.update((state.live, state.last, state.asked, applied))
        yield pd.DataFrame(out, columns=[*KEY, "recv_seq", "ord", "action", "message_seq"]).astype({"message_seq": "Int64"})

    def close(self) -> None:
        pass


def live_sync(messages: DataFrame, policy: str) -> DataFrame:
    """The actions of a stream of messages, as ``sync.sync_actions`` has them for a table."""
    symbol = messages.schema["symbol"].dataType.simpleString()
    rows = messages.select(*KEY, "recv_seq", "kind", "first_id", "final_id", "prev_final_id", "last_update_id")
    return rows.groupBy(*KEY).transformWithStateInPandas(SyncProcessor(policy), ACTIONS.replace("symbol int", f"symbol {symbol}"), "append", "none")
