"""State kept per key by the streaming jobs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DAY_MS = 86_400_000


class LastSeen(StatefulProcessor):
    """Keeps size and time of a path's last poll and puts them beside each new one."""

    def __init__(self, forget_after_ms: int | None):
        self.forget_after_ms = forget_after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "size_bytes bigint, mtime_ms bigint", self.forget_after_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        polls = pd.concat(list(rows)).sort_values("poll_ts")
        sizes, times = polls["size_bytes"].astype("Int64"), polls["mtime_ms"].astype("Int64")
        before = self.seen.get() if self.seen.exists() else (None, None)
        out = polls.copy()
        out["previous_size"] = sizes.shift(1)
        out["previous_mtime"] = times.shift(1)
        out.iloc[0, out.columns.get_loc("previous_size")] = pd.NA if before[0] is None else before[0]
        out.iloc[0, out.columns.get_loc("previous_mtime")] = pd.NA if before[1] is None else before[1]
        last = [None if pd.isna(v) else int(v) for v in (sizes.iloc[-1], times.iloc[-1])]
        self.seen.update(tuple(last))
        yield out

    def close(self) -> None:
        pass


class LedgerRow(StatefulProcessor):
    """Folds lifecycle events of one content hash into its current ledger row."""

    shape = "attempts int, state string, next_attempt_ms bigint"

    def __init__(self, base_ms: int, max_attempts: int, timers: bool):
        self.base_ms, self.max_attempts, self.timers = base_ms, max_attempts, timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.row = handle.getValueState("row", self.shape)

    def _step(self, attempts: int, state: str, due: int | None, kind: str, at_ms: int):
        if state == "FILED":
            return attempts, state, None
        if kind == "FILED":
            return attempts, "FILED", None
        if kind == "RETRY":
            return 0, "DISCOVERED", None
        if kind == "FAILED":
            attempts += 1
            if attempts >= self.max_attempts:
                return attempts, "QUARANTINED", None
            return attempts, "FAILED", at_ms + self.base_ms * 2 ** (attempts - 1)
        return attempts, state, due

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["at_ms", "event_id"])
        attempts, state, due = self.row.get() if self.row.exists() else (0, "DISCOVERED", None)
        for kind, at_ms in zip(events["kind"], events["at_ms"]):
            attempts, state, due = self._step(attempts, state, due, kind, int(at_ms))
        self.row.update((attempts, state, due))
        if self.timers and due is not None and due > timerValues.getCurrentProcessingTimeInMs():
            self.handle.registerTimer(due)
        yield self._frame(key, attempts, state, due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The backoff is over: a row still waiting for this moment becomes due."""
        if self.row.exists():
            attempts, state, due = self.row.get()
            if state == "FAILED" and due == expiredTimerInfo.getExpiryTimeInMs():
                self.row.update((attempts, state, None))
                yield self._frame(key, attempts, state, None)

    @staticmethod
    def _frame(key, attempts, state, due) -> pd.DataFrame:
        return pd.DataFrame(
            {
                "content_sha256": [key[0]], "attempts": pd.array([attempts], dtype="Int32"),
                "state": [state], "next_attempt_ms": pd.array([due], dtype="Int64"),
            }
        )

    def close(self) -> None:
        pass


class StatusMoves(StatefulProcessor):
    """Turns status events of one document into one leave and one enter per micro-batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "status string, at_us bigint, event_id bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = self.held.get() if self.held.exists() else None
        old = None if best is None else best[0]
        for chunk in rows:
            last = chunk.sort_values(["at_us", "event_id"]).iloc[-1]
            seen = (last["status"], int(last["at_us"]), int(last["event_id"]))
            if best is None or seen[1:] > tuple(best[1:]):
                best = seen
        if best is not None and best[0] != old:
            self.held.update(tuple(best))
            moves = [(best[0], 1)] + ([(old, -1)] if old is not None else [])
            yield pd.DataFrame(moves, columns=["status", "delta"])
        elif best is not None:
            self.held.update(tuple(best))

    def close(self) -> None:
        pass
