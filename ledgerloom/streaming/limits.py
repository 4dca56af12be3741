"""Limits with feedback: what is decided for one event changes the next decision.

Each rule is one small class, run by a sorted batch (a group is a stream of its task, which keeps the rule's state and not the rows)
and by ``transformWithStateInPandas``, whose state it is loaded from and stored to. Both give the same rows as long as
the micro-batches of a key come in the order of event time.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ADMITTED = "event_id long, allowed boolean, remaining int, retry_after long"
LEDGER = "call long, seq int, outcome string, used long, calls long"


class SlidingWindow:
    """At most ``most`` admitted hits in any ``width`` milliseconds; a denied hit is not recorded.

    The state is the queue of the admitted times still in the window, so ``most`` numbers at most.
    """

    def __init__(self, most: int, width: int, times: list[int] = ()) -> None:
        self.most, self.width, self.times = most, width, deque(times)

    def hit(self, now: int) -> tuple[bool, int, int]:
        """Whether the hit is admitted, how many more would be, and the milliseconds after which a denied one can be."""
        while self.times and self.times[0] <= now - self.width:
            self.times.popleft()
        if len(self.times) < self.most:
            self.times.append(now)
            return True, self.most - len(self.times), 0
        return False, 0, max(1, self.times[0] + self.width - now)


class Reservations:
    """A monthly allowance that is debited before a call and settled, or given back, after it.

    Open reservations are held by call. One that nobody closes within ``keep`` milliseconds is given back. A month begins with
    nothing used and nothing open. Closing what is not open (denied, closed before, expired, of last month) changes
    nothing and is ``unknown``; reserving what is open is ``repeated``.
    """

    def __init__(self, cap: int, keep: int, month: str | None = None, used: int = 0, calls: int = 0, held: dict[int, tuple[int, int]] | None = None) -> None:
        self.cap, self.keep, self.month, self.used, self.calls, self.held = cap, keep, month, used, calls, dict(held or {})

    def expire(self, now: int) -> None:
        for call in [c for c, (_, until) in self.held.items() if until <= now]:
            self.give_back(call)

    def give_back(self, call: int) -> None:
        self.used, self.calls = max(0, self.used - self.held.pop(call)[0]), max(0, self.calls - 1)

    def step(self, now: int, month: str, op: str, call: int, tokens: int) -> str:
        if month != self.month:
            self.month, self.used, self.calls, self.held = month, 0, 0, {}
        self.expire(now)
        if op == "reserve":
            want = max(0, tokens)
            if call in self.held:
                return "repeated"
            if self.cap <= 0:
                return "no budget"
            if self.used + want > self.cap:
                return "exceeded"
            self.used, self.calls, self.held[call] = self.used + want, self.calls + 1, (want, now + self.keep)
            return "reserved"
        if call not in self.held:
            return "unknown"
        if op == "refund":
            self.give_back(call)
            return "refunded"
        self.used = max(0, self.used + max(0, tokens) - self.held.pop(call)[0])
        return "settled"


def admitted(events: DataFrame, most: int, width: int) -> DataFrame:
    """The sliding window over ``events(user_id, at, event_id)``, ``at`` in milliseconds; ties go by event_id. Null users are one user."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, window = object(), SlidingWindow(most, width)
        for rows in batches:
            out = []
            for key, at, event in zip(rows["user_id"].astype("Int64").astype(object), rows["at"], rows["event_id"]):
                if key is pd.NA and user is not pd.NA or key is not pd.NA and (user is pd.NA or key != user):
                    user, window = key, SlidingWindow(most, width)
                out.append((event, *window.hit(int(at))))
            yield pd.DataFrame(out, columns=["event_id", "allowed", "remaining", "retry_after"])

    own = events.select("user_id", "at", "event_id")
    return own.repartition("user_id").sortWithinPartitions("user_id", "at", "event_id").mapInPandas(run, ADMITTED)


def reservations(ops: DataFrame, cap: int, keep: int) -> DataFrame:
    """The allowance over ``ops(user_id, at, month, op, call, seq, tokens)``, by time, then call, then seq. Null users have no allowance of their own and are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, ledger = None, None
        for rows in batches:
            out = []
            for r in rows.itertuples():
                if ledger is None or r.user_id != user:
                    user, ledger = r.user_id, Reservations(cap, keep)
                out.append((r.call, r.seq, ledger.step(r.at, r.month, r.op, r.call, r.tokens), ledger.used, ledger.calls))
            yield pd.DataFrame(out, columns=["call", "seq", "outcome", "used", "calls"])

    own = ops.where("user_id IS NOT NULL").select("user_id", "at", "month", "op", "call", "seq", "tokens")
    return own.repartition("user_id").sortWithinPartitions("user_id", "at", "call", "seq").mapInPandas(run, LEDGER)


def _wake(handle: StatefulProcessorHandle, at: int | None) -> None:
    for timer in list(handle.listTimers()):
        handle.deleteTimer(timer)
    if at is not None:
        handle.registerTimer(at)


class WindowProcessor(StatefulProcessor):
    """List state of admitted times; a timer clears it when the last one leaves the window."""

    def __init__(self, most: int, width: int) -> None:
        self.most, self.width = most, width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.times = handle, handle.getListState("times", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        window = SlidingWindow(self.most, self.width, [t[0] for t in self.times.get()] if self.times.exists() else [])
        own = pd.concat(list(rows)).sort_values(["at", "event_id"])
        out = [(event, *window.hit(int(at))) for at, event in zip(own["at"], own["event_id"])]
        self.times.put([(t,) for t in window.times])
        _wake(self.handle, window.times[-1] + self.width if window.times else None)
        yield pd.DataFrame(out, columns=["event_id", "allowed", "remaining", "retry_after"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.times.clear()
        return iter([])

    def close(self) -> None:
        pass


class ReservationProcessor(StatefulProcessor):
    """Map state of open reservations by call, value state of the month's figures; a timer gives back what nobody closes."""

    def __init__(self, cap: int, keep: int) -> None:
        self.cap, self.keep = cap, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "call long", "tokens long, until long")
        self.figures = handle.getValueState("figures", "month string, used long, calls long")

    def load(self) -> Reservations:
        month, used, calls = self.figures.get() if self.figures.exists() else (None, 0, 0)
        return Reservations(self.cap, self.keep, month, used, calls, {k[0]: tuple(v) for k, v in self.held.iterator()} if self.held.exists() else {})

    def store(self, ledger: Reservations) -> None:
        before = {k[0] for k in self.held.keys()} if self.held.exists() else set()
        for call in before - set(ledger.held):
            self.held.removeKey((call,))
        for call, value in ledger.held.items():
            if call not in before:
                self.held.updateValue((call,), value)
        self.figures.update((ledger.month, ledger.used, ledger.calls))
        _wake(self.handle, min((until for _, until in ledger.held.values()), default=None))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ledger, out = self.load(), []
        for r in pd.concat(list(rows)).sort_values(["at", "call", "seq"]).itertuples():
            out.append((r.call, r.seq, ledger.step(r.at, r.month, r.op, r.call, r.tokens), ledger.used, ledger.calls))
        self.store(ledger)
        yield pd.DataFrame(out, columns=["call", "seq", "outcome", "used", "calls"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ledger = self.load()
        ledger.expire(expiredTimerInfo.getExpiryTimeInMs())
        self.store(ledger)
        return iter([])

    def close(self) -> None:
        pass


def stream_admitted(events: DataFrame, most: int, width: int, late: str = "1 hour") -> DataFrame:
    """:func:`admitted` as a stream of ``events(user_id, at, event_id, ts)``; needs the RocksDB state store."""
    rows = events.withWatermark("ts", late).select("user_id", "at", "event_id", "ts")
    return rows.groupBy("user_id").transformWithStateInPandas(WindowProcessor(most, width), ADMITTED, "Append", "EventTime")


def stream_reservations(ops: DataFrame, cap: int, keep: int, late: str = "1 hour") -> DataFrame:
    """:func:`reservations` as a stream of its columns and ``ts``."""
    rows = ops.withWatermark("ts", late).select("user_id", "at", "month", "op", "call", "seq", "tokens", "ts")
    return rows.groupBy("user_id").transformWithStateInPandas(ReservationProcessor(cap, keep), LEDGER, "Append", "EventTime")
