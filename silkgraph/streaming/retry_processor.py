"""Stateful processor of the retry stream; travels to the workers by value."""

from __future__ import annotations

import sys
from typing import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

STATE_OUTPUT = (
    "url string, event string, status_code int, retry_count bigint, last_s bigint, next_s bigint"
)
COLUMNS = [column.split()[0] for column in STATE_OUTPUT.split(", ")]
#: Failures that no row to come can stand before: their number, the first time, the last place and status.
SETTLED = "n bigint, first_us bigint, us bigint, seq bigint, status int"
OPEN = "us bigint, seq bigint, status int"
SUCCESS = "us bigint, seq bigint"


class RetryProcessor(StatefulProcessor):
    """State of a URL: the place (fetched_at, seq) of its last success and the failures behind it.

    Rows may come in any order within the watermark: a failure counts iff it lies behind the last success,
    as in the batch form. Failures that the watermark has passed are kept as a number with their first and last
    place, since a later success ends all of them together; only those ahead of the watermark are
    kept one by one. A success frees the failures before it; when the watermark has passed the last
    success of a URL without failures, nothing older can come and its state is freed as a whole.
    """

    def __init__(self, delay: float, factor: float):
        self.delay, self.factor = delay, factor

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.success = handle.getValueState("success", SUCCESS)
        self.settled = handle.getValueState("settled", SETTLED)
        self.open = handle.getListState("open", OPEN)

    def _failures(self):
        """(settled failures or None, the others)."""
        settled = tuple(self.settled.get()) if self.settled.exists() else None
        return settled, [tuple(f) for f in self.open.get()] if self.open.exists() else []

    def _shown(self, settled, held):
        """What a reader sees of the state: None, or status, retry count, last and next time."""
        if not settled and not held:
            return None
        us, _, status = max(held) if held else settled[2:]
        count, last = (settled[0] if settled else 0) + len(held) - 1, us // 1_000_000
        return status, count, last, last + int(self.delay * self.factor**count)

    def _row(self, url, event, shown):
        status, count, last, due = shown or (None, None, None, None)
        # one block of objects: typed columns cost a millisecond for each row, the stream gives them their types
        return pd.DataFrame([[url, event, status, count, last, due]], columns=COLUMNS, dtype=object)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        success = tuple(self.success.get()) if self.success.exists() else (-1, -1)
        settled, held = self._failures()
        stored = (success, settled, list(held))
        before, known = self._shown(settled, held), success > (-1, -1) or bool(settled or held)
        for frame in rows:
            # plain lists: a URL has few rows in a batch, and filters of a frame cost more than a millisecond for each URL
            seen = [(int(u), int(s), int(c)) for u, s, c in zip(*(frame[name].tolist() for name in ("us", "seq", "status")))]
            success = max([success, *(f[:2] for f in seen if 200 <= f[2] <= 299)])
            held += [f for f in seen if not 200 <= f[2] <= 299]
            held = [f for f in held if f[:2] > success]
        if settled and settled[2:4] < success:
            settled = None
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        old = sorted(f for f in held if f[0] < passed)
        if old:
            held = [f for f in held if f[0] >= passed]
            n, first, *last = settled or (0, old[0][0], *old[-1])
            settled = (n + len(old), min(first, old[0][0]), *max(tuple(last), old[-1]))
        shown = self._shown(settled, held)
        # a call to the state is a round trip of its own, so only what has changed is written
        if settled != stored[1]:
            self.settled.update(settled) if settled else self.settled.clear()
        if held != stored[2]:
            self.open.put(held) if held else self.open.clear()
        if success != stored[0]:
            self.success.update(success)
        due, timers = shown[3] * 1000 if shown else success[0] // 1000 + 1, list(self.handle.listTimers())
        for timer in timers:
            if timer != due:
                self.handle.deleteTimer(timer)
        if due not in timers:
            self.handle.registerTimer(due)
        if shown != before or not known:
            yield self._row(key[0], "failed" if shown else "cleared", shown)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        shown = self._shown(*self._failures())
        if shown:
            yield self._row(key[0], "ready", shown)
        else:
            self.success.clear()
            self.settled.clear()
            self.open.clear()

    def close(self) -> None:
        pass
