"""Functions on the engine's keyed state: what each key keeps between batches, and when it goes.

An entry of the engine's store holds the keys of one bucket (a hash of the key), so that rows and state of many keys reach a
function at once; a batch reads and writes the buckets of its own keys. Within a bucket every key is followed on its own.
Times are microseconds since the epoch.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql.streaming.state import GroupState

#: The state of a bucket: what is kept of each key.
STATE = "kept binary"


def _rows(frames: Iterator[pd.DataFrame], columns: Sequence[str]) -> list[tuple]:
    return [row for f in frames for row in zip(*(f[c].tolist() for c in columns), strict=True)]


def _kept(state: GroupState) -> dict:
    return pickle.loads(state.get[0]) if state.exists else {}


def _keep(state: GroupState, kept: dict) -> None:
    if kept:
        state.update((pickle.dumps(kept),))
    elif state.exists:
        state.remove()


class LastValue:
    """Changes of a value per key: each row against the one before it, in this batch or an earlier one.

    Rows come as (key, order, value), the order never null. A row that is not behind the kept one in order is late and
    compared with nothing. With ``ttl_ms`` a key is forgotten so long after its last row.
    """

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def __call__(self, bucket: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = _kept(state)
        now_ms = state.getCurrentProcessingTimeMs() if self.ttl_ms else 0
        if self.ttl_ms:
            kept = {k: v for k, v in kept.items() if v[2] + self.ttl_ms > now_ms}
        found = []
        rows = [] if state.hasTimedOut else _rows(frames, ("key", "at", "value"))
        for key, at, value in sorted(rows, key=lambda r: r[1]):
            now = None if pd.isna(value) else value
            known = kept.get(key)
            if known is not None and at <= known[0]:
                continue
            if known is not None and known[1] is not None and known[1] != now:
                found.append((key, at, known[1], now))
            kept[key] = (at, now, now_ms)
        _keep(state, kept)
        if kept and self.ttl_ms:
            state.setTimeoutDuration(max(1, min(v[2] for v in kept.values()) + self.ttl_ms - now_ms))
        if found:
            yield pd.DataFrame(found, columns=["key", "at", "previous", "current"])


def _due(at: int) -> int:
    """The first millisecond that has passed a time in microseconds."""
    return -(-at // 1000) + 1


class FirstWithin:
    """Rows that come ``span`` or more after the last kept row of their key, in the order of event time.

    The columns of ``order`` are never null. Rows wait until the watermark has passed them, so the borders of batches and the order of arrival do not matter. A
    key is forgotten when nothing waits and the span after its last kept row is over.
    """

    def __init__(self, span: int, order: Sequence[str]):
        self.span, self.columns = span, ["key", "at_us", *order, "whole"]

    def __call__(self, bucket: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = _kept(state)
        if not state.hasTimedOut:
            for key, *row in _rows(frames, self.columns):
                kept.setdefault(key, (None, []))[1].append(tuple(row))
        passed = state.getCurrentWatermarkMs() * 1000
        out, alarms = [], []
        for key, (last, waiting) in list(kept.items()):
            later = []
            for row in sorted(waiting):
                if row[0] > passed:
                    later.append(row)
                elif last is None or row[0] >= last + self.span:
                    out.append(row[-1])
                    last = row[0]
            if later or (last is not None and last + self.span > passed):
                kept[key] = (last, later)
                alarms.append(later[0][0] if later else last + self.span)
            else:
                del kept[key]
        _keep(state, kept)
        if kept:
            state.setTimeoutTimestamp(_due(min(alarms)))
        if out:
            yield pd.DataFrame({"whole": out})
