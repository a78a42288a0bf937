"""Keyed state machines on streams.

The state of a key is a few scalars.  A micro-batch hands over the key's rows of
that trigger only, so the trigger size bounds what a task holds, and keys
include the instance or document so that one busy component is spread.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusweir.operators.metrics import breaker_step


def _sorted(batches: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    parts = list(batches)
    return pd.concat(parts, ignore_index=True).sort_values(order) if parts else pd.DataFrame()


def _seconds(stamps: pd.Series) -> pd.Series:
    return stamps.astype("datetime64[us]").astype("int64") / 1e6


def circuit_breaker(stream: DataFrame, key: str, ts: str, tie: str, failed: str,
                    threshold: int = 5, timeout: float = 60.0) -> DataFrame:
    """State after every call: (key, tie, state, failure_count, admitted)."""
    fields = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    schema = f"{key} {fields[key]}, {tie} {fields[tie]}, state string, failure_count long, admitted boolean"

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else ("closed", 0, 0.0)
        rows = _sorted(batches, [ts, tie])
        out = []
        for at, bad, ident in zip(_seconds(rows[ts]), rows[failed], rows[tie], strict=True):
            now, admitted = breaker_step(tuple(now), at, bool(bad), threshold, timeout)
            out.append((group[0], ident, now[0], now[1], admitted))
        state.update(now)
        yield pd.DataFrame(out, columns=[key, tie, "state", "failure_count", "admitted"])

    return stream.groupBy(key).applyInPandasWithState(
        step, schema, "name string, count long, last double", "append", GroupStateTimeout.NoTimeout
    )


def progress_relay(stream: DataFrame, key: str, ts: str, tie: str, status: str, terminal: tuple[str, ...],
                   heartbeat: int = 30, timeout: int = 300, wall_clock: bool = False) -> DataFrame:
    """Per key: connected, relayed messages, heartbeats, and one end.

    A silence between messages counts by their times; with ``wall_clock`` a
    silent key also gets its heartbeats and its end from processing-time timers.
    """
    kind = {f.name: f.dataType.simpleString() for f in stream.schema.fields}[key]
    schema = f"{key} {kind}, seq long, status string, ended boolean"

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ended, last, seq, silent = state.get if state.exists else (False, None, 0, 0)
        out: list[tuple] = []

        def send(what: str, final: bool = False) -> None:
            nonlocal seq
            out.append((group[0], seq, what, final))
            seq += 1

        if state.hasTimedOut:
            silent += heartbeat
            if not ended:
                ended = silent >= timeout
                send("timeout" if ended else "heartbeat", ended)
        else:
            silent = 0
            if not state.exists:
                send("connected")
            rows = _sorted(batches, [ts, tie])
            for at, what in zip(_seconds(rows[ts]), rows[status], strict=True):
                if ended:
                    break
                gap = 0.0 if last is None else at - last
                for _ in range(int(min(gap, timeout) // heartbeat)):
                    send("heartbeat")
                last = at
                if gap >= timeout:
                    ended = True
                    send("timeout", True)
                    break
                ended = what in terminal
                send(what, ended)
        state.update((ended, last, seq, silent))
        if wall_clock and not ended:
            state.setTimeoutDuration(heartbeat * 1000)
        yield pd.DataFrame(out, columns=[key, "seq", "status", "ended"])

    return stream.groupBy(key).applyInPandasWithState(
        step, schema, "ended boolean, last double, seq long, silent long", "append",
        GroupStateTimeout.ProcessingTimeTimeout if wall_clock else GroupStateTimeout.NoTimeout,
    )


def session_expiry(stream: DataFrame, key: str, ts: str, max_age: int = 3600, lateness: str = "10 minutes") -> DataFrame:
    """(key, created_at, expired): one row when the first activity is ``max_age`` seconds old.

    An expired key leaves no state; activity after that starts a new session.
    """
    kind = {f.name: f.dataType.simpleString() for f in stream.schema.fields}[key]
    schema = f"{key} {kind}, created_seconds double, expired boolean"

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (created,) = state.get
            state.remove()
            yield pd.DataFrame([(group[0], created, True)], columns=[key, "created_seconds", "expired"])
            return
        firsts = [_seconds(b[ts]).min() for b in batches if len(b)]
        created = float(min(firsts + (list(state.get) if state.exists else [])))
        state.update((created,))
        state.setTimeoutTimestamp(max(int((created + max_age) * 1000), state.getCurrentWatermarkMs() + 1))

    return stream.withWatermark(ts, lateness).groupBy(key).applyInPandasWithState(
        step, schema, "created double", "append", GroupStateTimeout.EventTimeTimeout
    )
