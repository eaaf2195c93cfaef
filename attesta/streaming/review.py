"""The review state of every claim as a keyed state machine over the stream of decisions.

Each decision is judged against the state before it in event time: it is legal if the table of moves has (state before,
decision). The state kept per claim is the line of decisions that an older one could still come between, that is
those the watermark has not passed, and the state before them. A late decision is put in its place and every
verdict that changes is given out again under the next revision, so the newest revision of a decision counts.

Decisions the watermark has passed are folded into the state before the line. Once a claim has been silent for ``idle``
its state ends by an event-time timer; what it was stands in the sink. ``known_state`` on a decision (joined from the
claims table, say) is where a claim without kept state starts, so a claim that comes back goes on from there.
Decisions later than the watermark are dropped by the engine, as in the other streams.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from attesta import dims

CLAIM_KEY = ["repo_id", "claim_id"]
START = "unreviewed"
VERDICTS = "repo_id string, claim_id string, event_id long, ts timestamp, action string, from_state string, to_state string, legal boolean, revision int"
#: before, stamp of the last folded decision, its place; then the open line: stamps (microseconds), ids, decisions, verdicts given
STATE = "before string, stamps array<long>, ids array<long>, actions array<string>, froms array<string>, revisions array<int>"

Move = tuple[str, str]


def after(action: str) -> str:
    return dims.STATE_AFTER.get(action, action)


def judged(before: str, line: list[tuple[int, int, str]], moves: frozenset[Move]) -> list[tuple[str, str, bool]]:
    """(state before, state after, legal) of each decision of an ordered line."""
    out = []
    for _, _, action in line:
        out.append((before, after(action), (before, action) in moves))
        before = after(action)
    return out


def _micros(ts: pd.Series) -> list[int]:
    return (ts.astype("datetime64[us]").astype("int64")).tolist()


def review_moves(
    decisions: DataFrame, moves: tuple[Move, ...] = dims.REVIEW_MOVES, lateness: str = "1 hour", idle: str = "30 days"
) -> DataFrame:
    """One verdict per decision and revision, columns as in ``VERDICTS``; runs in update or append mode.

    ``decisions`` has (repo_id, claim_id, event_id, ts, action) and may have ``known_state``. An ``event_id`` that comes
    again on the same claim is taken once.
    """
    legal = frozenset(moves)
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        before, held = None, []
        if state.exists:
            before, *columns = state.get
            held = list(zip(*columns, strict=True))
        fresh: dict[int, tuple[int, int, str]] = {}
        known = {e for _, e, *_ in held}
        started: tuple[int, int] | None = None
        for frame in frames:
            stamps = _micros(frame["ts"])
            for at, event, action, start in zip(stamps, frame["event_id"].tolist(), frame["action"].tolist(), frame["known_state"].tolist(), strict=True):
                if event not in known:
                    fresh[event] = min(fresh.get(event, (at, event, action)), (at, event, action))
                if not state.exists and (started is None or (at, event) < started):
                    started, before = (at, event), start
        before = before or START
        line = sorted([(at, event, action, was, revision) for at, event, action, was, revision in held] + [(*new, None, -1) for new in fresh.values()], key=lambda d: d[:2])
        verdicts = judged(before, [d[:3] for d in line], legal)
        out, kept = [], []
        for (at, event, action, was, revision), (source, target, good) in zip(line, verdicts, strict=True):
            if was != source:
                revision += 1
                out.append((*key, event, at, action, source, target, good, revision))
            kept.append((at, event, action, source, revision))
        passed = state.getCurrentWatermarkMs() * 1000
        closed = sum(1 for d in kept if d[0] < passed)
        if closed:
            before = verdicts[closed - 1][1]
            kept = kept[closed:]
        last = line[-1][0] // 1000 if line else passed // 1000
        state.update((before, *([list(c) for c in zip(*kept, strict=True)] or [[], [], [], [], []])))
        state.setTimeoutTimestamp(max(last + idle_ms, passed // 1000 + 1))
        if out:
            frame = pd.DataFrame(out, columns=["repo_id", "claim_id", "event_id", "ts", "action", "from_state", "to_state", "legal", "revision"])
            frame["ts"] = pd.to_datetime(frame["ts"], unit="us")
            yield frame

    start = F.col("known_state") if "known_state" in decisions.columns else F.lit(None).cast("string")
    rows = decisions.select(*CLAIM_KEY, F.col("event_id").cast("long").alias("event_id"), "ts", "action", start.alias("known_state"))
    keyed = rows.filter("ts IS NOT NULL AND action IS NOT NULL AND event_id IS NOT NULL").withWatermark("ts", lateness).groupBy(*CLAIM_KEY)
    return keyed.applyInPandasWithState(step, VERDICTS, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def newest_verdicts(verdicts: DataFrame) -> DataFrame:
    """The last word on each decision, of verdicts read back from a sink."""
    columns = [c for c in VERDICTS_COLUMNS if c not in (*CLAIM_KEY, "event_id")]
    return verdicts.groupBy(*CLAIM_KEY, "event_id").agg(F.max_by(F.struct(*columns), "revision").alias("_v")).select(*CLAIM_KEY, "event_id", "_v.*")


VERDICTS_COLUMNS = [c.split()[0] for c in VERDICTS.split(", ")]


def review_state(verdicts: DataFrame) -> DataFrame:
    """Current state per claim, with the number of decisions and of illegal ones, from the newest verdicts."""
    stamp = F.struct("ts", "event_id")
    return verdicts.groupBy(*CLAIM_KEY).agg(
        F.max_by("to_state", stamp).alias("state"), F.count(F.lit(1)).alias("decisions"), F.count_if(~F.col("legal")).alias("illegal"),
    )
