"""The life of sessions as a stream: what each was resolved to when it started, its snapshots, and its end.

State per session: a value with what the start resolved, a list of the snapshots taken, and one timer, which each event moves on and
which closes a session that never says it ends. Rows tell sinks what to do: copy a transcript as a snapshot, archive it with the
snapshots so far, or drop what a session left.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import Row

from lodestrand.operators.sessions import skip_reason
from lodestrand.sources.runs import Config
from lodestrand.streaming.ingest import LIFECYCLE

RESOLVED = "started_at string, cwd string, transcript_path string, skip_reason string, settings string"
ROWS = (
    "session_id string, event string, at timestamp, started_at timestamp, cwd string, transcript_path string, skip_reason string, settings string, snapshot string, "
    "snapshots array<string>, open boolean"
)
NO_CONFIG = "config-missing"


def _instant(ms: int) -> datetime:
    return datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(milliseconds=ms)


class SessionLife(StatefulProcessor):
    """One session's events in order of time, then of name as LIFECYCLE has them. A start resolves anew and keeps the snapshots; events of a session
    without a start are taken with their own folder and transcript."""

    def __init__(self, idle_ms: int, settings: str | None):
        self.idle_ms, self.settings = idle_ms, settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.resolved = handle.getValueState("resolved", RESOLVED)
        self.snapshots = handle.getListState("snapshots", "name string")

    def _clear(self) -> None:
        self.resolved.clear()
        self.snapshots.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def _row(self, key: Any, event: str, at: datetime, known: tuple, snapshot: str | None, names: list[str], is_open: bool) -> Row:
        started, cwd, transcript, skip, settings = known
        begun = datetime.fromisoformat(started) if started else None
        return Row(session_id=key[0], event=event, at=at, started_at=begun, cwd=cwd, transcript_path=transcript, skip_reason=skip, settings=settings, snapshot=snapshot, snapshots=names, open=is_open)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        known = tuple(self.resolved.get()) if self.resolved.exists() else None
        names = [x[0] for x in self.snapshots.get()] if self.snapshots.exists() else []
        last, out = None, []
        for r in sorted(rows, key=lambda r: (r.at, LIFECYCLE.index(r.hook_event_name), r.transcript_path or "")):
            event, snapshot = r.hook_event_name, None
            if event == "SessionStart":
                known = (r.at.isoformat(), r.cwd, r.transcript_path, r.skip_reason if self.settings else NO_CONFIG, self.settings)
            elif event == "PreCompact":
                snapshot = f"{len(names) + 1:04d}.jsonl"
                names = [*names, snapshot]
            shown = known or (None, r.cwd, r.transcript_path, r.skip_reason, None)
            out.append(self._row(key, event, r.at, (*shown[:2], r.transcript_path or shown[2], *shown[3:]), snapshot, names, event != "SessionEnd"))
            last = r.at
            if event == "SessionEnd":
                known, names, last = None, [], None
        self._clear()
        if last is not None:
            if known is not None:
                self.resolved.update(known)
            if names:
                self.snapshots.put([(n,) for n in names])
            self.handle.registerTimer(int(last.replace(tzinfo=last.tzinfo or timezone.utc).timestamp() * 1000) + self.idle_ms)
        yield from out

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        known = tuple(self.resolved.get()) if self.resolved.exists() else (None,) * 5
        names = [x[0] for x in self.snapshots.get()] if self.snapshots.exists() else []
        self._clear()
        yield self._row(key, "Expired", _instant(expiredTimerInfo.getExpiryTimeInMs()), known, None, names, False)

    def close(self) -> None:
        pass


def session_lives(payloads: DataFrame, config: Config | None, idle: timedelta = timedelta(days=1), late: str = "1 minute") -> DataFrame:
    """ROWS for each event of a stream payloads(session_id, transcript_path, cwd, hook_event_name, at), and one, Expired, for each session that has
    been silent for `idle` when the watermark, `late` behind the latest event, passes. Without a configuration sessions are marked to be
    skipped. Rows of other events or without an id or time are left out. Needs arrivals.use_state_store()."""
    skips = [p for p in config.skip_paths] if config else []
    known = payloads.where(F.col("hook_event_name").isin(*LIFECYCLE) & F.col("session_id").isNotNull() & F.col("at").isNotNull())
    folders = skip_reason(known, skips)
    reason = F.when(F.col("skip_path").isNotNull(), F.concat(F.lit("matched skip_path: "), F.col("skip_path")))
    rows = folders.select("session_id", "hook_event_name", "cwd", "transcript_path", "at", reason.alias("skip_reason")).withWatermark("at", late)
    settings = None if config is None else json.dumps({k: v for k, v in config.__dict__.items() if k != "skip_paths"}, ensure_ascii=False, sort_keys=True)
    return rows.groupBy("session_id").transformWithState(SessionLife(int(idle.total_seconds() * 1000), settings), ROWS, "Append", "EventTime")
