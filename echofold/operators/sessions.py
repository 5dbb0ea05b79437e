"""Durable scan sessions: states and control requests in an append-only file, polled between stages."""

from __future__ import annotations

import fcntl
import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from echofold.errors import InvalidInput, StateError

STAGES = ("enumerating", "quick_hashing", "full_hashing", "grouping")
FINAL = ("completed", "cancelled", "failed")
REQUESTS = ("pause", "resume", "cancel")
RECORD = "sequence long, session string, kind string, value string, detail string"


class Stopped(StateError):
    """A scan met a request to pause or cancel."""


class Sessions:
    """Records (sequence, session, kind, value, detail); kinds: state, stage, request, acknowledged, progress. Several processes may write."""

    def __init__(self, folder: str):
        self.folder, self.path = folder, os.path.join(folder, "sessions.jsonl")
        os.makedirs(folder, exist_ok=True)

    def records(self, session: str | None = None) -> list[dict]:
        try:
            with open(self.path, encoding="utf-8") as f:
                rows = [json.loads(x) for x in f]
        except FileNotFoundError:
            return []
        return rows if session is None else [r for r in rows if r["session"] == session]

    def _append(self, session: str, kind: str, value: str, expected: str | None = None, detail=None, of: str = "state") -> dict:
        """Compare and set under a lock: expected is what the newest record of a kind must say."""
        with open(self.path, "a+", encoding="utf-8") as f:
            fcntl.flock(f, fcntl.LOCK_EX)
            f.seek(0)
            rows = [json.loads(x) for x in f]
            now = next((r["value"] for r in reversed(rows) if r["session"] == session and r["kind"] == of), None)
            if expected is not None and now != expected:
                raise StateError(f"session {session} is {now}, not {expected}")
            row = {"sequence": len(rows), "session": session, "kind": kind, "value": value, "detail": None if detail is None else json.dumps(detail)}
            f.write(json.dumps(row) + "\n")
            f.flush()
            os.fsync(f.fileno())
        return row

    def create(self, project: str, session: str | None = None) -> str:
        session = session or uuid.uuid4().hex
        self._append(session, "state", "created", detail={"project": project})
        return session

    def status(self, session: str) -> dict:
        """project, state, last finished stage, open request and progress."""
        rows = self.records(session)
        if not rows:
            raise InvalidInput(f"no session {session!r}")
        last = lambda kind: next((r for r in reversed(rows) if r["kind"] == kind), None)
        asked, done, progress = last("request"), last("acknowledged"), last("progress")
        return {
            "session": session, "project": json.loads(rows[0]["detail"])["project"], "state": last("state")["value"], "stage": (last("stage") or {}).get("value"),
            "request": asked["value"] if asked and (not done or done["detail"] != str(asked["sequence"])) else None, "progress": json.loads(progress["detail"]) if progress else {},
        }

    def set_state(self, session: str, state: str, expected: str | None = None) -> None:
        if self.status(session)["state"] in FINAL:
            raise StateError("the session is over")
        self._append(session, "state", state, expected)

    def finished(self, session: str, stage: str, counters: dict | None = None) -> None:
        """A checkpoint: the stage's result is stored; resuming goes on after it."""
        self._append(session, "stage", stage)
        if counters:
            self._append(session, "progress", "counters", detail=self.status(session)["progress"] | counters)

    def request(self, session: str, what: str) -> None:
        """Asks a running scan, in whatever process, to pause or cancel, or lets a paused or interrupted one go on."""
        state = self.status(session)["state"]
        if what not in REQUESTS:
            raise InvalidInput(f"no request {what!r}")
        if state in FINAL or what == "pause" and state in ("paused", "interrupted") or what == "resume" and state not in ("paused", "interrupted"):
            raise StateError(f"a session that is {state} can't {what}")
        self._append(session, "request", what)
        if what == "cancel" and state in ("created", "paused", "interrupted"):
            self.poll(session)

    def poll(self, session: str) -> None:
        """Acknowledges an open request: raises Stopped for pause and cancel, after the session's state says so."""
        asked = next((r for r in reversed(self.records(session)) if r["kind"] == "request"), None)
        what = self.status(session)["request"]
        if what is None:
            return
        self._append(session, "acknowledged", what, detail=asked["sequence"])
        if what != "resume":
            self._append(session, "state", {"pause": "paused", "cancel": "cancelled"}[what])
            if self.status(session)["state"] == "paused" or what == "cancel":
                raise Stopped(f"the session is {self.status(session)['state']}")

    def interrupt_orphans(self) -> list[str]:
        """After a start: sessions that no process can be running any longer are interrupted."""
        names = dict.fromkeys(r["session"] for r in self.records())
        lost = [s for s in names if self.status(s)["state"] not in (*FINAL, "paused", "interrupted")]
        for s in lost:
            self._append(s, "state", "interrupted")
        return lost

    def remaining(self, session: str) -> list[str]:
        """The stages that a resumed session has yet to do."""
        done = {r["value"] for r in self.records(session) if r["kind"] == "stage"}
        return [s for s in STAGES if s not in done]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(RECORD).json(self.path)
