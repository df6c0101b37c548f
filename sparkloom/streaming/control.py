"""The control queue: sessions, directives appended to files, and a stream that takes each directive of a session once."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import text as T

EVENT = "id string, at timestamp, event string, session string, directive string"
# The kinds of lines.
DIRECTIVE, QUEUED, RECEIVED, INTERPRETED, STARTED, FINISHED = "directive", "queued", "received", "interpreted", "session_started", "session_finished"


def read_queue(spark: SparkSession, folder: str) -> DataFrame:
    """The queue's JSON lines as a stream; lines that do not parse are left out."""
    lines = spark.readStream.text(folder)
    return lines.select(F.from_json("value", EVENT, {"mode": "PERMISSIVE"}).alias("e")).select("e.*").where("id is not null")


def consume(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """(id, session, directive, action) of the directives of active sessions, each id once; blank directives ask for nothing.

    Lines of other kinds are no directives, whatever they carry. Works on a stream and on a table alike. On a stream the ids seen
    are state, which lasts for the query's checkpoint.
    """
    active = sessions.where("status = 'active'").select("session")
    asked = events.where((F.col("event") == DIRECTIVE) & F.col("directive").isNotNull() & (T.strip(F.col("directive")) != ""))
    return asked.join(active, "session").dropDuplicates(["id"]).select("id", "session", "directive", T.directive_action(F.col("directive")).alias("action"))


class Queue:
    """A project's queue in a folder: ``session.json``, ``events/`` with a file a directive, and ``control-log.jsonl``.

    The project has one session at a time. A directive is a file of its own, so the stream sees it whole.
    """

    def __init__(self, folder: str | Path) -> None:
        self.folder = Path(folder)
        self.events, self.state, self.log = self.folder / "events", self.folder / "session.json", self.folder / "control-log.jsonl"

    def note(self, event: str, **details: object) -> None:
        self.folder.mkdir(parents=True, exist_ok=True)
        with self.log.open("a", encoding="utf-8") as out:
            out.write(json.dumps({"at": _now(), "event": event, **details}, sort_keys=True) + "\n")

    def session(self) -> dict:
        """{session, status} as last written; none and unreadable ones are no session."""
        try:
            found = json.loads(self.state.read_text(encoding="utf-8"))
        except (OSError, ValueError):
            return {}
        return found if isinstance(found, dict) else {}

    def _write(self, session: str, status: str) -> None:
        self.folder.mkdir(parents=True, exist_ok=True)
        self.state.write_text(json.dumps({"session": session, "status": status, "at": _now()}), encoding="utf-8")

    def start(self) -> str:
        session = uuid.uuid4().hex
        self._write(session, "active")
        self.note(STARTED, session=session)
        return session

    def finish(self, session: str) -> None:
        if self.state.is_file():
            self._write(session, "finished")
        self.note(FINISHED, session=session)

    def put(self, directive: str) -> dict:
        """Queue a directive for the active session; a blank one, or one without a session, is an error."""
        now = self.session()
        if not directive.strip():
            raise ValueError("control directive cannot be empty")
        if now.get("status") != "active" or not now.get("session"):
            raise ValueError("no guided session is active for this project")
        event = {"id": uuid.uuid4().hex, "at": _now(), "event": DIRECTIVE, "session": now["session"], "directive": directive.strip()}
        self.events.mkdir(parents=True, exist_ok=True)
        draft = self.folder / f"{event['id']}.draft"
        draft.write_text(json.dumps(event) + "\n", encoding="utf-8")
        draft.rename(self.events / f"{event['id']}.json")
        self.note(QUEUED, session=event["session"], id=event["id"], directive=event["directive"])
        return event

    def follow(self, spark: SparkSession) -> list[dict]:
        """Take what waits, once over all runs: each directive and its action go to the log, in order of time, and come back.

        Restarts go on where the checkpoint stands. A batch is one project's waiting directives, which people type.
        """
        self.events.mkdir(parents=True, exist_ok=True)
        taken: list[dict] = []

        def log(batch: DataFrame, _: int) -> None:
            active = batch.sparkSession.createDataFrame([(s["session"], s["status"]) for s in [self.session()] if s], "session string, status string")
            at = batch.select("id", "at").groupBy("id").agg(F.min("at").alias("at"))
            for r in consume(batch, active).join(at, "id").orderBy("at", "id").toLocalIterator():
                self.note(RECEIVED, session=r["session"], directive_id=r["id"], directive=r["directive"])
                self.note(INTERPRETED, session=r["session"], directive_id=r["id"], directive=r["directive"], action=r["action"])
                taken.append({"id": r["id"], "directive": r["directive"], "action": r["action"]})

        queue = read_queue(spark, str(self.events)).dropDuplicates(["id"])
        queue.writeStream.foreachBatch(log).option("checkpointLocation", str(self.folder / "_stream")).trigger(availableNow=True).start().awaitTermination()
        return taken


def _now() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="microseconds")
