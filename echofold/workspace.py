"""Projects, sessions and plans in one folder, and the command line over them: python -m echofold.workspace --help."""

from __future__ import annotations

import argparse
import json
import os
import shutil
import sys
import time
import uuid
from dataclasses import asdict
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echofold.errors import EngineError, InvalidInput, SafetyError, StateError
from echofold.functions.text import QUARANTINE
from echofold.operators import catalog, detect, effect, filters, history, keep, ledger, maintenance, plan, removal, report
from echofold.operators.sessions import Sessions, Stopped
from echofold.sources.files import read_files, scan_files, with_digests

RETENTION_DAYS = 30


class Workspace:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, os.path.abspath(folder)
        os.makedirs(self.folder, exist_ok=True)
        self.sessions = Sessions(self._path("sessions"))

    def _path(self, *parts: str) -> str:
        return os.path.join(self.folder, *parts)

    # projects: a small JSON file, replaced as a whole

    def projects(self) -> dict[str, dict]:
        try:
            with open(self._path("projects.json")) as f:
                return json.load(f)
        except FileNotFoundError:
            return {}

    def _store(self, projects: dict) -> None:
        with open(self._path("projects.json.new"), "w") as f:
            json.dump(projects, f, indent=1)
            f.flush()
            os.fsync(f.fileno())
        os.replace(self._path("projects.json.new"), self._path("projects.json"))

    def project(self, name: str, active: bool = True) -> dict:
        p = self.projects().get(name)
        if p is None:
            raise InvalidInput(f"no project {name!r}")
        if active and p["status"] != "active":
            raise StateError(f"project {name!r} is archived")
        return p

    def update(self, name: str, **changes) -> dict:
        projects = self.projects()
        projects[name] = self.project(name) | changes
        self._store(projects)
        return projects[name]

    def create(self, name: str, mode: str = detect.STRICT, acknowledged: bool = False) -> dict:
        """Content mode ignores names, and must be acknowledged."""
        if mode not in (detect.STRICT, detect.CONTENT) or mode == detect.CONTENT and not acknowledged:
            raise InvalidInput("mode is strict, or content with an acknowledgement")
        if name in self.projects():
            raise InvalidInput(f"there is a project {name!r}")
        self._store(self.projects() | {name: {"mode": mode, "status": "active", "roots": [], "primary": [], "workers": 8, "filter": asdict(filters.FilterConfig())}})
        return self.project(name)

    def add_root(self, name: str, root: str, primary: bool = False) -> dict:
        p, root = self.project(name), os.path.abspath(root)
        if os.path.islink(root) or not os.path.isdir(root):
            raise InvalidInput(f"not a directory: {root}")
        if QUARANTINE in root.lower().split("/"):
            raise InvalidInput("a quarantine can't be a root")
        for other in [*p["roots"], self.folder]:
            if (root + "/").startswith(other + "/") or (other + "/").startswith(root + "/"):
                raise InvalidInput(f"{root} overlaps {other}")
        return self.update(name, roots=[*p["roots"], root], primary=p["primary"] + [root] * primary)

    def remove_root(self, name: str, root: str) -> dict:
        p, root = self.project(name), os.path.abspath(root)
        return self.update(name, roots=[r for r in p["roots"] if r != root], primary=[r for r in p["primary"] if r != root])

    def archive(self, name: str, confirm: str) -> dict:
        _confirmed(confirm, "ARCHIVE")
        if self.project(name, active=False)["status"] == "archived":
            return self.project(name, active=False)
        return self.update(name, status="archived")

    def rename(self, name: str, to: str) -> dict:
        p, projects = self.project(name), self.projects()
        if not to.strip() or to in projects:
            raise InvalidInput(f"there is a project {to!r}, or it has no name")
        self._store({to if k == name else k: v for k, v in projects.items()})
        return p

    def set_workers(self, name: str, workers: int) -> dict:
        """How many tasks read one volume at once."""
        if not 1 <= workers <= 64:
            raise InvalidInput("1 to 64 workers")
        return self.update(name, workers=workers)

    def filter(self, name: str) -> dict:
        return self.project(name)["filter"]

    def save_filter(self, name: str, include: str = "", exclude: str = "", globs: str = "", minimum: int = 0, skip_hidden: bool = True) -> dict:
        """Lists are separated by commas."""
        split = lambda x: tuple(v.strip() for v in x.split(",") if v.strip())
        if minimum < 0:
            raise InvalidInput("no negative size")
        config = filters.FilterConfig(filters.clean_extensions(split(include)), filters.clean_extensions(split(exclude)), split(globs), minimum, skip_hidden)
        config.condition(F.col("path"), F.col("size_bytes"))  # a glob that can't be read raises
        return self.update(name, filter=asdict(config))

    def roots(self, name: str) -> list[dict]:
        """Primary roots first, each kind by path."""
        p = self.project(name, active=False)
        return sorted(({"root": r, "primary": r in p["primary"]} for r in p["roots"]), key=lambda r: (not r["primary"], r["root"]))

    # sessions: Parquet, written once by stage, so that a stopped one goes on where it was

    def scan(self, name: str, all_files: bool = False, minimum: int | None = None) -> str:
        """Lists, filters and compares the project's files; only candidates are read. Returns the session."""
        p = self.project(name)
        if not p["roots"]:
            raise InvalidInput("the project has no root")
        session = self.sessions.create(name)
        config = filters.FilterConfig(**{k: tuple(v) if isinstance(v, list) else v for k, v in p["filter"].items()}).run(all_files, minimum)
        self._write_json("filter", asdict(config), session)
        return self._run(session)

    def resume_scan(self, session: str) -> str:
        """Goes on with a paused or interrupted session; what its unfinished stage wrote goes first. A session with a plan is kept as it is."""
        status = self.sessions.status(session)
        if status["state"] not in ("paused", "interrupted"):
            raise StateError(f"the session is {status['state']}")
        if any(x["session"] == session for x in self.plans()):
            raise StateError("the session has a plan")
        self.sessions.request(session, "resume")
        for stage in self.sessions.remaining(session):
            shutil.rmtree(self._path("sessions", session, stage), ignore_errors=True)
        return self._run(session)

    def _write_json(self, kind: str, value, *parts: str) -> None:
        os.makedirs(self._path("sessions", *parts), exist_ok=True)
        with open(self._path("sessions", *parts, kind + ".json"), "w") as f:
            json.dump(value, f)

    def _run(self, session: str) -> str:
        work = {"enumerating": self._enumerate, "quick_hashing": self._quick, "full_hashing": self._full, "grouping": self._group}
        try:
            for stage in self.sessions.remaining(session):
                self.sessions.poll(session)
                self.sessions.set_state(session, stage)
                self.sessions.finished(session, stage, work[stage](session))
            self.sessions.poll(session)
            self.sessions.set_state(session, "completed")
        except Stopped:
            raise
        except Exception:
            self.sessions.set_state(session, "failed")
            raise
        return session

    def _stage(self, session: str, stage: str) -> DataFrame:
        return self.spark.read.parquet(self._path("sessions", session, stage))

    def _enumerate(self, session: str) -> dict:
        p = self.project(self.sessions.status(session)["project"])
        found = reduce(lambda a, b: a.unionByName(b), [scan_files(self.spark, r).withColumn("root", F.lit(r)) for r in p["roots"]])
        found, seen = maintenance.observed_counters(found, f"scan-{session}")
        found.write.parquet(self._path("sessions", session, "enumerating"))
        return dict(seen.get)

    def _quick(self, session: str) -> dict:
        p = self.project(self.sessions.status(session)["project"])
        wanted = detect.by_volume(detect.candidates(self.inventory(session), p["mode"]), p["workers"]).drop("volume_key", "lane")
        with_digests(wanted, quick=True).write.parquet(self._path("sessions", session, "quick_hashing"))
        done = self._stage(session, "quick_hashing").agg(F.count(F.lit(1)).alias("candidates"), F.coalesce(F.sum("bytes_read"), F.lit(0)).alias("quick_bytes"), F.count("read_error").alias("quick_errors"))
        return done.first().asDict()

    def _full(self, session: str) -> dict:
        p = self.project(self.sessions.status(session)["project"])
        quick = self._stage(session, "quick_hashing").where("stable").drop("bytes_read", "stable", "read_error")
        key = [*detect.keys(p["mode"]), "quick"]
        again = quick.groupBy(*key).count().where("count >= 2").drop("count")
        wanted = detect.by_volume(quick.join(again, key, "left_semi"), p["workers"]).drop("volume_key", "lane", "name", "quick")
        with_digests(wanted).write.parquet(self._path("sessions", session, "full_hashing"))
        done = self._stage(session, "full_hashing").agg(F.coalesce(F.sum("bytes_read"), F.lit(0)).alias("full_bytes"), F.count_if(~F.col("stable")).alias("unstable"), F.count("read_error").alias("full_errors"))
        return done.first().asDict()

    def _group(self, session: str) -> dict:
        p = self.project(self.sessions.status(session)["project"])
        proven = self._stage(session, "full_hashing").where("stable").drop("bytes_read", "stable", "read_error")
        detect.members(proven, p["mode"]).write.parquet(self._path("sessions", session, "grouping"))
        return self._stage(session, "grouping").agg(F.countDistinct("group_id").alias("groups"), F.count(F.lit(1)).alias("members")).first().asDict()

    def scan_status(self, session: str) -> dict:
        return self.sessions.status(session)

    def pause_scan(self, session: str) -> dict:
        self.sessions.request(session, "pause")
        return self.sessions.status(session)

    def cancel_scan(self, session: str) -> dict:
        try:
            self.sessions.request(session, "cancel")
        except Stopped:
            pass
        return self.sessions.status(session)

    def errors(self, session: str) -> DataFrame:
        """(path, stage, error) of everything that couldn't be listed or read."""
        out = self._stage(session, "enumerating").where("outcome = 'error' or error is not null").select("path", F.lit("enumerating").alias("stage"), "error")
        for stage in ("quick_hashing", "full_hashing"):
            if os.path.isdir(self._path("sessions", session, stage)):
                out = out.unionByName(self._stage(session, stage).where("read_error is not null").select("path", F.lit(stage).alias("stage"), F.col("read_error").alias("error")))
        return out

    def _project_of(self, session: str) -> str:
        status = self.sessions.status(session)
        if status["state"] != "completed":
            raise InvalidInput(f"no completed session {session!r}")
        return status["project"]

    def inventory(self, session: str) -> DataFrame:
        """The files that the session's filter lets pass."""
        with open(self._path("sessions", session, "filter.json")) as f:
            config = filters.FilterConfig(**{k: tuple(v) if isinstance(v, list) else v for k, v in json.load(f).items()})
        return filters.apply(self._stage(session, "enumerating").where("outcome = 'file'").drop("outcome"), config)

    def members(self, session: str) -> DataFrame:
        self._project_of(session)
        return self._stage(session, "grouping")

    def results(self, session: str, page: int = 0) -> DataFrame:
        """A page of 40 groups with their paths, large files first."""
        return catalog.groups_page(catalog.ordered_groups(self.members(session)), page)

    def history(self, session: str, page: int = 0, text: str = "") -> DataFrame:
        files, numbers = self.inventory(session), [x["plan"] for x in self.plans() if x["session"] == session]
        items = self.plan(numbers[-1]) if numbers else self.members(session).withColumns({"action": F.lit(None).cast("string"), "reason": F.lit(None).cast("string")})
        shown = files.select("path", "size_bytes", "modified_ns", "access_status")
        return history.page(history.search(history.history(shown, items), text), page) if text.strip() else history.page_of(shown, items, page, stored=True)

    def storage(self, session: str) -> DataFrame:
        return history.storage(self.inventory(session))

    # plans

    def plans(self) -> list[dict]:
        """Oldest first."""
        try:
            with open(self._path("plans.json")) as f:
                return json.load(f)
        except FileNotFoundError:
            return []

    def _plan_state(self, number: str, status: str) -> None:
        plans = [x | {"status": catalog.plan_moved(x["status"], status)} if x["plan"] == number and x["status"] != status else x for x in self.plans()]
        self._replace("plans.json", plans)

    def _replace(self, name: str, value) -> None:
        with open(self._path(name + ".new"), "w") as f:
            json.dump(value, f, indent=1)
            f.flush()
            os.fsync(f.fileno())
        os.replace(self._path(name + ".new"), self._path(name))

    def create_plan(self, session: str, policy: str = keep.DEFAULT) -> str:
        project = self._project_of(session)
        number = uuid.uuid4().hex
        plan.seal(keep.recommend(self.members(session), policy, tuple(self.project(project)["primary"]))).withColumn("session", F.lit(session)).write.parquet(self._path("plans", number))
        self._replace("plans.json", [*self.plans(), {"plan": number, "session": session, "project": project, "status": "sealed", "created_ns": time.time_ns()}])
        return number

    def latest_plan(self, session: str) -> dict | None:
        return next((x for x in reversed(self.plans()) if x["session"] == session), None)

    def plan(self, number: str) -> DataFrame:
        if not os.path.isdir(self._path("plans", number)):
            raise InvalidInput(f"no plan {number!r}")
        return self.spark.read.parquet(self._path("plans", number))

    def validate(self, number: str) -> dict:
        """Whether the plan can be carried out: its seal, what has changed since, and its totals."""
        items = self.plan(number)
        digest = items.first().plan_digest if not items.isEmpty() else None
        now = items.drop("plan_digest").agg(plan.set_digest("group_id", "path", "action")).first()[0]
        return {"sealed": digest == now and plan.seal_violations(items).isEmpty(), "changed": self.drift(number).count(), **plan.summary(items).first().asDict()}

    def drift(self, number: str) -> DataFrame:
        """What changed on disk since the plan was sealed, by metadata."""
        items = self.plan(number)
        roots = self.project(self._plan(number)["project"])["roots"]
        now = reduce(lambda a, b: a.unionByName(b), [read_files(self.spark, r) for r in roots])
        return plan.drift(items, now, ("size_bytes", "modified_ns", "volume_id", "file_id"))

    def _plan(self, number: str) -> dict:
        found = next((x for x in self.plans() if x["plan"] == number), None)
        if found is None:
            raise InvalidInput(f"no plan {number!r}")
        return found

    # quarantine

    def quarantine(self, number: str, confirm: str, retention_days: int = RETENTION_DAYS) -> int:
        """Carries a fresh plan out; returns the files moved. Files go below their own root, on the same file system."""
        _confirmed(confirm, "QUARANTINE")
        about = self._plan(number)
        if about["status"] == "sealed" and not self.drift(number).isEmpty():
            raise SafetyError("files changed since the plan was sealed")
        if about["status"] != "sealed":
            raise SafetyError(f"the plan is {about['status']}")
        items = self.plan(number)
        roots = self.project(about["project"])["roots"]
        self._plan_state(number, "executing")
        book, n, now = ledger.Ledger(self._path("ledger")), 0, time.time_ns()
        try:
            keepers = items.where("action = 'keep'").select("group_id", F.col("path").alias("keeper"))
            for r in items.where("action = 'quarantine'").join(keepers, "group_id").orderBy("path").toLocalIterator():  # effects are the driver's alone
                root = next((x for x in roots if r.path.startswith(x + "/")), None)
                if root is None or r.volume_id is None or r.file_id is None:
                    raise SafetyError(f"{r.path} is outside every root, or of unknown identity")
                target = os.path.join(root, QUARANTINE, number, r.path[len(root) + 1 :])
                facts = {"entry": uuid.uuid4().hex, "project": about["project"], "session": about["session"], "group": r.group_id, "plan": number, "at_ns": now, "retain_until_ns": now + retention_days * 86_400 * 10**9}
                effect.move(book, f"{number}:{r.path}", r.path, target, r.size_bytes, r.sha256, r.keeper, blake3=r.blake3, identity=(r.volume_id, r.file_id), **facts)
                n += 1
        finally:
            book.close()
        self._plan_state(number, "completed")
        return n

    def _events(self, book: str) -> list[dict]:
        try:
            with open(self._path(book, "events.jsonl")) as f:
                return [json.loads(x) for x in f]
        except FileNotFoundError:
            return []

    def events(self) -> list[dict]:
        return self._events("ledger")

    def moves(self) -> dict[str, dict]:
        """The planned facts of each move with its current state."""
        out: dict[str, dict] = {}
        for e in self.events():
            out.setdefault(e["entity"], e)
            out[e["entity"]] = out[e["entity"]] | {"state": e["state"]}
        return out

    def _removed(self) -> dict[str, str]:
        """The state of removal of each entry that a batch holds."""
        item, out = {}, {}
        for e in self._events("removals"):
            if "item" in e:
                item[e["entity"]] = e["item"]["entry"]
            if e["entity"] in item and e["state"] in ("deleting", "failed", "deleted"):
                out[item[e["entity"]]] = "deleted" if e["state"] == "deleted" else "deleting"
        return out

    def entries(self) -> list[dict]:
        """What is or was in quarantine: newest first, then by entry. delete_state: active, deleting, deleted or restored."""
        moves, removed = self.moves(), self._removed()
        out = []
        for name, m in moves.items():
            if m["kind"] == "quarantine":
                back = moves.get(f"restore:{name}", {}).get("state") == "verified"
                out.append({"name": name, **m, "path": m["source"], "delete_state": "restored" if back else removed.get(m["entry"], "active")})
        return sorted(out, key=lambda e: (-e["at_ns"], e["entry"]))

    def quarantine_list(self, text: str = "", state: str | None = None, since_ns: int | None = None) -> list[dict]:
        """Entries by a part of either path, effective state and time."""
        text, out = text.strip().lower(), []
        for e in self.entries():
            effective = e["state"] if e["delete_state"] == "active" else e["delete_state"]
            if text in e["path"].lower() + "\n" + e["destination"].lower() and state in (None, effective) and (since_ns is None or e["at_ns"] >= since_ns):
                out.append(e | {"effective_state": effective})
        return out

    def _explicit(self, names: str) -> list[dict]:
        """Entries by id, separated by commas; each once, all there, of one project."""
        wanted, known = [x for x in names.split(",") if x], {e["entry"]: e for e in self.entries()}
        if len(set(wanted)) != len(wanted) or not wanted:
            raise InvalidInput("no entry is selected, or one twice")
        lost = [x for x in wanted if x not in known or known[x]["state"] != "verified" or known[x]["delete_state"] != "active"]
        if lost:
            raise SafetyError(f"not in quarantine: {', '.join(lost)}")
        return [known[x] for x in wanted]

    def delete_prepare(self, entries: str, immediate: bool = False, ttl: int = removal.TTL_SECONDS) -> dict:
        """A batch to remove for good, with the token and phrase that confirm it. Nothing is removed."""
        book = removal.open_book(self._path("removals"))
        try:
            keys = ("entry", "project", "destination", "size_bytes", "sha256", "blake3", "state", "delete_state", "retain_until_ns")
            return removal.prepare(book, [{k: e[k] for k in keys} for e in self._explicit(entries)], None, immediate, ttl)
        finally:
            book.close()

    def delete_execute(self, batch: str, token: str, phrase: str) -> dict:
        stored = next((e for e in self._events("removals") if e["entity"] == batch), None)
        if stored is None:
            raise InvalidInput(f"no batch {batch!r}")
        book = removal.open_book(self._path("removals"))
        try:
            return removal.execute(book, stored | {"batch": batch}, token, phrase, stored=stored)
        finally:
            book.close()

    def restore(self, number: str, confirm: str) -> int:
        """Moves back what a plan moved and nothing restored yet."""
        return self.restore_by(confirm, plan=number)

    def restore_by(self, confirm: str, entry: str | None = None, session: str | None = None, group: str | None = None, project: str | None = None, plan: str | None = None) -> int:
        """Moves back the quarantined files of one scope, oldest first; returns how many."""
        _confirmed(confirm, "RESTORE")
        scopes = {k: v for k, v in {"entry": entry, "session": session, "group": group, "project": project, "plan": plan}.items() if v is not None}
        if len(scopes) != 1:
            raise InvalidInput("restore by exactly one of entry, session, group, project, plan")
        ((kind, value),) = scopes.items()
        if kind == "entry":
            found = self._explicit(value)
        else:
            found = [e for e in reversed(self.entries()) if e[kind] == value and e["state"] == "verified" and e["delete_state"] == "active"]
        book = ledger.Ledger(self._path("ledger"))
        try:
            for e in found:
                effect.move(book, f"restore:{e['name']}", e["destination"], e["source"], e["size_bytes"], e["sha256"], kind="restore", blake3=e["blake3"])
        finally:
            book.close()
        return len(found)

    def reconcile(self, confirm: str) -> dict[str, str]:
        """Settles every move that was interrupted."""
        _confirmed(confirm, "RECONCILE")
        moves = self.moves()
        book = ledger.Ledger(self._path("ledger"))
        try:
            return {k: effect.reconcile(book, k, m["source"], m["destination"], m["size_bytes"], m["sha256"]) for k, m in moves.items() if m["state"] in ledger.PENDING}
        finally:
            book.close()

    # reports and upkeep

    def export(self, number: str, kind: str, path: str) -> None:
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
        report.export(report.rows(self.plan(number)), kind, path)

    def check(self) -> dict[str, int]:
        """Reads every stored table; rows of each."""
        return maintenance.check_tables(self.spark, self.folder)

    def backup(self, target: str) -> str:
        """Copies the workspace; never overwrites."""
        target = os.path.abspath(target)
        if os.path.lexists(target) or (target + "/").startswith(self.folder + "/"):
            raise InvalidInput("the target exists, or is within the workspace")
        shutil.copytree(self.folder, target, ignore=shutil.ignore_patterns("*.lock"))
        return target

    def optimize(self, session: str) -> dict[str, int]:
        """Rewrites a session's inventory into fewer files; refused while a scan runs."""
        if any(self.sessions.status(s)["state"] not in ("completed", "cancelled", "failed", "paused", "interrupted") for s in {r["session"] for r in self.sessions.records()}):
            raise StateError("a scan is running")
        source, target = self._path("sessions", session, "enumerating"), self._path("sessions", session, "compacted")
        found = report.compact(self.spark, source, target, 1)
        os.replace(source, source + ".old")
        os.replace(target, source)
        shutil.rmtree(source + ".old")
        return found

    def clean_logs(self, days: int) -> dict[str, int]:
        return maintenance.clean_logs(self._path("logs"), days)


def _confirmed(given: str, token: str) -> None:
    if given != token:
        raise InvalidInput(f"confirm with {token}")


COMMANDS = {
    "check": ("check",),
    "backup": ("backup", "target"),
    "project-create": ("create", "name", "--mode", "--acknowledged"),
    "project-update": ("rename", "name", "to"),
    "project-set-workers": ("set_workers", "name", "workers"),
    "project-filter": ("save_filter", "name", "--include", "--exclude", "--globs", "--minimum"),
    "project-add-root": ("add_root", "name", "root", "--primary"),
    "project-remove-root": ("remove_root", "name", "root"),
    "project-roots": ("roots", "name"),
    "project-archive": ("archive", "name", "confirm"),
    "project-list": ("projects",),
    "scan": ("scan", "name", "--all_files", "--minimum"),
    "scan-pause": ("pause_scan", "session"),
    "scan-resume": ("resume_scan", "session"),
    "scan-cancel": ("cancel_scan", "session"),
    "scan-status": ("scan_status", "session"),
    "scan-errors": ("errors", "session"),
    "results": ("results", "session", "--page"),
    "history": ("history", "session", "--page", "--text"),
    "storage": ("storage", "session"),
    "optimize": ("optimize", "session"),
    "clean-logs": ("clean_logs", "days"),
    "plan-create": ("create_plan", "session", "--policy"),
    "plan-latest": ("latest_plan", "session"),
    "plan-validate": ("validate", "number"),
    "plan-drift": ("drift", "number"),
    "dry-run": ("plan", "number"),
    "quarantine": ("quarantine", "number", "confirm", "--retention_days"),
    "quarantine-list": ("quarantine_list", "--text", "--state"),
    "delete-prepare": ("delete_prepare", "entries", "--immediate", "--ttl"),
    "delete-execute": ("delete_execute", "batch", "token", "phrase"),
    "restore": ("restore_by", "confirm", "--entry", "--session", "--group", "--project", "--plan"),
    "recover-inspect": ("moves",),
    "recover-reconcile": ("reconcile", "confirm"),
    "report": ("export", "number", "kind", "path"),
}
_SWITCHES, _NUMBERS = {"--acknowledged", "--primary", "--all_files", "--immediate"}, {"--minimum", "--page", "--ttl", "--retention_days", "workers", "days"}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="echofold")
    parser.add_argument("--workspace", required=True)
    sub = parser.add_subparsers(dest="command", required=True)
    for name, (_, *arguments) in COMMANDS.items():
        p = sub.add_parser(name)
        for a in arguments:
            p.add_argument(a, **({"action": "store_true"} if a in _SWITCHES else {"type": int} if a in _NUMBERS else {}))
    given = vars(parser.parse_args(argv))
    method = COMMANDS[given.pop("command")][0]
    spark = spark or SparkSession.builder.appName("echofold").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        out = getattr(Workspace(spark, given.pop("workspace")), method)(**{k: v for k, v in given.items() if v is not None})
        if isinstance(out, DataFrame):
            out = plan.dry_run(out).collect() if method == "plan" else out.collect()
            out = [r.asDict(recursive=True) for r in out]
        print(json.dumps(out, default=str))
        return 0
    except Stopped as e:
        print(json.dumps({"stopped": str(e)}))
        return e.exit_code
    except EngineError as e:
        print(json.dumps({"error": str(e), "retryable": e.retryable}), file=sys.stderr)
        return e.exit_code


if __name__ == "__main__":
    sys.exit(main())
