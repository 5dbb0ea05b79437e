import json
import os

import pytest

from echofold.errors import InvalidInput, SafetyError, StateError
from echofold.operators import effect, ledger, removal
from echofold.operators.sessions import Stopped
from echofold.sources import files
from echofold.workspace import Workspace, main


def tree(folder, **files):
    for name, data in files.items():
        p = folder / name.replace("__", "/").replace("_pdf", ".pdf")
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)


def test_from_scan_to_restore(spark, tmp_path, capsys):
    root = tmp_path / "books"
    tree(root, a__book_pdf=b"same", b__book_pdf=b"same", c__book_pdf=b"else")
    w = Workspace(spark, str(tmp_path / "work"))
    w.create("p")
    w.add_root("p", str(root / "a"), primary=True)
    for bad in (str(root), str(root / "a"), str(root / "a" / "x")):
        with pytest.raises(InvalidInput):
            w.add_root("p", bad)
    w.add_root("p", str(root / "b"))
    w.add_root("p", str(root / "c"))
    session = w.scan("p")
    assert {os.path.basename(os.path.dirname(r.path)) for r in w.members(session).collect()} == {"a", "b"}
    number = w.create_plan(session)
    assert {r.path: r.action for r in w.plan(number).collect()} == {str(root / "a/book.pdf"): "keep", str(root / "b/book.pdf"): "quarantine"}
    with pytest.raises(InvalidInput):
        w.quarantine(number, "yes")
    assert w.quarantine(number, "QUARANTINE") == 1
    assert (root / "a/book.pdf").exists() and not (root / "b/book.pdf").exists()
    assert w.drift(number).first().drift == "missing"
    with pytest.raises(SafetyError):
        w.quarantine(number, "QUARANTINE")
    assert w.restore(number, "RESTORE") == 1 and (root / "b/book.pdf").read_bytes() == b"same"
    assert w.restore(number, "RESTORE") == 0 and w.reconcile("RECONCILE") == {}
    base = ["--workspace", str(tmp_path / "work")]
    assert main([*base, "report", number, "csv", str(tmp_path / "out")], spark) == 0
    assert main([*base, "dry-run", number], spark) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])[0]["keeper_path"] == str(root / "a/book.pdf")
    assert main([*base, "scan", "nobody"], spark) == 2
    assert main([*base, "project-archive", "p", "ARCHIVE"], spark) == 0 and main([*base, "scan", "p"], spark) == 5


def library(tmp_path, spark, n=3):
    root = tmp_path / "books"
    tree(root, **{f"{x}__book_pdf": b"same" * 50 for x in "abc"[:n]}, d__book_pdf=b"else")
    w = Workspace(spark, str(tmp_path / "work"))
    w.create("p")
    w.add_root("p", str(root))
    return root, w


def test_pause_resume_cancel(spark, tmp_path, monkeypatch):
    root, w = library(tmp_path, spark)
    (root / "link").symlink_to(root / "a")
    quick = w._quick

    def paused(session):
        out = quick(session)
        Workspace(spark, w.folder).pause_scan(session)  # another process asks
        return out

    monkeypatch.setattr(w, "_quick", paused)
    with pytest.raises(Stopped):
        w.scan("p")
    (session,) = {r["session"] for r in w.sessions.records()}
    status = w.scan_status(session)
    assert (status["state"], status["stage"], status["request"]) == ("paused", "quick_hashing", None)
    assert status["progress"] == {"files": 4, "skipped": 1, "errors": 0, "bytes": 604, "candidates": 3, "quick_bytes": 600, "quick_errors": 0}
    with pytest.raises(InvalidInput):
        w.members(session)
    assert w.sessions.remaining(session) == ["full_hashing", "grouping"]
    monkeypatch.undo()
    assert w.resume_scan(session) == session and w.members(session).count() == 3
    first = w.members(session).first()
    assert len(first.blake3) == 64 and first.blake3 != first.sha256
    number = w.create_plan(session)
    with pytest.raises(StateError):
        w.resume_scan(session)
    assert w.latest_plan(session)["plan"] == number and w.validate(number)["sealed"] and w.validate(number)["files"] == 2
    other = w.sessions.create("p")
    assert w.cancel_scan(other)["state"] == "cancelled"
    with pytest.raises(StateError):
        w.pause_scan(other)
    lost = w.sessions.create("p")
    assert w.sessions.interrupt_orphans() == [lost] and w.scan_status(lost)["state"] == "interrupted"


def test_errors_have_rows(spark, tmp_path, monkeypatch):
    root, w = library(tmp_path, spark)
    scan = files.os.scandir
    monkeypatch.setattr(files.os, "scandir", lambda p: (_ for _ in ()).throw(PermissionError(13, "denied", p)) if str(p).endswith("/b") else scan(p))
    found = {(p, what) for p, what, _ in files.walk(str(root))}
    assert (str(root / "b"), "error") in found and (str(root / "a/book.pdf"), "file") in found and (str(root / "b/book.pdf"), "file") not in found


def test_delete_and_restore_scopes(spark, tmp_path):
    root, w = library(tmp_path, spark)
    session = w.scan("p")
    number = w.create_plan(session)
    assert w.quarantine(number, "QUARANTINE", retention_days=0) == 2
    with pytest.raises(SafetyError):
        w.quarantine(number, "QUARANTINE")
    one, two = w.quarantine_list()
    assert one["effective_state"] == "verified" and w.quarantine_list("B/BOOK") and not w.quarantine_list(state="deleted")
    with pytest.raises(InvalidInput):
        w.delete_prepare(f"{one['entry']},{one['entry']}")
    with pytest.raises(SafetyError):
        w.delete_prepare("nobody")
    batch = w.delete_prepare(one["entry"])
    assert batch["phrase"] == "DELETE 1 FILES 200 BYTES"
    for token, typed in (("x", batch["phrase"]), (batch["token"], "yes")):
        with pytest.raises(InvalidInput):
            w.delete_execute(batch["batch"], token, typed)
    assert os.path.exists(one["destination"])
    assert w.delete_execute(batch["batch"], batch["token"], batch["phrase"]) == {"deleted": 1, "bytes": 200}
    assert not os.path.exists(one["destination"]) and w.quarantine_list(state="deleted")[0]["entry"] == one["entry"]
    with pytest.raises(StateError):
        w.delete_execute(batch["batch"], batch["token"], batch["phrase"])
    with pytest.raises(InvalidInput):
        w.restore_by("RESTORE", entry=two["entry"], session=session)
    with pytest.raises(SafetyError):
        w.restore_by("RESTORE", entry=one["entry"])
    assert w.restore_by("RESTORE", group="none") == 0 and w.restore_by("RESTORE", session=session) == 1
    assert os.path.exists(two["source"]) and w.restore_by("RESTORE", project="p") == 0
    assert w.check() and w.backup(str(tmp_path / "copy")) and w.optimize(session)["files"] == 1
    with pytest.raises(InvalidInput):
        w.backup(str(tmp_path / "copy"))
    assert [r.members for r in w.results(session).collect()][0][0].endswith("book.pdf")
    assert w.history(session).count() == 4 == w.history(session, text="BOOK").count()


def test_nothing_is_deleted_unless_all_is_as_proven(tmp_path):
    def entries(folder):
        out = []
        for k in range(3):
            path = folder / f"f{k}"
            folder.mkdir(exist_ok=True)
            path.write_bytes(b"x%d" % k)
            out.append({"entry": str(k), "project": "p", "destination": str(path), "size_bytes": 2, "sha256": effect.sha256_of(str(path)), "state": "verified", "delete_state": "active", "retain_until_ns": 5})
        return out

    book = removal.open_book(str(tmp_path / "l"))
    e = entries(tmp_path / "one")
    with pytest.raises(SafetyError):
        removal.prepare(book, e, now_ns=4)  # still to be kept
    for bad in ([], e + e[:1], [*e[:2], e[2] | {"project": "q"}]):
        with pytest.raises(InvalidInput):
            removal.prepare(book, bad, now_ns=9)
    b = removal.prepare(book, e, now_ns=9)
    (tmp_path / "one/f1").write_bytes(b"yy")  # tampered
    with pytest.raises(SafetyError):
        removal.execute(book, b, b["token"], b["phrase"], now_ns=10)
    assert sorted(os.listdir(tmp_path / "one")) == ["f0", "f1", "f2"] and book.states[b["batch"]] == "batch:recovery_required"
    b = removal.prepare(book, entries(tmp_path / "two"), now_ns=9, ttl=1)
    with pytest.raises(StateError):
        removal.execute(book, b, b["token"], b["phrase"], now_ns=2 * 10**9)
    assert book.states[b["batch"]] == "batch:expired"
    b = removal.prepare(book, entries(tmp_path / "three"), now_ns=9, immediate=True)

    def failing(path):  # a fault in the middle
        if path.endswith("f1"):
            raise OSError("disk")
        os.unlink(path)

    with pytest.raises(SafetyError):
        removal.execute(book, b, b["token"], b["phrase"], now_ns=10, delete=failing)
    assert sorted(os.listdir(tmp_path / "three")) == ["f1", "f2"]
    os.unlink(tmp_path / "three/f1")  # its removal had begun, so that it counts
    assert removal.execute(book, b, b["token"], b["phrase"], now_ns=11)["deleted"] == 3 and not os.listdir(tmp_path / "three")


def test_moves_never_replace_and_reconcile(tmp_path):
    book = ledger.Ledger(str(tmp_path / "l"))
    a, b, k = (str(tmp_path / x) for x in "abk")
    for p in (a, k):
        with open(p, "wb") as f:
            f.write(b"x")
    digest = effect.sha256_of(a)
    with open(b, "wb") as f:
        f.write(b"y")
    with pytest.raises(SafetyError):
        effect.move(book, "1", a, b, 1, digest, k)
    assert book.states["1"] == "preflight_failed" and open(b, "rb").read() == b"y"
    with pytest.raises(SafetyError):
        effect.move(book, "2", a, b + "2", 1, digest, b)  # the keeper isn't equal
    for name, here, there, state in (("3", 1, 0, "reconciled_source_only"), ("4", 0, 1, "verified"), ("5", 1, 1, "reconciled_both")):
        s, d = str(tmp_path / f"s{name}"), str(tmp_path / f"d{name}")
        for p, there_ in ((s, here), (d, there)):
            if there_:
                with open(p, "wb") as f:
                    f.write(b"x")
        for step in ("planned", "preflight_validated", "moving"):
            book.append(name, step)
        effect.reconcile(book, name, s, d, 1, digest)
        assert book.states[name] == state
    book.append("6", "planned")
    with pytest.raises(SafetyError):
        effect.reconcile(book, "6", str(tmp_path / "n1"), str(tmp_path / "n2"), 1, digest)
    assert book.states["6"] == "reconciled_missing"
