import os

import pytest
from pyspark.sql import functions as F

from echofold.errors import DurabilityError, InvalidInput, SafetyError, StateError
from echofold.operators import catalog, filters, keep, maintenance, plan
from echofold.operators.effect import sha256_of
from echofold.operators.sessions import Sessions


def test_what_the_catalogue_refuses(spark):
    members = spark.createDataFrame([("g", "s1"), ("g", "s2")], "group_id string, snapshot_id string")
    rows = [("s1", "blake3", "b", True), ("s1", "sha256", "a", True), ("s2", "sha256", "a", True)]
    evidence = spark.createDataFrame(rows, "snapshot_id string, stage string, digest string, stable boolean")
    with pytest.raises(StateError):
        catalog.with_evidence(members, evidence)
    assert [(r.snapshot_id, r.stage) for r in catalog.missing_evidence(members, evidence).collect()] == [("s2", "blake3")]
    assert {r.snapshot_id: r.verified for r in catalog.pivoted(evidence).collect()} == {"s1": True, "s2": False}
    registry = spark.createDataFrame([("a", "p", "verified", "active"), ("b", "q", "verified", "active"), ("c", "p", "moving", "active")], "entry string, project string, state string, delete_state string")
    ask = lambda *x: spark.createDataFrame([(v,) for v in x], "entry string")
    assert catalog.explicit(ask("a"), registry).count() == 1
    for asked, error in ((ask("a", "a"), InvalidInput), (ask("a", "b"), InvalidInput), (ask("c"), SafetyError), (ask("z"), SafetyError)):
        with pytest.raises(error):
            catalog.explicit(asked, registry)
    assert catalog.plan_moved("sealed", "executing") == "executing"
    with pytest.raises(StateError):
        catalog.plan_moved("completed", "sealed")
    states = spark.createDataFrame([("sealed",), ("odd",)], "status string")
    assert catalog.decoded(states.where("status = 'sealed'"), "status", catalog.PLAN_STATES).count() == 1
    with pytest.raises(Exception, match="unknown status"):
        catalog.decoded(states, "status", catalog.PLAN_STATES).collect()
    with pytest.raises(InvalidInput):
        keep.require_manual(spark.createDataFrame([("g", "/a", 1)], "group_id string, path string, modified_ns long"), spark.createDataFrame([("g", "/z")], "group_id string, path string"))


def test_digest_of_a_set(spark):
    rows = [("g", f"/{k}", "keep") for k in range(50)]
    of = lambda x: spark.createDataFrame(x, "group_id string, path string, action string").repartition(5).agg(plan.set_digest("group_id", "path", "action")).first()[0]
    assert of(rows) == of(rows[::-1]) and len({of(rows), of(rows[1:]), of(rows + rows[:1]), of([*rows[1:], ("g", "/0", "quarantine")])}) == 4


def test_places(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"), "id")
    got = catalog.numbered(rows, "-x").collect()
    assert all(r.ordinal == 999 - r.x for r in got) and len(got) == 1000
    assert catalog.numbered(rows.limit(0), "x").count() == 0


def test_attributes_of_files(spark):
    f = spark.createDataFrame([("/a.pdf", 1, True, False), ("/b.pdf", 1, False, True), ("/c.pdf", 1, False, False)], "path string, size_bytes long, system boolean, hidden boolean")
    assert [r.path for r in filters.apply(f, filters.FilterConfig()).collect()] == ["/c.pdf"]
    assert filters.apply(f, filters.FilterConfig(skip_system=False, skip_hidden=False)).count() == 3


def test_logs_and_downloads(tmp_path):
    log = maintenance.log_to(str(tmp_path / "logs"), "2024-01-02")
    log.info("hello", extra={"fields": {"session": "s"}})
    text = (tmp_path / "logs" / "echofold-2024-01-02.jsonl").read_text()
    assert '"message": "hello"' in text and '"session": "s"' in text
    (tmp_path / "logs" / "other.txt").write_text("x")
    for name in os.listdir(tmp_path / "logs"):
        os.utime(tmp_path / "logs" / name, (1, 1))
    with pytest.raises(InvalidInput):
        maintenance.clean_logs(str(tmp_path / "logs"), 6)
    assert maintenance.clean_logs(str(tmp_path / "logs"), 7)["removed_files"] == 2 and os.listdir(tmp_path / "logs") == ["other.txt"]
    part = tmp_path / "x.part"
    part.write_bytes(b"abc")
    digest = sha256_of(str(part))
    for size, d in ((2, digest), (3, "0" * 64)):
        with pytest.raises(SafetyError):
            maintenance.promote(str(part), str(tmp_path / "x"), size, d)
    maintenance.promote(str(part), str(tmp_path / "x"), 3, digest.upper())
    assert (tmp_path / "x").read_bytes() == b"abc" and not part.exists()


def test_containers():
    maintenance.container_settings("read-only", True, ("scan",))
    for mode, mounted, command in (("read-only", False, ("scan",)), ("read-write", True, ("scan",)), ("read-only", True, ("quarantine",)), ("read-write", False, ("delete-execute",)), ("odd", True, ("scan",))):
        with pytest.raises((SafetyError, InvalidInput)):
            maintenance.container_settings(mode, mounted, command)


def test_counters_and_progress(spark):
    scan = spark.createDataFrame([("file", None, 5), ("skipped", None, None), ("error", "no", None)], "outcome string, error string, size_bytes long")
    seen, counters = maintenance.observed_counters(scan, "t")
    seen.collect()
    assert counters.get == {"files": 1, "skipped": 1, "errors": 1, "bytes": 5}
    book = lambda *x: maintenance.download_progress(spark.createDataFrame(x, "id string, size_bytes long, received_bytes long, required boolean")).first()
    assert tuple(book(("a", 1000, 500, True), ("b", 3000, 1500, True), ("c", 9, 9, False))) == (4000, 2000, 5000)
    assert book(("a", 10, 0, False)).basis_points == 10_000
    with pytest.raises(Exception, match="twice"):
        book(("a", 1, 0, True), ("a", 1, 0, True))


def test_requests_are_answered_once(tmp_path):
    s = Sessions(str(tmp_path))
    one = s.create("p")
    s.set_state(one, "enumerating", "created")
    with pytest.raises(StateError):
        s.set_state(one, "grouping", "created")  # another has moved on
    s.request(one, "pause")
    assert s.status(one)["request"] == "pause"
    with pytest.raises(StateError):
        s.poll(one)
    assert s.status(one)["state"] == "paused" and s.status(one)["request"] is None
    s.poll(one)
    with pytest.raises(InvalidInput):
        s.status("nobody")
    with pytest.raises(DurabilityError):
        raise DurabilityError.of("open", "/x", OSError("gone"))
