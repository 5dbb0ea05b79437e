import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from echofold.errors import DurabilityError, InvalidInput, SafetyError, StateError
from echofold.functions.blake3 import digests
from echofold.operators import detect, filters, history, keep, ledger, plan, progress, report

INVENTORY = "path string, size_bytes long, modified_ns long, volume_id string, file_id string, hardlink_count long, access_status string, content binary"


def files(spark, rows):
    full = [(p, len(c) if c is not None else 0, m, v, f, n, a, c) for p, c, m, v, f, n, a in rows]
    return spark.createDataFrame(full, INVENTORY)


def f(path, content, modified=0, volume=None, file=None, links=1, access="readable"):
    return path, content, modified, volume, file, links, access


def test_detection_rules(spark):
    inv = files(spark, [
        f("/a/book.pdf", b"0123456789"), f("/b/book.pdf", b"0123456789"), f("/c/Renamed.epub", b"0123456789"), f("/d/book.pdf", b"0123456788"),
        f("/e/book.pdf", b"0123456789", volume="v", file="1"), f("/f/book.pdf", b"0123456789", volume="v", file="1"), f("/g/book.pdf", b"0123456789", links=2),
        f("/h/book.pdf", b"0123456789", access="denied"), f("/i/empty", b""), f("/j/empty", b""), f("/k/alone", b"zz"),
    ])
    strict = {(r.size_bytes, r.name): (r.files, r.reclaimable_bytes) for r in detect.groups(inv, detect.STRICT).collect()}
    assert strict == {(10, "book.pdf"): (3, 20), (0, "empty"): (2, 0)}
    content = {r.size_bytes: r.files for r in detect.groups(inv, detect.CONTENT).collect()}
    assert content == {10: 4, 0: 2}
    key = lambda df: sorted((r.group_id, r.path) for r in df.collect())
    assert key(detect.members(inv, detect.CONTENT)) == key(detect.members(inv, detect.CONTENT, cascade=True))
    assert {r.path for r in detect.members(inv, detect.STRICT).collect()} == {"/a/book.pdf", "/b/book.pdf", "/e/book.pdf", "/i/empty", "/j/empty"}
    t = detect.telemetry(inv, detect.CONTENT).first()
    assert (t.files, t.unreadable, t.linked) == (11, 1, 1)


def test_quick_signature_samples(spark):
    n = 300_000
    base = bytearray(b"k" * n)
    other = bytearray(base)
    other[70_000] = 0  # outside every sample
    seen = bytearray(base)
    seen[n // 2] = 0
    df = spark.createDataFrame([(bytes(x), n) for x in (base, other, seen)], "c binary, n long")
    a, b, c = (r[0] for r in df.select(detect.quick_signature(F.col("c"), F.col("n"))).collect())
    assert a == b != c
    assert spark.range(1).select(detect.reclaimable(F.lit(1 << 62), F.lit(9).cast("long"))).first()[0] == (1 << 63) - 1


def test_keepers(spark):
    rows = [("g", "/src10/x", 1), ("g", "/src1/yy", 5), ("g", "/a", 1), ("h", "/p/a-b", 2), ("h", "/p/a/b", 2)]
    m = spark.createDataFrame(rows, "group_id string, path string, modified_ns long")
    kept = lambda policy: {r.group_id: r.path for r in keep.recommend(m, policy, ("/src1",)).where("action = 'keep'").collect()}
    assert kept(keep.DEFAULT) == {"g": "/src1/yy", "h": "/p/a/b"}  # components, not bytes: a before a-b
    assert kept(keep.OLDEST)["g"] == "/a" and kept(keep.NEWEST)["g"] == "/src1/yy" and kept(keep.SHORTEST)["g"] == "/a"
    keep.check_one_keeper(keep.recommend(m))
    with pytest.raises(InvalidInput):
        keep.recommend(m, "largest")
    with pytest.raises(SafetyError):
        keep.check_one_keeper(keep.recommend(m).withColumn("action", F.lit("keep")))
    chosen = spark.createDataFrame([("g", "/a"), ("h", "/elsewhere")], "group_id string, path string")
    assert {r.path: r.action for r in keep.recommend_manual(m, chosen).collect()} == {"/src10/x": "quarantine", "/src1/yy": "quarantine", "/a": "keep", "/p/a-b": "manual", "/p/a/b": "manual"}


def test_filters_and_roots(spark):
    rows = [("/x/A.PDF", 200), ("/x/b.epub", 200), ("/x/cache/c.pdf", 200), ("/x/d.pdf", 99), ("/x/.e.pdf", 200), ("/x/none", 200)]
    inv = spark.createDataFrame(rows, "path string, size_bytes long")
    names = lambda c: {r.path for r in filters.apply(inv, c).collect()}
    config = filters.FilterConfig(include=(".PDF", "epub"), exclude=("EPUB",), globs=("**/cache/**",), minimum=100)
    assert names(config) == {"/x/A.PDF"}
    assert "/x/none" in names(config.run(all_files=True)) and "/x/d.pdf" in names(config.run(minimum=0))
    roots = spark.createDataFrame([(0, "/a/b"), (1, "/a"), (2, "/a"), (3, "/c/.echofold-quarantine"), (4, "/ab")], "ordinal long, root string")
    assert {r.ordinal: (r.status, r.covered_by) for r in filters.validate_roots(roots).collect()} == {0: ("covered", "/a"), 1: ("valid", None), 2: ("duplicate", None), 3: ("forbidden", None), 4: ("valid", None)}


def test_ledger(spark, tmp_path):
    states = {a for s in ledger.TRANSITIONS for a in s}
    assert len(states) == 13 and not {a for a, _ in ledger.TRANSITIONS} & set(ledger.TERMINAL)
    assert {a for a, b in ledger.TRANSITIONS if b == "verified"} == {"moved_unverified", "recovery_required"} and all(a != b for a, b in ledger.TRANSITIONS)
    book = ledger.Ledger(str(tmp_path / "l"))
    with pytest.raises(DurabilityError):
        ledger.Ledger(str(tmp_path / "l"))
    one = book.append(None, "planned", size=3)
    book.append(one, "preflight_validated", expected="planned")
    for bad in ({"state": "verified"}, {"state": "moving", "expected": "planned"}):
        with pytest.raises(StateError):
            book.append(one, **bad)
    with pytest.raises(StateError):
        book.append("new", "moving")
    with pytest.raises(InvalidInput):
        book.append(one, "moving", sequence=1)
    book.close()
    again = ledger.Ledger(str(tmp_path / "l"))
    assert again.states == {one: "preflight_validated"} and again.append(one, "moving") == one
    assert ledger.current_state(again.frame(spark)).first().state == "moving" and ledger.violations(again.frame(spark)).count() == 0


def test_recovery(spark):
    df = spark.createDataFrame([(s, d, st) for s in (True, False) for d in (True, False) for st in ("moving", "planned", "verified")], "s boolean, d boolean, state string")
    out = df.withColumn("o", ledger.recovery(F.col("s"), F.col("d"))).withColumn("after", ledger.reconciled_state(F.col("state"), F.col("o")))
    got = {(r.s, r.d, r.state): r.after for r in out.collect()}
    assert got[False, True, "moving"] == "verified" and got[False, True, "planned"] == "planned"
    assert got[True, True, "planned"] == "reconciled_both" and got[False, False, "moving"] == "reconciled_missing" and got[True, False, "verified"] == "verified"


def test_plans(spark):
    rows = [("g", "/a", "keep", 5), ("g", "/b", "quarantine", 5), ("h", "/c", "quarantine", 7), ("k", "/d", "keep", 1), ("m", "/e", "manual", 1)]
    items = spark.createDataFrame(rows, "group_id string, path string, action string, size_bytes long")
    assert {r.group_id: r.violation for r in plan.seal_violations(items).collect()} == {"h": "not one keeper", "k": "nothing to remove", "m": "manual member"}
    with pytest.raises(SafetyError):
        plan.seal(items)
    good = plan.seal(items.where("group_id = 'g'")).collect()
    assert len({r.plan_digest for r in good}) == 1
    assert tuple(plan.summary(items).first()) == (2, 2, 12) and tuple(plan.summary(items.limit(0)).first()) == (0, 0, 0)
    assert [(r.path, r.destination) for r in plan.dry_run(items).collect()] == [("/b", "/quarantine/s1/g/b")]


def test_history_and_progress(spark):
    rows = [("/A", "G1", 1, "readable"), ("/b", None, 2, "locked"), ("/c%", None, 3, "missing")]
    h = spark.createDataFrame(rows, "path string, group_id string, modified_ns long, access_status string")
    assert tuple(history.totals(h).first()) == (3, 1, 1, 1)
    for text, n in (("", 3), (" a ", 1), ("g1", 1), ("%", 1), ("Ä", 0)):
        assert history.search(h, text).count() == n
    assert [r.path for r in history.page(h, 0, 2).collect()] == ["/c%", "/b"] and history.page(h, 0, 0).count() == 1
    e = spark.createDataFrame([("s", 0, 5), ("s", 4000, 3), ("s", 9001, 1)], "id string, ms long, n long")
    assert [r.window_amount for r in progress.rolling_rate(e, "id", "ms", "n").orderBy("ms").collect()] == [5, 8, 1]
    assert [r.max_n for r in progress.monotonic(e, "id", "ms", ("n",)).orderBy("ms").collect()] == [5, 5, 5]
    one = spark.range(1).select(progress.basis_points(F.lit(0), F.lit(0)), progress.basis_points(F.lit(1), F.lit(3)), progress.eta_seconds(F.lit(10), F.lit(0), F.lit(3)), progress.eta_seconds(F.lit(1), F.lit(0), F.lit(0)))
    assert tuple(one.first()) == (10_000, 3333, 4, None)


def test_sinks(spark, tmp_path):
    rows = [("g", "/<a>&'", 5, "keep", "r", "d"), ("g", '/b "x"', 5, "quarantine", "r", "d")]
    r = report.rows(spark.createDataFrame(rows, "group_id string, path string, size_bytes long, action string, reason string, sha256 string"))
    for kind in ("csv", "json", "html"):
        report.export(r, kind, str(tmp_path / kind))
        with pytest.raises(Exception):
            report.export(r, kind, str(tmp_path / kind))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert back.columns == list(report.COLUMNS) and {x.path for x in back.collect()} == {"/<a>&'", '/b "x"'}
    (group,) = json.loads((tmp_path / "json" / "report.json").read_text())
    assert len(group["members"]) == 2 and group["members"][0]["verified"] is False and group["members"][0]["blake3"] is None
    page = (tmp_path / "html" / "report.html").read_text()
    assert page.startswith("<!DOCTYPE html>") and page.count("<tr class=") == 2 and page.rstrip().endswith("</html>")
    assert "&lt;a&gt;&amp;&#39;" in "".join(x.value for x in spark.read.text(str(tmp_path / "html")).collect())
    with pytest.raises(InvalidInput):
        report.export(r, "pdf", str(tmp_path / "pdf"))
    path = str(tmp_path / "sessions")
    report.replace_session(spark.createDataFrame([(1, "a"), (2, "b")], "session_id int, x string"), path)
    report.replace_session(spark.createDataFrame([(2, "c")], "session_id int, x string"), path)
    assert {(x.session_id, x.x) for x in spark.read.parquet(path).collect()} == {(1, "a"), (2, "c")}
    report.backup(spark, path, str(tmp_path / "backup"))
    assert report.compact(spark, path, str(tmp_path / "compact"), 1).items() >= {"rows": 2, "files": 1}.items()
    size = lambda n: spark.range(1).select(report.humanized(F.lit(n).cast("long"))).first()[0]
    assert [size(5), size(1536), size(5 << 30)] == ["5 B", "1.5 KiB", "5.0 GiB"]


def test_file_source(spark, tmp_path):
    from echofold.sources import files as S

    for name, data in {"a/x.PDF": b"same", "b/c/d/y.pdf": b"same", ".hidden": b"h", ".echofold-quarantine/q": b"q", "empty": b""}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    (tmp_path / "link").symlink_to(tmp_path / "a")
    os.link(tmp_path / "empty", tmp_path / "a" / "alias")
    found = S.read_files(spark, str(tmp_path))
    rows = {os.path.relpath(r.path, tmp_path): r for r in found.collect()}
    assert set(rows) == {"a/x.PDF", "b/c/d/y.pdf", ".hidden", "empty", "a/alias"}
    assert rows["a/x.PDF"].extension == "pdf" and rows[".hidden"].extension is None and rows["empty"].link_kind == "hardlink"
    read = S.with_digests(detect.candidates(found, detect.CONTENT)).collect()
    assert {(r.sha256, r.blake3) for r in read} == {(hashlib.sha256(b"same").hexdigest(), digests([b"same"])[0].hex())} and all(r.stable and r.bytes_read == 4 for r in read)
    quick = S.with_digests(found, quick=True).where("size_bytes = 4").select("quick", detect.quick_signature(F.lit(b"same"), F.lit(4).cast("long")).alias("want")).collect()
    assert len(quick) == 2 and all(r.quick == r.want for r in quick)
    big = tmp_path / "big"
    big.write_bytes(bytes(k % 251 for k in range(300_000)))
    assert S.quick_digest(str(big), 300_000) == (spark.createDataFrame([(bytearray(big.read_bytes()),)], "c binary").select(detect.quick_signature(F.col("c"), F.lit(300_000).cast("long"))).first()[0], 3 * S.SAMPLE)
    m = detect.members(S.with_digests(found).where("stable"), detect.CONTENT)
    assert m.count() == 2 and "blake3" in m.columns
    scan = {os.path.relpath(r.path, tmp_path): r for r in S.scan_files(spark, str(tmp_path)).collect()}
    assert scan["link"].outcome == "skipped" and scan["a/x.PDF"].token == scan["a/x.PDF"].token != scan["empty"].token
    from echofold.functions.text import snapshot_token

    tokens = found.select("token", snapshot_token(F.col("volume_id"), F.col("file_id"), F.col("size_bytes"), F.col("modified_ns")).alias("want")).collect()
    assert all(r.token == r.want for r in tokens)
    spark.dataSource.register(S.FileScanSink)
    S.scan_files(spark, str(tmp_path)).write.format("scan_sink").mode("append").option("path", f"{tmp_path}-sink").save()
    assert sorted(r.path for r in spark.read.json(f"{tmp_path}-sink").collect()) == sorted(r.path for r in S.scan_files(spark, str(tmp_path)).collect())
    assert all(n.startswith("part-") for n in os.listdir(f"{tmp_path}-sink"))
    with pytest.raises(Exception):
        S.read_files(spark, str(tmp_path / "nowhere")).count()
