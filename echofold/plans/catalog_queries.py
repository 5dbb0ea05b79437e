"""Queries of the session catalogue and of upkeep, with their SQL. Two sessions, plans and a registry are derived from documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echofold.functions import text as T
from echofold.functions.blake3 import blake3
from echofold.functions.shared import written
from echofold.operators import catalog, detect, ledger, maintenance, plan, report
from echofold.plans.registry import _INV, _MEM, _REC, _recommended, query
from echofold.sources import inventory as I

DAY = 86_400 * 10**9
_CAT = f"""{_REC},
sess as (select * from (values ('s1', 'p1'), ('s2', 'p2')) t(session_id, project)),
ent as (select doc_id as entry_id, path from named),
snap as (select concat('s1-', doc_id) as snapshot_id, 's1' as session_id, doc_id as entry_id, size_bytes, modified_ns, 100 + doc_id % 7 as observed_at, access_status, case when doc_id % 43 = 0 then 'error' else 'observed' end as state from named
  union all select concat('s2-', doc_id), 's2', doc_id, size_bytes, modified_ns + 1, 200 + doc_id % 7, access_status, 'observed' from named where doc_id % 3 <> 0),
cmem as (select group_id, concat('s1-', doc_id) as snapshot_id, path, doc_id from rec),
plans as (select * from (values ('p-old', 's1', 'sealed', 1, 1), ('p-new', 's1', 'executing', 2, 3), ('p-draft', 's1', 'draft', 9, null), ('p-s2', 's2', 'sealed', 4, null)) t(plan_id, session_id, status, created_at, sealed_at)),
items as (select 'p-new' as plan_id, group_id, concat('s1-', doc_id) as snapshot_id, path, action, 'new' as reason from rec
  union all select 'p-old', group_id, concat('s1-', doc_id), path, action, 'old' from rec where doc_id % 2 = 0),
tx as (select concat('t-', doc_id) as transaction_id, 'p-new' as plan_id, 's1' as session_id, group_id, concat('s1-', doc_id) as snapshot_id, case when modified_ns % 4 = 3 then 'moving' else 'verified' end as state from rec where action = 'quarantine'),
reg as (select doc_id as entry, concat('t-', doc_id) as transaction_id, source as project, path, concat('/q', path) as destination, size_bytes, modified_ns * {DAY} as at_ns, (modified_ns + 7) * {DAY} as retain_until_ns,
  case when modified_ns % 4 = 3 then 'moving' else 'verified' end as state, case when modified_ns % 5 = 4 then 'deleted' else 'active' end as delete_state from rec where action = 'quarantine'),
live as (select * from reg where state = 'verified' and delete_state = 'active')"""


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The catalogue's tables; documents are read once, and detection runs once."""
    docs = written(I.of_documents(spark, sf_dir).select("doc_id", "path", "size_bytes", "modified_ns", "access_status"))
    rec = written(_recommended(spark, sf_dir))
    name = lambda s: F.concat(F.lit(f"{s}-"), F.col("doc_id").cast("string"))
    i = F.col("doc_id")
    snap = docs.select(name("s1").alias("snapshot_id"), F.lit("s1").alias("session_id"), i.alias("entry_id"), "size_bytes", "modified_ns", (100 + i % 7).alias("observed_at"), "access_status", F.when(i % 43 == 0, "error").otherwise("observed").alias("state"))
    later = docs.where("doc_id % 3 <> 0").select(name("s2"), F.lit("s2"), i, "size_bytes", (F.col("modified_ns") + 1), 200 + i % 7, "access_status", F.lit("observed"))
    items = rec.select(F.lit("p-new").alias("plan_id"), "group_id", name("s1").alias("snapshot_id"), "path", "action", F.lit("new").alias("reason"))
    old = rec.where("doc_id % 2 = 0").select(F.lit("p-old").alias("plan_id"), "group_id", name("s1").alias("snapshot_id"), "path", "action", F.lit("old").alias("reason"))
    gone = rec.where("action = 'quarantine'")
    state = F.when(F.col("modified_ns") % 4 == 3, "moving").otherwise("verified")
    return {
        "docs": docs, "rec": rec, "sessions": spark.createDataFrame([("s1", "p1"), ("s2", "p2")], "session_id string, project string"),
        "entries": docs.select(i.alias("entry_id"), "path"), "snapshots": snap.union(later), "members": rec.select("group_id", name("s1").alias("snapshot_id"), "path", "doc_id"),
        "plans": spark.createDataFrame([("p-old", "s1", "sealed", 1, 1), ("p-new", "s1", "executing", 2, 3), ("p-draft", "s1", "draft", 9, None), ("p-s2", "s2", "sealed", 4, None)], "plan_id string, session_id string, status string, created_at int, sealed_at int"),
        "items": items.unionByName(old),
        "transactions": gone.select(name("t").alias("transaction_id"), F.lit("p-new").alias("plan_id"), F.lit("s1").alias("session_id"), "group_id", name("s1").alias("snapshot_id"), state.alias("state")),
        "registry": gone.select(
            i.alias("entry"), name("t").alias("transaction_id"), F.split("path", "/")[1].alias("project"), "path", F.concat(F.lit("/q"), "path").alias("destination"), "size_bytes", (F.col("modified_ns") * F.lit(DAY)).alias("at_ns"),
            catalog.retain_until(F.col("modified_ns") * F.lit(DAY), 7).alias("retain_until_ns"), state.alias("state"), F.when(F.col("modified_ns") % 5 == 4, "deleted").otherwise("active").alias("delete_state"),
        ),
    }


def _q(name: str, sql: str):
    """Registers a function of the catalogue's tables."""

    def add(f):
        query(name, f"with {_CAT} {sql}")(lambda spark, sf_dir: f(tables(spark, sf_dir)))
        return f

    return add


_EVIDENCE = "evid as (select concat('s1-', doc_id) as snapshot_id, 'quick' as stage, md5(text) as digest, doc_id % 29 <> 0 as stable, doc_id from named union all select concat('s1-', doc_id), 'sha256', sha256, true, doc_id from named)"


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = I.of_documents(spark, sf_dir)
    name = F.concat(F.lit("s1-"), F.col("doc_id").cast("string")).alias("snapshot_id")
    quick = d.select(name, F.lit("quick").alias("stage"), F.md5("content").alias("digest"), (F.col("doc_id") % 29 != 0).alias("stable"), "doc_id")
    return written(quick.unionByName(d.select(name, F.lit("sha256").alias("stage"), F.col("sha256").alias("digest"), F.lit(True).alias("stable"), "doc_id")))


# ------------------------------------------------------------------------------ joins


@_q("snapshot_entries", "select snapshot_id, session_id, entry_id, path from snap join ent using (entry_id)")
def _(t):
    return catalog.snapshot_entries(t["snapshots"], t["entries"]).select("snapshot_id", "session_id", "entry_id", "path")


@_q("member_rows", "select group_id, snapshot_id, entry_id, ent.path, size_bytes from cmem join snap using (snapshot_id) join ent using (entry_id)")
def _(t):
    return catalog.member_rows(t["members"].drop("path"), t["snapshots"], t["entries"]).select("group_id", "snapshot_id", "entry_id", "path", "size_bytes")


@query("member_evidence", f"with {_CAT}, {_EVIDENCE} select group_id, snapshot_id, a.digest as quick, b.digest as sha256, a.stable and b.stable as verified from cmem join evid a using (snapshot_id) join evid b using (snapshot_id) where a.stage = 'quick' and b.stage = 'sha256'")
def _(spark, sf_dir):
    m = tables(spark, sf_dir)["members"].select("group_id", "snapshot_id")
    return catalog.with_evidence(m, _evidence(spark, sf_dir), ("quick", "sha256")).select("group_id", "snapshot_id", "quick", "sha256", "verified")


@query("missing_evidence", f"with {_CAT} select group_id, snapshot_id, 'quick' as stage from cmem where doc_id % 5 = 0")
def _(spark, sf_dir):
    m = tables(spark, sf_dir)["members"].select("group_id", "snapshot_id")
    return catalog.missing_evidence(m, _evidence(spark, sf_dir).where("not (stage = 'quick' and doc_id % 5 = 0)"), ("quick", "sha256"))


_SPELLED = "sp as (select doc_id as entry_id, path, true as first from named union all select doc_id + 1000000, upper(path), false from named where doc_id % 4 = 1)"


def _spelled(d: DataFrame) -> DataFrame:
    more = d.where("doc_id % 4 = 1").select((F.col("doc_id") + 1_000_000).alias("entry_id"), F.upper("path").alias("path"))
    return catalog.keyed_entries(d.select(F.col("doc_id").alias("entry_id"), "path").unionByName(more), ascii_only=True)


@query("keyed_entries", f"with {_INV}, {_SPELLED} select entry_id, path, case when first then sha256(lower(path)) else sha256(concat('spelling-v1', chr(0), path)) end as entry_key from sp")
def _(spark, sf_dir):
    return _spelled(I.of_documents(spark, sf_dir).select("doc_id", "path")).select("entry_id", "path", "entry_key")


@query("resolved_paths", f"with {_INV}, {_SPELLED}, asked as (select doc_id, case when doc_id % 2 = 0 then path else upper(path) end as path from named) select doc_id, asked.path, cast(entry_id as varchar) as entry_id from asked left join sp on sp.path = asked.path")
def _(spark, sf_dir):
    d = I.of_documents(spark, sf_dir).select("doc_id", "path")
    asked = d.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("path")).otherwise(F.upper("path")).alias("path"))
    return catalog.resolved(asked, written(_spelled(d)), ascii_only=True).select("doc_id", "path", F.col("entry_id").cast("string").alias("entry_id"))


@_q("observed_entries", "select path, min(session_id) as first_session, max(session_id) as last_session from snap join ent using (entry_id) group by path")
def _(t):
    seen = catalog.snapshot_entries(t["snapshots"], t["entries"])
    first = catalog.observed(seen.limit(0).select("path", F.col("session_id").alias("first_session"), F.col("session_id").alias("last_session")), seen.where("session_id = 's1'"))
    return catalog.observed(first, seen.where("session_id = 's2'"))


@_q("plan_item_rows", "select plan_id, group_id, snapshot_id, ent.path, size_bytes, action from items join snap using (snapshot_id) join ent using (entry_id)")
def _(t):
    return catalog.plan_item_rows(t["items"].drop("path"), t["snapshots"], t["entries"]).select("plan_id", "group_id", "snapshot_id", "path", "size_bytes", "action")


@_q("proven_items", "select plan_id, items.group_id, items.path, items.action from items join rec r on r.group_id = items.group_id and r.path = items.path where r.doc_id % 3 <> 0")
def _(t):
    return catalog.proven_items(t["items"], t["members"].where("doc_id % 3 <> 0").select("group_id", "path")).select("plan_id", "group_id", "path", "action")


@_q("unproven_items", "select plan_id, items.group_id, items.path from items join rec r on r.group_id = items.group_id and r.path = items.path where r.doc_id % 3 = 0")
def _(t):
    return catalog.unproven_items(t["items"], t["members"].where("doc_id % 3 <> 0")).select("plan_id", "group_id", "path")


@_q("plan_projects", "select plan_id, session_id, project, status from plans join sess using (session_id)")
def _(t):
    return catalog.plan_projects(t["plans"], t["sessions"]).select("plan_id", "session_id", "project", "status")


@_q("newest_sealed_plan", "select plan_id, session_id from plans where status <> 'draft' order by coalesce(sealed_at, created_at) desc, plan_id desc limit 1")
def _(t):
    return catalog.newest_plan(t["plans"]).select("plan_id", "session_id")


@_q("newest_plan_of_session", "select plan_id, status from plans where session_id = 's1' order by coalesce(sealed_at, created_at) desc, plan_id desc limit 1")
def _(t):
    return catalog.newest_plan(t["plans"], False, "s1").select("plan_id", "status")


@_q("usable_items", "select plan_id, group_id, path from items where plan_id in (select plan_id from plans where status in ('sealed', 'executing') and plan_id <> 'p-old')")
def _(t):
    plans = t["plans"].withColumn("status", F.when(F.col("plan_id") == "p-old", "completed").otherwise(F.col("status")))
    return catalog.usable_items(t["items"], plans).select("plan_id", "group_id", "path")


# ------------------------------------------------------------------------------ history

_FULL = """, newest as (select session_id, plan_id, status from (select *, row_number() over (partition by session_id order by coalesce(sealed_at, created_at) desc, plan_id desc) as k from plans where status <> 'draft') where k = 1),
full_rows as (select snapshot_id, s.session_id, e.path, s.size_bytes, s.modified_ns, s.observed_at, s.access_status, s.state, m.group_id, i.action, i.reason, n.plan_id, n.status as plan_status, x.state as transaction_state, cast(r.entry as varchar) as entry, r.destination,
  case when r.entry is null then null when r.delete_state <> 'active' then r.delete_state else x.state end as effective_state
from snap s join ent e using (entry_id) left join cmem m using (snapshot_id) left join newest n on n.session_id = s.session_id left join items i on i.plan_id = n.plan_id and i.snapshot_id = s.snapshot_id
  left join tx x on x.plan_id = n.plan_id and x.snapshot_id = s.snapshot_id left join reg r on r.transaction_id = x.transaction_id)"""


def _rest(t: dict[str, DataFrame]) -> tuple[DataFrame, ...]:
    return t["items"], t["plans"], t["transactions"], t["registry"]


@query("history_full", f"with {_CAT}{_FULL} select * from full_rows")
def _(spark, sf_dir):
    t = tables(spark, sf_dir)
    return catalog.history(t["snapshots"], t["entries"], t["members"], *_rest(t)).withColumn("entry", F.col("entry").cast("string"))


@query("history_full_duplicates", f"with {_CAT}{_FULL} select * from full_rows where group_id is not null")
def _(spark, sf_dir):
    t = tables(spark, sf_dir)
    return catalog.history_duplicates(t["snapshots"], t["entries"], t["members"], *_rest(t)).withColumn("entry", F.col("entry").cast("string"))


@query("history_full_page", f"with {_CAT}{_FULL} select snapshot_id, path, group_id, action, effective_state from full_rows order by observed_at desc, path, snapshot_id limit 50 offset 50")
def _(spark, sf_dir):
    t = tables(spark, sf_dir)
    return catalog.history_page(t["snapshots"], t["entries"], t["members"], *_rest(t), number=1).select("snapshot_id", "path", "group_id", "action", "effective_state")


@_q("history_counts", "select (select count(*) from snap) as all_rows, (select count(*) from snap where snapshot_id in (select snapshot_id from cmem)) as duplicate_rows")
def _(t):
    return catalog.history_counts(t["snapshots"], t["members"])


@_q("problem_snapshots", "select snapshot_id, access_status, state from snap where state = 'error' or access_status in ('denied', 'offline', 'missing', 'error')")
def _(t):
    return catalog.problems(t["snapshots"]).select("snapshot_id", "access_status", "state")


# ------------------------------------------------------------------------------ restoring and deleting


@_q("restore_of_session", "select entry, path, destination from live where transaction_id in (select transaction_id from tx where session_id = 's1')")
def _(t):
    return catalog.scope_session(t["registry"], t["transactions"], "s1").select("entry", "path", "destination")


@_q("restore_of_group", "select entry, path from live where transaction_id in (select transaction_id from tx where group_id = (select max(r.group_id) from rec r join live on live.path = r.path))")
def _(t):
    live = catalog.restorable(t["registry"])
    group = t["rec"].join(live.select("path"), "path", "left_semi").agg(F.max("group_id")).first()[0]
    return catalog.scope_group(t["registry"], t["transactions"], t["items"], group or "").select("entry", "path")


@_q("restore_of_project", "select entry, path from live where project = (select max(project) from live)")
def _(t):
    project = catalog.restorable(t["registry"]).agg(F.max("project")).first()[0]
    return catalog.scope_project(t["registry"], project or "").select("entry", "path")


@_q("missing_entries", "select doc_id as entry from named where doc_id % 10 = 0 and doc_id not in (select entry from live)")
def _(t):
    return catalog.missing_ids(t["docs"].where("doc_id % 10 = 0").select(F.col("doc_id").alias("entry")), t["registry"])


@_q("registry_view", f"select entry, path, case when delete_state = 'active' then state else delete_state end as effective_state from reg where contains(lower(path), 'src') and (case when delete_state = 'active' then state else delete_state end) = 'verified' and at_ns >= {5 * DAY}")
def _(t):
    return catalog.registry_view(t["registry"], " SRC ", "verified", 5 * DAY).select("entry", "path", "effective_state")


# ------------------------------------------------------------------------------ orders


@_q("registry_order", "select entry, row_number() over (order by at_ns desc, entry) - 1 as ordinal from reg")
def _(t):
    return catalog.numbered(t["registry"].select("entry", "at_ns"), "-at_ns", "entry").select("entry", "ordinal")


@_q("recovery_order", "select transaction_id, row_number() over (order by state, transaction_id) - 1 as ordinal from tx where state = 'moving'")
def _(t):
    return catalog.numbered(ledger.pending(t["transactions"]).select("transaction_id", "state"), "state", "transaction_id").select("transaction_id", "ordinal")


@query("candidates_order", f"with {_INV} select path, row_number() over (order by size_bytes, path) - 1 as ordinal from el where size_bytes in (select size_bytes from el group by 1 having count(*) >= 2)")
def _(spark, sf_dir):
    c = detect.candidates(I.of_documents(spark, sf_dir).drop("content", "sha256"), detect.CONTENT).select("size_bytes", "path")
    return catalog.numbered(c, "size_bytes", "path").select("path", "ordinal")


@_q("item_ordinals", "select plan_id, snapshot_id, row_number() over (partition by plan_id order by group_id, path) - 1 as ordinal from items")
def _(t):
    return catalog.numbered(t["items"], "group_id", "path", by="plan_id").select("plan_id", "snapshot_id", "ordinal")


@query("groups_order", f"with {_MEM}, g as (select group_id, size_bytes, string_agg(path, chr(10) order by lower(path), path) as paths from mem group by all) select group_id, paths, row_number() over (order by size_bytes desc, group_id) - 1 as ordinal from g")
def _(spark, sf_dir):
    g = catalog.ordered_groups(detect.members(I.of_documents(spark, sf_dir), detect.CONTENT)).select("group_id", "size_bytes", F.array_join("members", "\n").alias("paths"))
    return catalog.numbered(g, "-size_bytes", "group_id").select("group_id", "paths", "ordinal")


@query("groups_second_page", f"with {_MEM} select group_id, size_bytes from mem group by all order by size_bytes desc, group_id limit 20 offset 20")
def _(spark, sf_dir):
    return catalog.groups_page(detect.groups(I.of_documents(spark, sf_dir), detect.CONTENT), 1, 20).select("group_id", "size_bytes")


@query("roots_order", "select root, row_number() over (order by is_primary desc, root) - 1 as ordinal from (select concat('/', source) as root, max(source) = 'src1' as is_primary from documents group by source)")
def _(spark, sf_dir):
    r = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat(F.lit("/"), "source").alias("root"), (F.col("source") == "src1").alias("is_primary")).distinct()
    return catalog.numbered(r, "-is_primary", "root").select("root", "ordinal")


@query("first_files", f"with {_INV} select doc_id, path from named order by path limit 100")
def _(spark, sf_dir):
    return catalog.first_rows(I.of_documents(spark, sf_dir).select("doc_id", "path"), "path", 100)


@query("input_order", f"with {_INV} select doc_id, sha256, row_number() over (order by doc_id) - 1 as ordinal from named")
def _(spark, sf_dir):
    d = I.of_documents(spark, sf_dir)
    hashed = d.repartition(7, "path").select("doc_id", F.sha2("content", 256).alias("sha256"))  # hashed in any order
    return catalog.numbered(hashed, "doc_id").select("doc_id", "sha256", "ordinal")


# ------------------------------------------------------------------------------ detection with two digests, volumes, reports


def _twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inventory with both digests; a content that changed while it was read is unstable."""
    d = I.of_documents(spark, sf_dir)
    return d.withColumn("blake3", F.lower(F.hex(blake3(F.col("content"))))).withColumn("stable", F.col("doc_id") % 29 != 0)


_STABLE_MEM = _MEM.replace("el as (select * from named where access_status", "el as (select * from named where doc_id % 29 <> 0 and access_status")


@query("double_proof_groups", f"with {_STABLE_MEM} select size_bytes, sha256, count(*) as files from mem group by all")
def _(spark, sf_dir):
    return detect.double_proof_groups(_twice(spark, sf_dir), detect.CONTENT).select("size_bytes", "sha256", "files")


@query("report_verified", f"with {_STABLE_MEM} select group_id, path, sha256, true as verified from mem union all select 'unstable', path, sha256, false from named where doc_id % 29 = 0")
def _(spark, sf_dir):
    d = written(_twice(spark, sf_dir).drop("content"))
    own = detect.members(d.where("stable"), detect.CONTENT).select("group_id", "path", "size_bytes", "sha256", "blake3", F.lit(True).alias("stable"))
    bad = d.where("not stable").select(F.lit("unstable").alias("group_id"), "path", "size_bytes", "sha256", "blake3", "stable")
    both = own.unionByName(bad).withColumns({"action": F.lit("keep"), "reason": F.lit("")})
    return report.rows(both).select("group_id", "path", "sha256", "verified")


@query("volume_buckets", f"with {_INV} select coalesce(volume_id, '__unknown_volume__') as volume_key, count(*) as files from named group by 1")
def _(spark, sf_dir):
    d = detect.by_volume(I.of_documents(spark, sf_dir).select("path", "volume_id"), 2)
    return d.groupBy("volume_key").agg(F.count(F.lit(1)).alias("files"))


@query("digest_display", f"with {_INV} select doc_id, substring(sha256, 1, 16) as shown from named")
def _(spark, sf_dir):
    return I.of_documents(spark, sf_dir).select("doc_id", maintenance.digest_prefix(F.col("sha256")).alias("shown"))


@query("destinations", f"with {_INV} select doc_id, case when path like '/src1/%' or path like '/src2/%' then concat('/quarantine/s1/x', path) end as destination from named")
def _(spark, sf_dir):
    return I.of_documents(spark, sf_dir).select("doc_id", plan.destination(F.col("path"), "/quarantine", "s1", F.lit("x"), ("/src1", "/src2")).alias("destination"))


# ------------------------------------------------------------------------------ upkeep

_NOW = 30 * DAY
_LOGS = f"logs as (select doc_id, size_bytes, modified_ns * {2 * DAY} as modified_ns from named)"


def _logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.of_documents(spark, sf_dir).select("doc_id", "size_bytes", (F.col("modified_ns") * F.lit(2 * DAY)).alias("modified_ns"))


@query("log_cutoff", f"with {_INV}, {_LOGS} select doc_id from logs where modified_ns < {_NOW - 14 * DAY}")
def _(spark, sf_dir):
    return maintenance.expired(_logs(spark, sf_dir), _NOW, 14).select("doc_id")


@query("log_cleanup_totals", f"with {_INV}, {_LOGS}, k as (select *, modified_ns < {_NOW - 14 * DAY} as gone from logs) select count(*) filter (gone) as removed_files, cast(coalesce(sum(size_bytes) filter (gone), 0) as bigint) as removed_bytes, count(*) filter (not gone) as kept_files, cast(coalesce(sum(size_bytes) filter (not gone), 0) as bigint) as kept_bytes from k")
def _(spark, sf_dir):
    return maintenance.cleanup_totals(_logs(spark, sf_dir), _NOW, 14)


@query("schema_version", "select cast(coalesce(max(n_nationkey), 0) as bigint) as version from nation")
def _(spark, sf_dir):
    return maintenance.schema_version(spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("version")))


@query("benchmark_totals", f"with {_INV} select count(*) as files, cast(sum(size_bytes) as bigint) as bytes, sum(size_bytes) / 1048576.0 / 2.0 as mib_per_second from named")
def _(spark, sf_dir):
    return maintenance.benchmark_totals(I.of_documents(spark, sf_dir), 2.0)


_PARTS = "part_rows as (select cast(p_partkey as varchar) as id, cast(p_size as bigint) as size_bytes, cast(p_partkey % 40 as bigint) as received_bytes, p_partkey % 3 > 0 as required from part)"


@query("download_progress", f"with {_PARTS}, s as (select cast(sum(size_bytes) as bigint) as required_bytes, cast(sum(least(received_bytes, size_bytes)) as bigint) as received_bytes from part_rows where required) select required_bytes, received_bytes, received_bytes * 10000 // required_bytes as basis_points from s")
def _(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return maintenance.download_progress(p.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_size").cast("long").alias("size_bytes"), (F.col("p_partkey") % 40).alias("received_bytes"), (F.col("p_partkey") % 3 > 0).alias("required")))


def _manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest for each source: a component for each of its documents, some of them not usable."""
    d = I.of_documents(spark, sf_dir)
    i = F.col("doc_id")
    c = F.struct(
        F.when(i % 31 == 0, "").otherwise(i.cast("string")).alias("id"), F.when(i % 7 == 0, F.concat(F.lit("../"), i.cast("string"))).otherwise(F.concat(F.lit("f"), i.cast("string"), F.lit(".bin"))).alias("file"),
        F.when(i % 11 == 0, F.lit(0)).otherwise(F.col("size_bytes")).alias("size_bytes"), F.when(i % 13 == 0, F.lit("beef")).otherwise(F.col("sha256")).alias("sha256"), F.lit(True).alias("required"),
    )
    return d.select("source", c.alias("c")).groupBy("source").agg(F.to_json(F.struct(F.lit(1).alias("version"), F.collect_list("c").alias("components"))).alias("manifest"))


_COMP = "comp as (select case when doc_id % 31 = 0 then '' else cast(doc_id as varchar) end as id, doc_id, case when doc_id % 11 = 0 then 0 else size_bytes end as size_bytes, sha256 from named)"
_BAD = """select id, 'no id' as violation from comp where id = '' union all select id, 'no plain file name' from comp where doc_id % 7 = 0 union all select id, 'no size' from comp where size_bytes <= 0
union all select id, 'no digest' from comp where doc_id % 13 = 0 union all select id, 'id not unique' from comp group by id having count(*) > 1"""


@query("manifest_violations", f"with {_INV}, {_COMP} {_BAD}")
def _(spark, sf_dir):
    return maintenance.manifest_violations(written(maintenance.parsed_manifest(_manifests(spark, sf_dir))))


@query("manifest_components", f"with {_INV}, {_COMP} select id, size_bytes from comp")
def _(spark, sf_dir):
    return maintenance.parsed_manifest(_manifests(spark, sf_dir)).select("id", "size_bytes")


@query("preflight_classes", f"with {_INV} select cast(doc_id as varchar) as id, case when doc_id % 5 = 0 then 'installed' when doc_id % 5 = 1 then 'cached' when doc_id % 5 = 2 and size_bytes > 1 then 'partial' else 'missing' end as class, cast(case when doc_id % 5 = 1 then size_bytes when doc_id % 5 = 2 and size_bytes > 1 then 1 else 0 end as bigint) as cached_bytes from named")
def _(spark, sf_dir):
    d = written(I.of_documents(spark, sf_dir).select("doc_id", F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("file"), "size_bytes", "sha256"))
    whole = d.where("doc_id % 5 = 1").select("file", "size_bytes", F.upper("sha256").alias("sha256"))
    part = d.where("doc_id % 5 = 2").select("file", F.lit(1).cast("long").alias("size_bytes"), F.lit(None).cast("string").alias("sha256"))
    wrong = d.where("doc_id % 5 = 3").select("file", "size_bytes", F.lit("beef").alias("sha256"))
    return maintenance.preflight(d, d.where("doc_id % 5 = 0").select("id"), whole.unionByName(part).unionByName(wrong))


@query("http_ranges", "select doc_id, coalesce(case when doc_id % 3 = 0 and n_chars > 1 then 0 end, -1)::bigint as first, coalesce(case when doc_id % 3 = 0 and n_chars > 1 then n_chars - 1 end, -1) as last, coalesce(case when doc_id % 3 = 0 and n_chars > 1 then n_chars end, -1) as total from documents")
def _(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n = F.col("n_chars")
    header = F.when((F.col("doc_id") % 3 == 0) & (n > 1), F.format_string("bytes 0-%d/%d", n - 1, n)).when(F.col("doc_id") % 3 == 1, F.format_string("bytes 0-%d/%d", n + 5, n)).otherwise("items 0-1/2")
    return d.select("doc_id", maintenance.http_range(header).alias("r")).select("doc_id", *[F.coalesce(f"r.{k}", F.lit(-1)).cast("long").alias(k) for k in ("first", "last", "total")])


@query("foreign_keys", "select 'o_custkey has no c_custkey' as violation, count(*) as n from orders where o_custkey not in (select c_custkey from customer where c_custkey % 2 = 0) having count(*) > 0")
def _(spark, sf_dir):
    o, c = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer"))
    return catalog.foreign_key_violations(o, "o_custkey", c.where("c_custkey % 2 = 0"), "c_custkey")


@query("path_keys_fold_case", f"with {_INV} select doc_id, sha256(lower(path)) as path_key from named")
def _(spark, sf_dir):
    return I.of_documents(spark, sf_dir).select("doc_id", T.path_key(F.upper("path"), True).alias("path_key"))


@query("rfc3339_times", f"with {_INV} select doc_id, strftime(make_timestamp((modified_ns - 9) * 86400000000 + doc_id), '%Y-%m-%dT%H:%M:%S.%fZ') as shown, ((modified_ns - 9) * 86400000000 + doc_id) * 1000 as back from named")
def _(spark, sf_dir):
    at = ((F.col("modified_ns") - 9) * F.lit(86_400_000_000) + F.col("doc_id")) * 1000
    d = I.of_documents(spark, sf_dir).select("doc_id", T.rfc3339(at).alias("shown"))
    return d.withColumn("back", T.from_rfc3339(F.col("shown")))
