"""Queries and their SQL by name."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echofold.functions import text as T
from echofold.functions.blake3 import blake3
from echofold.functions.shared import folder
from echofold.operators import detect, filters, history, keep, ledger, plan, progress, report
from echofold.sources import files
from echofold.sources import inventory as I
from echofold.sources.synthetic import synthetic
from echofold.streaming import incremental

PRIMARY = ("/src1",)
FILTER = filters.FilterConfig(include=("pdf",), globs=("**/cache/**",), minimum=100)
ROOTS = ["/src1", "/src1/d15", "/src10", "/src1", "/src2/", "/src2/cache", "/.echofold-quarantine/x", "/src3/cache/d69"]
NOW_NS, RETENTION_DAYS = 22 * 86_400 * 10**9, 7

Query = Callable[[SparkSession, str], DataFrame]
_found: dict[str, Query] = {}
_sql: dict[str, str] = {}

#: the inventory of documents, and what detection makes of it
_INV = """
inv as (
  select doc_id, source,
    concat('/', source, '/', case when doc_id % 23 = 0 then 'cache/' else '' end, 'd', cast(doc_id as varchar), '/',
      case when doc_id % 19 = 0 then '.' else '' end,
      case when doc_id % 7 = 0 then upper(concat(lang, '_', cast(n_chars as varchar)))
           when doc_id % 11 = 0 then concat('renamed_', cast(doc_id as varchar))
           else concat(lang, '_', cast(n_chars as varchar)) end,
      case doc_id % 4 when 0 then '.pdf' when 1 then '.pdf' when 2 then '.PDF' else '.txt' end) as path,
    cast(strlen(text) as bigint) as size_bytes, (doc_id * 37) % 19 as modified_ns,
    case when doc_id % 17 = 0 then null else concat('vol', cast(doc_id % 2 as varchar)) end as volume_id,
    case when doc_id % 17 = 0 then null else cast(doc_id % 10 as varchar) end as file_id,
    case when doc_id % 13 = 0 then 2 else 1 end as hardlink_count,
    case when doc_id % 41 = 0 then 'denied' else 'readable' end as access_status,
    sha256(text) as sha256, text
  from documents),
named as (select *, regexp_extract(path, '[^/]*$') as leaf, lower(regexp_extract(path, '[^/]*$')) as name,
    case when regexp_matches(regexp_extract(path, '[^/]*$'), '^.+\\.[^.]*$') then lower(regexp_extract(regexp_extract(path, '[^/]*$'), '^.+\\.([^.]*)$', 1)) end as extension
  from inv),
el as (select * from named where access_status = 'readable' and hardlink_count = 1)"""


def _members_sql(mode: str) -> str:
    name, key = ("name", "size_bytes, name, sha256") if mode == detect.STRICT else ("''", "size_bytes, sha256")
    return f"""{_INV},
once as (select * from (select *, row_number() over (partition by {key}, volume_id, file_id order by path) as k from el) where k = 1 or volume_id is null),
mem as (select * from (select *, count(*) over (partition by {key}) as group_size, sha256(concat_ws('|', '{mode}', cast(size_bytes as varchar), {name}, sha256)) as group_id from once) where group_size >= 2)"""


_MEM = _members_sql(detect.CONTENT)
_PRIMARY_SQL = "case when path = '/src1' or starts_with(path, '/src1/') then 0 else 1 end"
_ORDERS = {
    keep.DEFAULT: f"{_PRIMARY_SQL}, modified_ns, strlen(path), path",
    keep.OLDEST: "modified_ns, strlen(path), path",
    keep.NEWEST: "modified_ns desc, strlen(path), path",
    keep.SHORTEST: "strlen(path), path",
}
_REC = f"""{_MEM},
rec as (select *, case when row_number() over (partition by group_id order by {_ORDERS[keep.DEFAULT]}) = 1 then 'keep' else 'quarantine' end as action from mem)"""
_LEDGER = """ev as (select user_id as entity, event_id as sequence, case event_type when 'signup' then 'planned' when 'view' then 'preflight_validated'
  when 'click' then 'moving' when 'purchase' then 'verified' when 'error' then 'recovery_required' end as state, value as amount, ts as at from events)"""
_STEPS_SQL = ", ".join(f"('{a}', '{b}')" for a, b in sorted(ledger.TRANSITIONS))


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        _found[name] = f
        if sql:
            _sql[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_found)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def _recommended(spark: SparkSession, sf_dir: str, policy: str = keep.DEFAULT) -> DataFrame:
    return keep.recommend(detect.members(I.of_documents(spark, sf_dir), detect.CONTENT), policy, PRIMARY)


def _roots(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(ROOTS)), "ordinal long, root string")


# ------------------------------------------------------------------------------ inventory and filters


@query("inventory", f"with {_INV} select doc_id, path, name, extension, size_bytes, modified_ns, volume_id, file_id, hardlink_count, access_status, sha256 from named")
def _(spark, sf_dir):
    c = ["doc_id", "path", "size_bytes", "modified_ns", "volume_id", "file_id", "hardlink_count", "access_status", "sha256"]
    return I.of_documents(spark, sf_dir).select(*c, T.normalized_name(F.col("path"), True).alias("name"), T.extension(F.col("path")).alias("extension"))


@query("normalized_paths", f"with {_INV} select doc_id, lower(path) as normalized, sha256(lower(path)) as path_key, sha256(concat('spelling-v1', chr(0), path)) as identity_key from named")
def _(spark, sf_dir):
    twisted = F.concat(F.lit("/./x/.."), "path")  # dot segments cancel out
    return I.of_documents(spark, sf_dir).select("doc_id", T.normalized_path(twisted, True).alias("normalized"), T.path_key(twisted, True).alias("path_key"), T.path_identity_key(twisted).alias("identity_key"))


@query(
    "snapshot_tokens",
    f"with {_INV} select doc_id, sha256(concat(case when volume_id is null then '' else concat(volume_id, chr(0), file_id, chr(0)) end, size_bytes, chr(0), modified_ns)) as token from named",
)
def _(spark, sf_dir):
    return I.of_documents(spark, sf_dir).select("doc_id", T.snapshot_token(*map(F.col, ("volume_id", "file_id", "size_bytes", "modified_ns"))).alias("token"))


for _name, _config, _where in (
    ("filter_extension", filters.FilterConfig(include=(".PDF",), skip_hidden=False), "extension = 'pdf'"),
    ("filter_exclude", filters.FilterConfig(include=(), exclude=("txt",), skip_hidden=False), "extension <> 'txt'"),
    ("filter_min_size", filters.FilterConfig(include=(), minimum=100, skip_hidden=False), "size_bytes >= 100"),
    ("filter_hidden", filters.FilterConfig(include=()), "leaf not like '.%'"),
    ("filter_glob", filters.FilterConfig(include=(), globs=("**/cache/**",), skip_hidden=False), "path not like '%/cache/%'"),
    ("filter_all_rules", FILTER, "extension = 'pdf' and size_bytes >= 100 and leaf not like '.%' and path not like '%/cache/%'"),
):
    query(_name, f"with {_INV} select doc_id, path, size_bytes from named where {_where}")(lambda spark, sf_dir, c=_config: filters.apply(I.of_documents(spark, sf_dir), c).select("doc_id", "path", "size_bytes"))


_ROOTS_SQL = "r as (select * from (values " + ", ".join(f"({i}, '{r}')" for i, r in enumerate(ROOTS)) + ") t(ordinal, root))"
_WITHIN = "(x.root = rtrim(y.root, '/') or starts_with(x.root, rtrim(y.root, '/') || '/'))"


@query(
    "root_validation",
    f"""with {_ROOTS_SQL}, k as (select *, row_number() over (partition by root order by ordinal) as k, root like '/.echofold-quarantine/%' as bad from r),
tops as (select distinct root from k where not bad and k = 1),
j as (select x.ordinal, x.root, x.k, x.bad, min(struct_pack(n := length(y.root), t := y.root)) as c from k x left join tops y on {_WITHIN} and x.root <> y.root group by all)
select cast(ordinal as bigint) as ordinal, root, case when bad then 'forbidden' when k > 1 then 'duplicate' when c.t is not null then 'covered' else 'valid' end as status,
  case when not bad and k = 1 then c.t end as covered_by from j""",
)
def _(spark, sf_dir):
    return filters.validate_roots(_roots(spark))


@query("root_overlap_pairs", f"with {_ROOTS_SQL} select distinct y.root as \"outer\", x.root as \"inner\" from r x join r y on {_WITHIN} and x.root <> y.root")
def _(spark, sf_dir):
    return filters.overlapping_roots(_roots(spark))


@query(
    "longest_prefix_root",
    f"with {_INV}, {_ROOTS_SQL} select doc_id, path, max_by(rtrim(root, '/'), length(rtrim(root, '/'))) as root from named left join r on path = rtrim(root, '/') or starts_with(path, rtrim(root, '/') || '/') group by 1, 2",
)
def _(spark, sf_dir):
    return filters.owning_root(I.of_documents(spark, sf_dir).select("doc_id", "path"), _roots(spark)).select("doc_id", "path", "root")


# ------------------------------------------------------------------------------ detection


@query("candidates_strict", f"with {_INV} select size_bytes, name, count(*) as files from el group by all having count(*) >= 2")
def _(spark, sf_dir):
    return detect.candidate_groups(I.of_documents(spark, sf_dir), detect.STRICT)


@query("candidates_content", f"with {_INV} select size_bytes, count(*) as files from el group by all having count(*) >= 2")
def _(spark, sf_dir):
    return detect.candidate_groups(I.of_documents(spark, sf_dir), detect.CONTENT)


_QUICK = """sha256(case when strlen(text) <= 65536 then encode(cast(strlen(text) as varchar) || '|' || text)
  else encode(cast(strlen(text) as varchar) || '|0:') || encode(text)[1:65536]
    || encode(cast(strlen(text) // 2 - 32768 as varchar) || ':') || encode(text)[strlen(text) // 2 - 32767:strlen(text) // 2 + 32768]
    || encode(cast(strlen(text) - 65536 as varchar) || ':') || encode(text)[strlen(text) - 65535:strlen(text)] end)"""


@query("quick_signature", f"select doc_id, {_QUICK} as signature, case when strlen(text) <= 65536 then strlen(text) else least(strlen(text), 196608) end as sampled from documents")
def _(spark, sf_dir):
    t = I.of_documents(spark, sf_dir)
    return t.select("doc_id", detect.quick_signature(F.col("content"), F.col("size_bytes")).alias("signature"), detect.sampled_bytes(F.col("size_bytes")).alias("sampled"))


@query(
    "quick_rejects",
    f"with {_INV}, q as (select *, {_QUICK} as quick, count(*) over (partition by size_bytes) as n from el) select doc_id, path from (select *, count(*) over (partition by size_bytes, quick) as m from q where n >= 2) where m = 1",
)
def _(spark, sf_dir):
    c = detect.candidates(I.of_documents(spark, sf_dir), detect.CONTENT).withColumn("quick", detect.quick_signature(F.col("content"), F.col("size_bytes")))
    alone = c.groupBy("size_bytes", "quick").count().where("count = 1").drop("count")
    return c.join(alone, ["size_bytes", "quick"], "left_semi").select("doc_id", "path")


for _mode in (detect.STRICT, detect.CONTENT):
    _by = "group_id, size_bytes, name, sha256" if _mode == detect.STRICT else "group_id, size_bytes, sha256"
    query(f"groups_{_mode}", f"with {_members_sql(_mode)} select {_by}, count(*) as files, cast(size_bytes * (count(*) - 1) as bigint) as reclaimable_bytes from mem group by {_by}")(
        lambda spark, sf_dir, m=_mode: detect.groups(I.of_documents(spark, sf_dir), m)
    )
    query(f"members_{_mode}", f"with {_members_sql(_mode)} select group_id, doc_id, path, size_bytes, group_size from mem")(
        lambda spark, sf_dir, m=_mode: detect.members(I.of_documents(spark, sf_dir), m).select("group_id", "doc_id", "path", "size_bytes", "group_size")
    )


@query("members_cascade", f"with {_MEM} select group_id, doc_id, path from mem")
def _(spark, sf_dir):
    return detect.members(I.of_documents(spark, sf_dir), detect.CONTENT, cascade=True).select("group_id", "doc_id", "path")


@query("identity_distinct", f"with {_MEM} select doc_id, path, volume_id, file_id from once")
def _(spark, sf_dir):
    e = detect.eligible(I.of_documents(spark, sf_dir)).select("size_bytes", "sha256", "doc_id", "path", "volume_id", "file_id")
    return detect.one_per_identity(e, ["size_bytes", "sha256"]).select("doc_id", "path", "volume_id", "file_id")


@query("hardlink_excluded", f"with {_INV} select doc_id, path from named where hardlink_count <> 1")
def _(spark, sf_dir):
    return I.of_documents(spark, sf_dir).where("hardlink_count <> 1").select("doc_id", "path")


@query("unreadable_isolated", f"with {_INV} select doc_id, path, 'quick_hash' as stage from named where access_status <> 'readable'")
def _(spark, sf_dir):
    return I.of_documents(spark, sf_dir).where("access_status <> 'readable'").select("doc_id", "path", F.lit("quick_hash").alias("stage"))


@query(
    "detection_telemetry",
    f"""with {_INV}, c as (select * from el where size_bytes in (select size_bytes from el group by 1 having count(*) >= 2))
select (select count(*) from named) as files, (select count(*) from named where access_status <> 'readable') as unreadable, (select count(*) from named where hardlink_count > 1) as linked, cast(0 as bigint) as unstable,
  count(*) as candidates, cast(coalesce(sum(case when size_bytes <= 65536 then size_bytes else least(size_bytes, 196608) end), 0) as bigint) as quick_bytes, cast(coalesce(sum(size_bytes), 0) as bigint) as full_bytes from c""",
)
def _(spark, sf_dir):
    return detect.telemetry(I.of_documents(spark, sf_dir), detect.CONTENT)


@query("reclaimable_by_group", f"with {_MEM} select group_id, cast(size_bytes * (count(*) - 1) as bigint) as reclaimable_bytes from mem group by group_id, size_bytes")
def _(spark, sf_dir):
    return detect.groups(I.of_documents(spark, sf_dir), detect.CONTENT).select("group_id", "reclaimable_bytes")


@query("session_rollup", f"with {_MEM}, g as (select group_id, size_bytes * (count(*) - 1) as b from mem group by group_id, size_bytes) select count(*) as groups, cast(coalesce(sum(b), 0) as bigint) as reclaimable_bytes from g")
def _(spark, sf_dir):
    return detect.groups(I.of_documents(spark, sf_dir), detect.CONTENT).agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("reclaimable_bytes"), F.lit(0)).alias("reclaimable_bytes"))


@query(
    "results_totals",
    f"with {_MEM}, g as (select size_bytes, count(*) as n from mem group by group_id, size_bytes) select count(*) as groups, cast(coalesce(sum(n), 0) as bigint) as files, cast(coalesce(sum(n - 1), 0) as bigint) as removable, cast(coalesce(sum(size_bytes * (n - 1)), 0) as bigint) as reclaimable_bytes from g",
)
def _(spark, sf_dir):
    g, zero = detect.groups(I.of_documents(spark, sf_dir), detect.CONTENT), F.lit(0)
    return g.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("files"), zero).alias("files"), F.coalesce(F.sum(F.col("files") - 1), zero).alias("removable"), F.coalesce(F.sum("reclaimable_bytes"), zero).alias("reclaimable_bytes"))


@query("results_page", f"with {_MEM} select group_id, size_bytes, count(*) as files from mem group by all order by size_bytes desc, group_id limit 40")
def _(spark, sf_dir):
    return detect.groups(I.of_documents(spark, sf_dir), detect.CONTENT).orderBy(F.col("size_bytes").desc(), "group_id").limit(40).select("group_id", "size_bytes", "files")


# ------------------------------------------------------------------------------ keepers and plans

for _policy, _order in _ORDERS.items():
    query(f"keep_{_policy}", f"with {_MEM} select group_id, path, size_bytes, case when row_number() over (partition by group_id order by {_order}) = 1 then 'keep' else 'quarantine' end as action from mem")(
        lambda spark, sf_dir, p=_policy: _recommended(spark, sf_dir, p).select("group_id", "path", "size_bytes", "action")
    )


@query(
    "keep_manual",
    f"with {_MEM}, c as (select group_id, max(path) as chosen, min(source) as least, max(source) as most from mem group by 1) select group_id, path, case when least = most then 'manual' when path = chosen then 'keep' else 'quarantine' end as action from mem join c using (group_id)",
)
def _(spark, sf_dir):
    m = detect.members(I.of_documents(spark, sf_dir), detect.CONTENT)
    own = F.split("path", "/")[1]
    chosen = m.groupBy("group_id").agg(F.max("path").alias("path"), F.min(own).alias("a"), F.max(own).alias("z")).where("a <> z")  # groups within one source await a choice
    return keep.recommend_manual(m, chosen).select("group_id", "path", "action")


@query("plan_items", f"with {_REC} select group_id, path, size_bytes, sha256, action from rec")
def _(spark, sf_dir):
    return _recommended(spark, sf_dir).select("group_id", "path", "size_bytes", "sha256", "action")


@query("plan_summary", f"with {_REC} select count(distinct group_id) as groups, count(*) as files, cast(coalesce(sum(size_bytes), 0) as bigint) as bytes from rec where action = 'quarantine'")
def _(spark, sf_dir):
    return plan.summary(_recommended(spark, sf_dir))


_LOST = f"{_REC}, kept as (select * from rec where not (action = 'keep' and modified_ns < 6)), v as (select group_id, count(*) filter (action = 'keep') as k, count(*) filter (action = 'quarantine') as q from kept group by 1)"


@query("plan_seal_violations", f"with {_LOST} select group_id, case when k <> 1 then 'not one keeper' when q = 0 then 'nothing to remove' end as violation from v where k <> 1 or q = 0")
def _(spark, sf_dir):
    lost = _recommended(spark, sf_dir).where("not (action = 'keep' and modified_ns < 6)")  # a damaged plan
    return plan.seal_violations(lost)


@query(
    "dry_run",
    f"""with {_REC} select q.group_id, q.path, q.size_bytes, k.path as keeper_path, concat_ws('/', '/quarantine', 's1', substring(q.group_id, 1, 16), substring(q.path, 2)) as destination
from rec q join rec k on q.group_id = k.group_id and k.action = 'keep' where q.action = 'quarantine'""",
)
def _(spark, sf_dir):
    return plan.dry_run(_recommended(spark, sf_dir))


@query("plan_freshness", f"with {_REC} select group_id, path, case when doc_id % 3 = 0 then 'missing' else 'modified_ns' end as drift from rec where doc_id % 3 = 0 or modified_ns = 5")
def _(spark, sf_dir):
    now = I.of_documents(spark, sf_dir).where("doc_id % 3 <> 0").withColumn("modified_ns", F.when(F.col("modified_ns") == 5, 99).otherwise(F.col("modified_ns")))  # a later state: some files gone, some touched
    return plan.drift(_recommended(spark, sf_dir), now)


@query("unfinished_items", f"with {_REC} select group_id, path from rec where action = 'quarantine' and modified_ns % 2 = 1")
def _(spark, sf_dir):
    items = _recommended(spark, sf_dir)
    done = items.where("action = 'quarantine'").select("group_id", "path", F.when(F.col("modified_ns") % 2 == 0, "verified").otherwise("moving").alias("state"))
    return plan.unfinished(items, done).select("group_id", "path")


_PLANS = "p as (select o_custkey as session_id, o_orderkey as plan_id, case when o_orderstatus = 'F' then o_orderdate end as sealed_at, o_orderdate as created_at, o_orderstatus as status from orders)"


@query("latest_plan", f"with {_PLANS} select session_id, plan_id, status from (select *, row_number() over (partition by session_id order by coalesce(sealed_at, created_at) desc, plan_id desc) as k from p) where k = 1")
def _(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    plans = o.select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("plan_id"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("sealed_at"), F.col("o_orderdate").alias("created_at"), F.col("o_orderstatus").alias("status"))
    return plan.newest_plans(plans).select("session_id", "plan_id", "status")


# ------------------------------------------------------------------------------ history

_HIST = f"""{_REC}, o as (select a.path as p, a.group_id as g, string_agg(b.path, chr(10) order by b.path) as others from rec a join rec b on a.group_id = b.group_id and a.path <> b.path group by 1, 2),
h as (select named.doc_id, named.path, named.size_bytes, named.modified_ns, named.access_status, named.extension, rec.group_id, rec.action, o.others from named left join rec using (path) left join o on p = path and g = rec.group_id)"""


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = I.of_documents(spark, sf_dir).select("doc_id", "path", "size_bytes", "modified_ns", "access_status", T.extension(F.col("path")).alias("extension"))
    return history.history(t, _recommended(spark, sf_dir))


@query("history_all", f"with {_HIST} select doc_id, path, group_id, action, others from h")
def _(spark, sf_dir):
    return _history(spark, sf_dir).select("doc_id", "path", "group_id", "action", "others")


@query("history_duplicates", f"with {_HIST} select doc_id, path, group_id, action, others from h where group_id is not null")
def _(spark, sf_dir):
    return _history(spark, sf_dir).where("group_id is not null").select("doc_id", "path", "group_id", "action", "others")


@query(
    "history_totals",
    f"with {_HIST} select count(*) as files, count(group_id) as duplicate_files, count(distinct group_id) as groups, count(*) filter (access_status in ('denied', 'offline', 'missing', 'error')) as problems from h",
)
def _(spark, sf_dir):
    return history.totals(_history(spark, sf_dir))


@query("history_search", f"with {_HIST} select doc_id, path, group_id from h where contains(lower(path), 'src1/d') or contains(lower(coalesce(group_id, '')), 'src1/d')")
def _(spark, sf_dir):
    return history.search(_history(spark, sf_dir), "  SRC1/D ").select("doc_id", "path", "group_id")


@query("history_page", f"with {_HIST} select doc_id, path, group_id, modified_ns from h order by modified_ns desc, path limit 50 offset 50")
def _(spark, sf_dir):
    t = I.of_documents(spark, sf_dir).select("doc_id", "path", "modified_ns")
    return history.page_of(t, _recommended(spark, sf_dir), 1, 50).select("doc_id", "path", "group_id", "modified_ns")


@query("problem_files", f"with {_INV} select doc_id, path, access_status from named where access_status in ('denied', 'offline', 'missing', 'error')")
def _(spark, sf_dir):
    return I.of_documents(spark, sf_dir).where(F.col("access_status").isin(*history.PROBLEMS)).select("doc_id", "path", "access_status")


@query("storage_by_class", f"with {_INV} select case extension when 'pdf' then 'document' when 'txt' then 'text' else 'other' end as class, count(*) as files, cast(sum(size_bytes) as bigint) as bytes from named group by 1")
def _(spark, sf_dir):
    return history.storage(I.of_documents(spark, sf_dir).withColumn("extension", T.extension(F.col("path"))))


_DIFF = f"{_MEM}, strict_old as (select distinct sha256 from mem where size_bytes < 600), new as (select distinct sha256 from mem where size_bytes >= 300)"


def _sessions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    m = detect.groups(I.of_documents(spark, sf_dir), detect.CONTENT)
    return m.where("size_bytes < 600"), m.where("size_bytes >= 300")


for _part, _op in (("added", "select sha256 from new except select sha256 from strict_old"), ("removed", "select sha256 from strict_old except select sha256 from new"), ("common", "select sha256 from strict_old intersect select sha256 from new")):
    query(f"session_diff_{_part}", f"with {_DIFF} {_op}")(lambda spark, sf_dir, p=_part: history.session_diff(*_sessions(spark, sf_dir), "sha256")[p])


# ------------------------------------------------------------------------------ ledger and progress


@query("latest_event_state", f"with {_LEDGER} select entity, max_by(state, sequence) as state, max(sequence) as sequence, count(*) as steps from ev group by 1")
def _(spark, sf_dir):
    return ledger.current_state(ledger.of_events(spark, sf_dir))


@query(
    "event_transition_violations",
    f"""with {_LEDGER}, s(a, b) as (values {_STEPS_SQL}), l as (select entity, sequence, lag(state) over (partition by entity order by sequence) as from_state, state as to_state from ev)
select entity, sequence, from_state, to_state from l where (from_state is null and to_state <> 'planned') or (from_state is not null and not exists (select 1 from s where a = from_state and b = to_state))""",
)
def _(spark, sf_dir):
    return ledger.violations(ledger.of_events(spark, sf_dir))


@query("transition_table", f"select * from (values {_STEPS_SQL}) t(from_state, to_state)")
def _(spark, sf_dir):
    return ledger.transitions(spark)


@query("pending_recovery", f"with {_LEDGER}, c as (select entity, max_by(state, sequence) as state, max(sequence) as sequence from ev group by 1) select entity, state, sequence from c where state in ({', '.join(repr(x) for x in ledger.PENDING)})")
def _(spark, sf_dir):
    return ledger.pending(ledger.current_state(ledger.of_events(spark, sf_dir))).select("entity", "state", "sequence")


@query(
    "recovery_matrix",
    f"""with {_LEDGER}, c as (select entity, max_by(state, sequence) as state, max(amount) > 50 as s, min(amount) < 10 as d from ev group by 1),
o as (select *, case when s and d then 'reconciled_both' when s then 'reconciled_source_only' when d then 'destination_verified' else 'reconciled_missing' end as outcome from c)
select entity, state, outcome, case when outcome = 'destination_verified' then case when state in ('moving', 'moved_unverified', 'recovery_required') then 'verified' else state end
  when state in ({', '.join(repr(x) for x in ledger.PENDING)}) then outcome else state end as after_state from o""",
)
def _(spark, sf_dir):
    e = ledger.of_events(spark, sf_dir)
    c = e.groupBy("entity").agg(F.max(F.struct("sequence", "state")).alias("l"), (F.max("amount") > 50).alias("s"), (F.min("amount") < 10).alias("d"))
    c = c.select("entity", F.col("l.state").alias("state"), ledger.recovery(F.col("s"), F.col("d")).alias("outcome"))
    return c.withColumn("after_state", ledger.reconciled_state(F.col("state"), F.col("outcome")))


@query("newest_event_per_session", "select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by event_id desc) as k from events) where k = 1")
def _(spark, sf_dir):
    return progress.newest(spark.read.parquet(f"{sf_dir}/events.parquet"), "user_id", "event_id").select("user_id", "event_id", "event_type")


@query(
    "rolling_rate",
    """select event_id, user_id, cast(count(*) over w as bigint) as window_amount, cast(floor(count(*) over w * 1000 / 86400000) as bigint) as per_second
from (select *, epoch_ms(ts) as ms from events) window w as (partition by user_id order by ms range between 86400000 preceding and current row)""",
)
def _(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), F.lit(1).cast("long").alias("one"))
    return progress.rolling_rate(e, "user_id", "ms", "one", 86_400_000).select("event_id", "user_id", "window_amount", "per_second")


_DONE = "p as (select user_id, count(*) as total, count(*) filter (event_type <> 'error') as done from events group by 1)"


def _progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("event_type") != "error").alias("done"))


@query("eta_progress", f"with {_DONE} select user_id, case when done // 10 > 0 then cast(ceil(greatest(total - done, 0) / (done // 10)) as bigint) end as eta_seconds from p")
def _(spark, sf_dir):
    return _progress(spark, sf_dir).select("user_id", progress.eta_seconds(F.col("total"), F.col("done"), F.floor(F.col("done") / 10)).alias("eta_seconds"))


@query("progress_basis_points", f"with {_DONE} select user_id, least(10000, done * 10000 // total) as basis_points from p")
def _(spark, sf_dir):
    return _progress(spark, sf_dir).select("user_id", progress.basis_points(F.col("done"), F.col("total")).alias("basis_points"))


@query("monotonic_counters", "select event_id, user_id, max(value) over (partition by user_id order by event_id rows unbounded preceding) as max_value from events")
def _(spark, sf_dir):
    return progress.monotonic(spark.read.parquet(f"{sf_dir}/events.parquet"), "user_id", "event_id", ("value",)).select("event_id", "user_id", "max_value")


# ------------------------------------------------------------------------------ quarantine

_Q = f"""{_REC}, q as (select doc_id as entry, source as project, group_id, path, size_bytes, concat_ws('/', '/quarantine', 's1', substring(group_id, 1, 16), substring(path, 2)) as destination,
  modified_ns * 86400000000000 as at_ns, (modified_ns + {RETENTION_DAYS}) * 86400000000000 as retain_until_ns, case when modified_ns % 4 = 3 then 'moving' else 'verified' end as state,
  case when modified_ns % 5 = 4 then 'deleted' else 'active' end as delete_state from rec where action = 'quarantine')"""


def _quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries as if the plan had been carried out, a file's day of modification being the day it was moved."""
    q = _recommended(spark, sf_dir).where("action = 'quarantine'")
    day = F.lit(86_400 * 10**9)
    return q.select(
        F.col("doc_id").alias("entry"), F.split("path", "/")[1].alias("project"), "group_id", "path", "size_bytes",
        plan.destination(F.col("path"), "/quarantine", "s1", F.substring("group_id", 1, 16)).alias("destination"), (F.col("modified_ns") * day).alias("at_ns"), ((F.col("modified_ns") + RETENTION_DAYS) * day).alias("retain_until_ns"),
        F.when(F.col("modified_ns") % 4 == 3, "moving").otherwise("verified").alias("state"), F.when(F.col("modified_ns") % 5 == 4, "deleted").otherwise("active").alias("delete_state"),
    )


@query("quarantine_inventory", f"with {_Q} select entry, project, path, destination, retain_until_ns, case when delete_state = 'active' then state else delete_state end as effective_state from q")
def _(spark, sf_dir):
    return _quarantine(spark, sf_dir).select("entry", "project", "path", "destination", "retain_until_ns", ledger.effective_state(F.col("state"), F.col("delete_state")).alias("effective_state"))


_DELETABLE = f"state = 'verified' and delete_state = 'active' and retain_until_ns <= {NOW_NS}"


@query("delete_eligible", f"with {_Q} select entry, path, size_bytes from q where {_DELETABLE}")
def _(spark, sf_dir):
    return ledger.deletable(_quarantine(spark, sf_dir), NOW_NS).select("entry", "path", "size_bytes")


@query(
    "delete_batch_totals",
    f"""with {_Q} select project, count(*) as items, count(distinct entry) as distinct_items, cast(sum(size_bytes) as bigint) as bytes, cast(sum(cast('0x' || substring(sha256(cast(entry as varchar)), 1, 15) as bigint)) as varchar) as selection,
  'DELETE ' || count(*) || ' FILES ' || sum(size_bytes) || ' BYTES' as phrase from q where {_DELETABLE} group by 1""",
)
def _(spark, sf_dir):
    return ledger.batch_totals(ledger.deletable(_quarantine(spark, sf_dir), NOW_NS))


@query(
    "delete_outcome",
    f"""with {_Q} select project, count(*) filter (delete_state = 'deleted') as deleted, cast(coalesce(sum(size_bytes) filter (delete_state = 'deleted'), 0) as bigint) as deleted_bytes,
  count(*) filter (delete_state <> 'deleted') as remaining, count(*) filter (delete_state <> 'deleted') = 0 as complete from q group by 1""",
)
def _(spark, sf_dir):
    return ledger.outcome(_quarantine(spark, sf_dir).withColumnRenamed("delete_state", "item_state"))


@query("restore_scope_session", f"with {_Q} select entry, path, destination from q where state = 'verified' and delete_state = 'active' and project in ('src2', 'src3', 'src4', 'src5', 'src6', 'src7')")
def _(spark, sf_dir):
    return _quarantine(spark, sf_dir).where("state = 'verified' and delete_state = 'active' and project in ('src2', 'src3', 'src4', 'src5', 'src6', 'src7')").select("entry", "path", "destination")


@query("restore_scope_group", f"with {_Q}, b as (select group_id from rec group by 1 having count(*) >= 3) select entry, group_id, path from q where state = 'verified' and delete_state = 'active' and group_id in (select group_id from b)")
def _(spark, sf_dir):
    asked = _recommended(spark, sf_dir).groupBy("group_id").count().where("count >= 3").select("group_id")
    return _quarantine(spark, sf_dir).where("state = 'verified' and delete_state = 'active'").join(asked, "group_id", "left_semi").select("entry", "group_id", "path")


# ------------------------------------------------------------------------------ reports, other tables, Python digests

_REASON = f"case action when 'keep' then '{keep.REASONS[keep.DEFAULT]}' else 'identical to the keeper' end"


@query("report_csv_rows", f"with {_REC} select group_id, path, size_bytes, action, {_REASON} as reason, cast(null as varchar) as blake3, sha256, false as verified from rec")
def _(spark, sf_dir):
    return report.rows(_recommended(spark, sf_dir))  # one digest alone verifies nothing; report_verified has both


_ESC = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"


@query(
    "report_html_rows",
    f"""with {_REC} select group_id, path, '<tr class="' || action || '"><td>' || group_id || '</td><td>' || {_ESC.format('path')} || '</td><td>' || size_bytes || '</td><td>' || {_ESC.format(_REASON)} || '</td></tr>' as html from rec""",
)
def _(spark, sf_dir):
    return report.html_rows(report.rows(_recommended(spark, sf_dir)))


def _table_groups(table: DataFrame, content: str) -> DataFrame:
    """Exact duplicates of any text column: groups by size and digest."""
    text = F.expr(content)
    t = table.select(F.octet_length(text).cast("long").alias("size_bytes"), F.sha2(text.cast("binary"), 256).alias("sha256")).where("sha256 is not null")
    found = t.groupBy("size_bytes", "sha256").agg(F.count(F.lit(1)).alias("files")).where("files >= 2")
    return found.withColumn("reclaimable_bytes", detect.reclaimable(F.col("size_bytes"), F.col("files")))


for _name, _table, _column in (("dup_page_hosts", "pages", "regexp_extract(url, '://([^/]+)', 1)"), ("dup_conversation_roles", "conversations", "role"), ("dup_part_names", "part", "p_name")):
    query(_name, f"select cast(strlen({_column}) as bigint) as size_bytes, sha256({_column}) as sha256, count(*) as files, cast(strlen({_column}) * (count(*) - 1) as bigint) as reclaimable_bytes from {_table} where {_column} is not null group by {_column} having count(*) >= 2")(
        lambda spark, sf_dir, t=_table, c=_column: _table_groups(spark.read.parquet(f"{sf_dir}/{t}.parquet"), c)
    )


@query("blake3_digest")
def _(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.lower(F.hex(blake3(F.col("text").cast("binary")))).alias("blake3"))


@query("nfc_name", "select page_id, nfc_normalize(lower(html)) as normalized from pages")
def _(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.lower(T.nfc(F.col("html"))).alias("normalized"))


@query("constraint_report", "select 'source not allowed' as violation, count(*) as n from documents where source <> 'src0' having count(*) > 0 union all select 'lang not unique', count(*) from (select lang from documents group by 1 having count(*) > 1) having count(*) > 0")
def _(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return report.constraint_violations(docs, [["doc_id"], ["lang"]], {"source": ("src0",)}, ("doc_id",), ("n_chars",))


# ------------------------------------------------------------------------------ files, made inventories, streams


@query("file_inventory")
def _(spark, sf_dir):
    return files.read_files(spark, os.path.realpath(sf_dir)).select("path", "extension", "size_bytes", "link_kind", "access_status")


@query("synthetic_groups", "select sha256(cast(id // 2 as varchar)) as sha256, count(*) as files from range(100000) t(id) group by 1 having count(*) >= 2")
def _(spark, sf_dir):
    return synthetic(spark, 100_000).groupBy("sha256").agg(F.count(F.lit(1)).alias("files")).where("files >= 2")


@query("stream_latest_state", f"with {_LEDGER} select entity, max_by(state, sequence) as state, max(sequence) as sequence from ev group by 1")
def _(spark, sf_dir):
    events, shared = spark.read.parquet(f"{sf_dir}/events.parquet"), folder(spark)
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/event[s].parquet")
    incremental.upsert(ledger.as_ledger(stream), f"{shared}/table", f"{shared}/checkpoint", ["entity"], "sequence").awaitTermination()
    return incremental.read_table(spark, f"{shared}/table").select("entity", "state", "sequence")


from echofold.plans import catalog_queries  # noqa: E402, F401
