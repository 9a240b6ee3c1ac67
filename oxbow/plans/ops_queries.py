"""Queries over materialization, telemetry and operations."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import functions as X
from ..operators import history as H
from ..operators import materialize as M
from ..operators import ops as O
from ..operators import recovery as R
from ..operators import telemetry as T
from ..operators.materialize import Field, ParquetWorkload, ProgressStore
from ..sources import decode_wire, encode_ack, encode_hello, encode_submit
from ..sources.files import Files, cut, delete_at_end, shared_folder
from ._registry import Tables, query

HIST, SUBS, LEDGER, DIR, SAMPLES = ("history",), ("submissions",), ("ledger",), ("directory",), ("samples",)
NOW = 5_000

# --- operations ---


def _rank(q: float, by: str, value: str) -> str:
    return f"min({value}) filter (where rn = floor((n - 1) * {q} + 0.5) + 1) as p{q * 100:g}"


@query("latency_percentiles", f"""ranked as (select producer % 8 as worker, latency, row_number() over (partition by producer % 8 order by latency) as rn, count(*) over (partition by producer % 8) as n from submissions)
select worker, count(*) as n, min(latency) as least, {_rank(0.5, "worker", "latency")}, {_rank(0.9, "worker", "latency")}, {_rank(0.99, "worker", "latency")}, max(latency) as most from ranked group by all""", SUBS)
def latency_percentiles(t):
    return O.nearest_rank(t.submissions().withColumn("worker", F.col("producer") % 8), ["worker"], "latency")


@query("throughput", """w as (select epoch, sum(records)::bigint as records, sum(records * 100)::bigint as bytes, count(*) as submissions, count(distinct producer % 8) as workers, (max(at_us) - min(at_us))::double / 1000000 as wall_s from submissions group by all)
select epoch, records, submissions, workers, wall_s, records / nullif(wall_s, 0) as records_s, bytes / nullif(wall_s, 0) as bytes_s, submissions / nullif(wall_s, 0) as submissions_s, records / nullif(wall_s, 0) / greatest(workers, 1) as records_s_worker from w""", SUBS)
def throughput(t):
    s = t.submissions().select("epoch", "records", (F.col("records") * 100).alias("bytes"), (F.col("producer") % 8).alias("worker"), "at_us")
    return O.throughput(s, ["epoch"], (F.max("at_us") - F.min("at_us")).cast("double") / 1_000_000)


@query("outages", """gaps as (select verse, lag(at_s) over (partition by verse order by at_s) as from_s, at_s as to_s from (select verse, at_us::double / 1000000 as at_s from history)),
nth as (select *, row_number() over (partition by verse order by from_s, to_s) as nth from gaps where to_s - from_s > 7200) select * from nth where nth <= 5""", HIST)
def outages(t):
    return O.outages(t.history().select("verse", (F.col("at_us").cast("double") / 1_000_000).alias("at_s")), ["verse"], 7200)


@query("request_cost", """c as (select verse, sum(records)::bigint as records, count(*) as batches, count(*) as dp, sum(case when id % 2 = 0 then 1 else 0 end)::bigint as dg, sum(id % 3)::bigint as ap, sum(sequence)::bigint as ag from submissions group by all),
d as (select verse, records, batches, greatest(dp - 10, 0) as dp, greatest(dg - 10, 0) as dg, greatest(ap - 10, 0) as ap, greatest(ag - 1000000, 0) as ag from c)
select verse, dp / nullif(records, 0) as data_puts_record, dg / nullif(records, 0) as data_gets_record, ap / nullif(records, 0) as authority_puts_record, ag / nullif(records, 0) as authority_gets_record,
  (dp + dg + ap + ag) / nullif(records, 0) as requests_record, (ap + ag) / nullif(dp + dg + ap + ag, 0) as authority_share, coalesce(records / nullif(batches, 0), 0) as records_batch from d""", SUBS)
def request_cost(t):
    """Counters' deltas never go below zero, as a counter may have restarted."""
    c = t.submissions().groupBy("verse").agg(F.sum("records").alias("records"), F.count("*").alias("batches"), F.count("*").alias("after_data_puts"), F.count_if(F.col("id") % 2 == 0).alias("after_data_gets"), F.sum(F.col("id") % 3).alias("after_authority_puts"), F.sum("sequence").alias("after_authority_gets"))
    for k, v in {"data_puts": 10, "data_gets": 10, "authority_puts": 10, "authority_gets": 1000000}.items():
        c = c.withColumn(f"before_{k}", F.lit(v).cast("long"))
    return O.request_cost(c, ["verse"])


@query("worker_completeness", """select w.worker, coalesce(sum(records), 0)::bigint as records, count(records) as submissions, max(sequence) as max_sequence from range(12) w(worker) left join (select *, producer % 10 as worker from submissions) s using (worker) group by all""", SUBS)
def worker_completeness(t):
    return O.worker_completeness(t.submissions().withColumn("worker", F.col("producer") % 10), 12)


@query("endpoint_attribution", """select endpoint, count(*) as submissions, min(id) as first_seen from submissions group by all""", SUBS)
def endpoint_attribution(t):
    return O.endpoints(t.submissions().withColumn("pos", F.col("id")))


@query("producer_summary", """select producer, verse, max(seq) as max_seq, max_by(ack_status, pos) as last_ack, count(*) filter (where starts_with(ack_status, 'committed:') and not unacked) as committed, count(*) as sends from ledger group by all""", LEDGER)
def producer_summary(t):
    return O.producer_summary(t.ledger())


_LOG = """log as (select 'node-' || (user_id % 20) as node, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as "at", case event_type when 'click' then 'available' when 'view' then 'serving' when 'signup' then 'recovered' when 'error' then 'down' else 'denied' end as event_kind, event_id from events)"""


def _log(t: Tables) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for x in ("click", "available", "view", "serving", "signup", "recovered", "error", "down", "purchase", "denied")])
    return t["events"].select(F.concat(F.lit("node-"), (F.col("user_id") % 20).cast("string")).alias("node"), X.rfc3339_seconds(F.col("ts")).alias("at"), kind[F.col("event_type")].alias("event_kind"), "event_id")


@query("server_summary", f"""with {_LOG}, s as (select node, max("at") filter (where event_kind in ('available', 'recovered', 'serving')) as last_up, max("at") filter (where event_kind in ('down', 'denied')) as last_down from log group by all)
select *, last_up is not null and (last_down is null or last_up > last_down) as up from s""")
def server_summary(t):
    return O.server_summary(_log(t))


@query("directory_latest", """select verse, max_by(owner, published_at_ms) as owner, max(published_at_ms) as published_at_ms from directory group by all""", DIR)
def directory_latest(t):
    return O.latest(t.directory().select("verse", "published_at_ms", "owner"), ["verse"], ["published_at_ms"])


@query("directory_scan", """select owner, canon, verse, published_at_ms + valid_for_ms <= 5000 as stale, row_number() over (order by owner) as place from directory""", DIR)
def directory_scan(t):
    """Stale records stay, in the order of owners."""
    d = t.directory().select("owner", "canon", "verse", (~O.fresh(F.lit(NOW))).alias("stale")).withColumn("n", F.regexp_extract("owner", "([0-9]+)$", 1).cast("long"))
    return H.running(d.withColumn("all", F.lit(0)), ["all"], F.floor(F.col("n") / 1000), ["owner"], "place").select("owner", "canon", "verse", "stale", (F.col("place") + 1).alias("place"))


@query("candidate_rank", f"""select owner, canon, verse, published_at_ms, valid_for_ms, serving, {NOW} < published_at_ms + valid_for_ms as fresh, greatest({NOW} - published_at_ms, 0)::bigint as age_ms,
  row_number() over (partition by canon order by {NOW} < published_at_ms + valid_for_ms desc, serving desc, greatest({NOW} - published_at_ms, 0), owner) as place from directory""", DIR)
def candidate_rank(t):
    return O.rank_candidates(t.directory(), ["canon"], F.lit(NOW).cast("long"))


@query("recovery_candidates", f"""select owner from directory where canon = 'ASIA' and serving and {NOW} < published_at_ms + valid_for_ms""", DIR)
def recovery_candidates(t):
    return t.directory().where("canon = 'ASIA' and serving").where(O.fresh(F.lit(NOW))).select("owner")


@query("capability_verdict", f"""select canon, verse, count(*) filter (where {NOW} < published_at_ms + valid_for_ms) as fresh, count(*) filter (where {NOW} < published_at_ms + valid_for_ms and serving) as eligible,
  case when count(*) filter (where {NOW} < published_at_ms + valid_for_ms and serving) >= 2 then 'satisfied' when count(*) filter (where {NOW} < published_at_ms + valid_for_ms) >= 2 then 'not_serving' else 'missing' end as verdict from directory group by all""", DIR)
def capability_verdict(t):
    return O.capability(t.directory(), ["canon", "verse"], F.lit(NOW), 2)


@query("availability", f"""select n_name as verse, case when count(owner) = 0 then 'never published' when count(*) filter (where {NOW} < published_at_ms + valid_for_ms) = 0 then 'all expired' when count(*) filter (where {NOW} < published_at_ms + valid_for_ms and serving) = 0 then 'none names it'
  else count(*) filter (where {NOW} < published_at_ms + valid_for_ms and serving) || ' heartbeating' end as state from nation left join directory on verse = n_name group by all""", DIR)
def availability(t):
    j = t["nation"].select("n_name").join(t.directory(), F.col("verse") == F.col("n_name"), "left")
    f = F.coalesce(O.fresh(F.lit(NOW)), F.lit(False))
    return j.groupBy(F.col("n_name").alias("verse")).agg(O.availability(F.count("owner"), F.count_if(f), F.count_if(f & F.col("serving"))).alias("state"))


_REPORTS = """reports as (select 'S' || (p_partkey % 30) as scenario, p_partkey as pos, case p_size % 3 when 0 then 'pass' when 1 then 'fail' else 'inconclusive' end as verdict, (p_size % 5)::int as exit_code from part)"""


def _reports(t: Tables) -> DataFrame:
    v = F.when(F.col("p_size") % 3 == 0, "pass").when(F.col("p_size") % 3 == 1, "fail").otherwise("inconclusive")
    return t["part"].select(F.concat(F.lit("S"), (F.col("p_partkey") % 30).cast("string")).alias("scenario"), F.col("p_partkey").alias("pos"), v.alias("verdict"), (F.col("p_size") % 5).cast("int").alias("exit_code"))


@query("coverage_matrix", f"""with {_REPORTS}, l as (select scenario, max_by(verdict, pos) as verdict from reports group by all), c as (select 'S' || i as scenario, (i % 22)::int as family from range(40) r(i))
select scenario, family, case when family in (19, 20) then 'pass' else coalesce(verdict, 'not_run') end as verdict from c left join l using (scenario)""")
def coverage_matrix(t):
    c = t.spark.range(40).select(F.concat(F.lit("S"), F.col("id").cast("string")).alias("scenario"), (F.col("id") % 22).cast("int").alias("family"))
    return O.coverage_matrix(c, _reports(t), (19, 20))


@query("suite_code", f"""with {_REPORTS} select case when bool_or(verdict = 'fail') then 3 when bool_or(verdict = 'inconclusive' or exit_code = 4) then 4 else 0 end as code from reports""")
def suite_code(t):
    return O.suite_code(_reports(t))


_VERDICTS = """v as (select p_partkey as id, case p_size % 4 when 0 then 'pass' when 1 then 'observed' when 2 then 'not_run' else 'fail' end as verdict, p_brand as source from part), s as (select distinct p_brand as source, p_brand like '%1' as synthetic from part where p_brand not like '%3')"""


@query("evidence_check", f"""with {_VERDICTS} select id, verdict, source, problem from (select v.*, case when s.source is null and verdict in ('pass', 'observed') then 'undeclared' when synthetic and verdict not in ('not_run', 'inconclusive') then 'synthetic' end as problem from v left join s using (source)) where problem is not null""")
def evidence_check(t):
    p, m = t["part"], F.col("p_size") % 4
    v = p.select(F.col("p_partkey").alias("id"), F.when(m == 0, "pass").when(m == 1, "observed").when(m == 2, "not_run").otherwise("fail").alias("verdict"), F.col("p_brand").alias("source"))
    return O.evidence_problems(v, p.select(F.col("p_brand").alias("source"), F.col("p_brand").endswith("1").alias("synthetic")).distinct().where("source not like '%3'"))


#: Sources of verdicts, in SQL that both engines read: names that hold one, several or none of the layers' parts.
_SOURCE = """case id % 12 when 0 then 'run/producer.jsonl' when 1 then 'log/server-objects.log' when 2 then 'objects.json' when 3 then 'parquet-by-producer.json' when 4 then 'parquet.json' when 5 then 'iceberg-manifest.json'
  when 6 then 'epoch-manifest.json' when 7 then 'register.json' when 8 then 'notes.md' when 9 then 'not supplied' when 10 then '' end"""


@query("claim_matrix", f"""with v as (select p_partkey as id, p_name as claim, case p_size % 4 when 0 then 'pass' when 1 then 'observed' when 2 then 'not_run' else 'fail' end as verdict from part), s as (select *, {_SOURCE} as source from v)
select claim, verdict, source, case when source is null or source in ('', 'not supplied') then 'missing' else coalesce((select layer from (values (1, 'producer', 'producer'), (2, 'server', 'server'), (3, 'object', 'objects'), (4, 'parquet', 'parquet'),
  (5, 'iceberg', 'iceberg'), (6, 'manifest', 'consumer'), (7, 'register', 'consumer')) r(nth, part, layer) where contains(source, part) order by nth limit 1), 'bundle') end as layer from s
union all select 'table presence', 'observed', null, 'iceberg' union all select 'oracle', 'not_run', null, 'oracle'""")
def claim_matrix(t):
    m = F.col("p_size") % 4
    v = t["part"].select(F.col("p_partkey").alias("id"), F.col("p_name").alias("claim"), F.when(m == 0, "pass").when(m == 1, "observed").when(m == 2, "not_run").otherwise("fail").alias("verdict"))
    return O.claim_matrix(v.withColumn("source", F.expr(_SOURCE)), F.lit("absent"), F.lit("not supplied"))


@query("event_feed", f"""with {_LOG}, f as (select "at", event_kind as kind, node as text from log where event_kind = 'down' union all select "at", event_kind, node from log where event_kind = 'recovered' union all select '9999', 'summary', count(*)::varchar from log)
select * from f order by "at", kind, text limit 32""")
def event_feed(t):
    log = _log(t)
    told = log.select("at", F.col("event_kind").alias("kind"), F.col("node").alias("text"))
    return O.event_feed(told.where("kind = 'down'"), told.where("kind = 'recovered'"), log.agg(F.lit("9999").alias("at"), F.lit("summary").alias("kind"), F.count("*").cast("string").alias("text")))


@query("ledger_effects", """select verse as scope, case when unacked then 'unacked' when ack_status = 'denied' then 'denied' else 'committed' end as effect, count(*) as n from ledger group by all""", LEDGER)
def ledger_effects(t):
    effect = F.when(F.col("unacked"), "unacked").when(F.col("ack_status") == "denied", "denied").otherwise("committed")
    return t.ledger().groupBy(F.col("verse").alias("scope"), effect.alias("effect")).agg(F.count("*").alias("n"))


@query("records_per_chunk", """select verse, case when count(*) filter (where records > 2) = 0 then 0 else sum(records) / count(*) filter (where records > 2) end as records_chunk from submissions group by all""", SUBS)
def records_per_chunk(t):
    return t.submissions().groupBy("verse").agg(F.coalesce(F.sum("records") / F.nullif(F.count_if(F.col("records") > 2), F.lit(0)), F.lit(0.0)).alias("records_chunk"))


@query("effective_writer", f"""select owner, verse, serving and {NOW} < published_at_ms + valid_for_ms and published_at_ms % 500 <> 0 and owner = first_owner as effective from (select *, min(owner) over (partition by verse) as first_owner from directory)""", DIR)
def effective_writer(t):
    """Not sealed, serving, still valid, and the owner that the authority names."""
    d = t.directory()
    named = d.groupBy(F.col("verse").alias("a_verse")).agg(F.min("owner").alias("named"))
    return d.join(named, F.col("verse") == F.col("a_verse")).select("owner", "verse", (F.col("serving") & O.fresh(F.lit(NOW)) & (F.col("published_at_ms") % 500 != 0) & (F.col("owner") == F.col("named"))).alias("effective"))


#: Facts of a stream, in SQL that both engines read: a tenth of the streams are new, another tenth seem so.
_FACTS = {
    "active": "k % 10 <> 0 and k % 2 = 0",
    "quorum": "k % 9 <> 0",
    "competing": "k % 11 = 0",
    "repairable": "k % 10 <> 0 and k % 3 = 0",
    "seal_incomplete": "k % 10 <> 0 and k % 7 < 3",
    "boundary_known": "k % 10 <> 0 and k % 4 < 2",
    "corrupt": "k % 10 <> 0 and k % 13 = 0",
    "fresh": "k % 5 = 0",
    "bootstrap": "k % 20 = 0 or k % 17 = 0",
}


@query("recovery_plan", f"""with f as (select p_partkey as k, mode from part, (values ('inspect'), ('safe_repair'), ('guided'), ('emergency')) m(mode)), d as (select k, mode, {", ".join(f"({e}) as {c}" for c, e in _FACTS.items())} from f),
o as (select *, fresh and (active or seal_incomplete or boundary_known or corrupt or repairable) or bootstrap and not fresh as odd, seal_incomplete and not boundary_known and not active as unclear from d),
g as (select *, case when odd then 'contradiction' when not quorum then 'no_quorum' when competing then 'competing' when corrupt then 'corrupt' when fresh and bootstrap then 'bootstrap' when fresh then 'empty' when unclear then 'ambiguous' else 'steps' end as situation from o),
q as (select *, case when mode = 'guided' or (mode = 'emergency' and situation = 'ambiguous') then case situation when 'competing' then 'choose_register_history' when 'corrupt' then 'corrupt_chunk_disposition' when 'empty' then 'confirm_bootstrap' when 'ambiguous' then 'successor_boundary' end end as question from g),
a as (select *, case when situation <> 'steps' or mode = 'inspect' then '' when mode = 'emergency' then concat_ws(',', case when repairable then 'repair_replica_value' end, case when boundary_known and not active then 'publish_derived_successor' end)
  else concat_ws(',', case when repairable then 'repair_replica_value' end, case when seal_incomplete and boundary_known then 'complete_known_seal' end, case when boundary_known and not active and mode = 'guided' then 'publish_derived_successor' end, case when active then 'start_existing_owner' end) end as steps from q),
b as (select *, situation not in ('steps', 'bootstrap') or (situation = 'steps' and mode <> 'inspect' and steps = '' and not active) as stuck from a),
c as (select *, case when question is not null then 'hold_for_operator' when stuck then 'reject_blocked' when situation = 'bootstrap' then case when mode = 'inspect' then '' else 'bootstrap_new_journal' end else steps end as actions from b)
select k, mode, situation, case when question is not null then 'needs_guidance' when stuck then 'blocked' when mode = 'inspect' then 'inspecting' when mode = 'emergency' then 'emergency_ready' else 'ready' end as state,
  case when odd then 'inconsistent_evidence' else concat_ws(',', case when competing then 'competing_registers' end, case when not quorum then 'missing_quorum' end, case when corrupt then 'corrupt_chunk' end, case when repairable then 'repairable_replica' end,
    case when seal_incomplete then 'incomplete_known_seal' end, case when active then 'active_generation' end, case when fresh then 'fresh_prefix' end, case when boundary_known then 'derived_successor' end, case when situation = 'ambiguous' then 'ambiguous_successor' end) end as findings,
  actions, question, not regexp_matches(actions, 'publish|bootstrap') as reversible, regexp_matches(actions, 'seal|publish|start|bootstrap') as needs_fence from c""")
def recovery_plan(t):
    """Every mode's plan for each part as a stream."""
    modes = F.explode(F.array(*[F.lit(m) for m in ("inspect", "safe_repair", "guided", "emergency")]))
    facts = t["part"].select(F.col("p_partkey").alias("k"), modes.alias("mode"))
    p = R.plan(facts.select("k", "mode", *[F.expr(e).alias(c) for c, e in _FACTS.items()]))
    return p.select("k", "mode", "situation", "state", F.array_join("findings", ",").alias("findings"), F.array_join("actions", ",").alias("actions"), "question", "reversible", "needs_fence")


@query("directory_live", """ops as (select owner, published_at_ms as "at", 'publish' as op, verse, serving from directory union all select owner, published_at_ms + 50000, 'publish', verse, not serving from directory where published_at_ms % 400 = 0
  union all select owner, published_at_ms + 60000, 'withdraw', verse, serving from directory where published_at_ms % 300 = 0 union all select owner, published_at_ms + 10, 'withdraw', verse, serving from directory where published_at_ms % 800 = 0)
select owner, "at", verse, serving from (select *, row_number() over (partition by owner order by "at" desc) as rn from ops) where rn = 1 and op = 'publish'""", DIR)
def directory_live(t):
    d, at = t.directory(), F.col("published_at_ms")
    op = lambda later, kind, serving: F.struct((at + later).alias("at"), F.lit(kind).alias("op"), serving.alias("serving"))
    ops = F.array(op(0, "publish", F.col("serving")), F.when(at % 400 == 0, op(50_000, "publish", ~F.col("serving"))), F.when(at % 300 == 0, op(60_000, "withdraw", F.col("serving"))), F.when(at % 800 == 0, op(10, "withdraw", F.col("serving"))))
    return O.live(d.select("owner", "verse", F.inline(F.array_compact(ops))), "owner")


@query("secret_scan", r"""select doc_id, regexp_matches(t, 'AKIA[0-9A-Z]{16}|(?i:AWS_SECRET_ACCESS_KEY)|Bearer\s+[A-Za-z0-9\-._~+/]+=*|BEGIN (RSA |OPENSSH )?PRIVATE KEY|"SecretAccessKey"\s*:|(?i:X-Amz-Signature=)') as secret from (select doc_id, text as t from documents)""")
def secret_scan(t):
    return t["documents"].select("doc_id", X.has_secret(F.col("text")).alias("secret"))


@query("safe_payload", r"""select doc_id, case when regexp_matches(p, '[\x00-\x08\x0A-\x1F\x7F]') then 'hex' else 'text' end as encoding, case when regexp_matches(p, '[\x00-\x08\x0A-\x1F\x7F]') then lower(hex(encode(p))) else replace(replace(replace(p, '\', '\\'), '"', '\"'), chr(9), '\t') end as text from (select doc_id, text as p from documents)""")
def safe_payload(t):
    p = X.safe_payload(F.col("text").cast("binary"))
    return t["documents"].select("doc_id", p["encoding"].alias("encoding"), p["text"].alias("text"))


@query("commit_refs", r"""select event_id, case when ok then regexp_extract(ref, '^parquet:([^#]*)#(.+)$', 1) end as file, case when ok then regexp_extract(ref, '^parquet:([^#]*)#(.+)$', 2) end as digest from (
  select *, regexp_matches(ref, '^parquet:([^#]*)#(.+)$') and not regexp_matches(regexp_extract(ref, '^parquet:([^#]*)#(.+)$', 1), '[/\\]|\.\.') and regexp_extract(ref, '^parquet:([^#]*)#(.+)$', 1) <> '' as ok from (select event_id, case event_id % 5 when 0 then 'parquet:f' || event_id || '#sha256:ab' when 1 then 'parquet:../x#sha256:ab' when 2 then 'parquet:#sha256:ab' when 3 then 'json:f#x' else 'parquet:a/b#x' end as ref from events))""")
def commit_refs(t):
    i = F.col("event_id")
    ref = F.when(i % 5 == 0, F.concat(F.lit("parquet:f"), i.cast("string"), F.lit("#sha256:ab"))).when(i % 5 == 1, "parquet:../x#sha256:ab").when(i % 5 == 2, "parquet:#sha256:ab").when(i % 5 == 3, "json:f#x").otherwise("parquet:a/b#x")
    r = X.commit_ref(ref)
    return t["events"].select("event_id", r["file"].alias("file"), r["digest"].alias("digest"))


@query("ack_lines", """select pos, case when ack_status <> 'denied' then "offset" end as first_offset, case when ack_status <> 'denied' then "offset" + 1 end as next_offset, verse as route from ledger""", LEDGER)
def ack_lines(t):
    """Acknowledgements as text lines, read back; and a key=value token."""
    line = F.when(F.col("ack_status") == "denied", "ERR denied").otherwise(F.concat_ws(" ", F.lit("OK"), F.col("offset").cast("string"), (F.col("offset") + 1).cast("string")))
    a = X.ack_line(line)
    return t.ledger().select("pos", a["first_offset"].alias("first_offset"), a["next_offset"].alias("next_offset"), X.token(F.concat(F.lit("at=1 route="), F.col("verse"), F.lit(" x")), "route").alias("route"))


@query("age_texts", """select owner, case when s < 60 then printf('%.1f', s::double) || 's ago' else cast(floor(s / 60) as bigint) || 'm ago' end as age from (select owner, valid_for_ms % 300 as s from directory)""", DIR)
def age_texts(t):
    return t.directory().select("owner", X.age_text(F.col("valid_for_ms") % 300).alias("age"))


# --- materialization ---

FIELDS = [Field("id", "utf8", False), Field("amount", "int64"), Field("rate", "float64"), Field("flag", "bool")]


def _payloads(t: Tables) -> DataFrame:
    i = F.col("event_id").cast("string")
    j = F.concat(F.lit('{"id": "e'), i, F.lit('", "amount": '), i, F.lit(', "rate": 0.5, "flag": true, "extra": [1]}'))
    bad = {1: '{"id": 7}', 2: '{"id": "x", "amount": 1.5}', 3: '{"id": "x", "amount": "1"}', 4: '{"amount": 1}', 5: "[1]", 6: "{nope", 7: '{"id": "x", "flag": 1}', 8: '{"id": null}'}
    out = F.when(F.col("event_id") % 20 == 0, '{"id": "z", "amount": null}')
    for k, v in bad.items():
        out = out.when(F.col("event_id") % 20 == k, v)
    return t["events"].select("event_id", out.otherwise(j).alias("payload"))


@query("json_typed_projection", """select event_id, case when m in (1, 4, 5, 6, 8) then null when m = 0 then 'z' when m in (2, 3, 7) then 'x' else 'e' || event_id end as id, case when m = 4 then 1 when m < 9 then null else event_id end as amount, case when m < 9 then null else 0.5::double end as rate, case when m < 9 then null else true end as flag,
  case m when 1 then 'id: not utf8' when 2 then 'amount: not int64' when 3 then 'amount: not int64' when 4 then 'id: missing' when 5 then 'not an object' when 6 then 'not an object' when 7 then 'flag: not bool' when 8 then 'id: missing' end as problem from (select event_id, event_id % 20 as m from events)""")
def json_typed_projection(t):
    return M.project(_payloads(t), FIELDS, keep=("event_id",))


@query("source_digests", """select event_id, case event_id % 3 when 0 then 'sha256:' || sha256('{"id": "a"}') when 1 then 'given' end as source_digest, case when event_id % 3 = 2 then 'source_digest: missing' end as problem from events""")
def source_digests(t):
    p = F.when(F.col("event_id") % 3 == 0, '{"id": "a"}').when(F.col("event_id") % 3 == 1, '{"id": "a", "source_digest": "given"}').otherwise('{"id": "a", "source_digest": null}')
    return M.project(t["events"].withColumn("payload", p), [Field("id", "utf8", False), Field("source_digest", "utf8", False)], keep=("event_id",)).drop("id")


@query("batch_limits", """select *, case when records > 150 then 'records' when size > 1350 then 'bytes' end as problem from (select verse, "offset" // 200 * 200 as first, "offset" // 200 * 200 + 200 as "next", count(*) as records, sum(octet_length(encode(payload)))::bigint as size from history group by all) where problem is not null""", HIST)
def batch_limits(t):
    h = t.history().select("verse", (F.floor(F.col("offset") / 200) * 200).alias("first"), "offset", F.octet_length("payload").alias("bytes"))
    return M.batch_limits(h.withColumn("next", F.col("first") + 200), 150, 1350)


@query("object_names", """select verse, first, sha256(concat_ws(chr(0), 'w', 'c', verse, '1', first::varchar, (first + 100)::varchar)) || '.parquet' as name from (select distinct verse, "offset" // 100 * 100 as first from history)""", HIST)
def object_names(t):
    r = t.history().select("verse", (F.floor(F.col("offset") / 100) * 100).alias("first")).distinct()
    return r.select("verse", "first", X.object_name(F.lit("w"), F.lit("c"), F.col("verse"), F.lit(1), F.col("first"), F.col("first") + 100).alias("name"))


_MANIFESTS = """m as (select conv_id || ':' || turn as ref, case when turn > 0 then conv_id || ':' || (turn - 1) end as previous, conv_id as verse, 1 as epoch, turn * 10 as first, turn * 10 + 10 + (case when conv_id % 10 = 0 and turn = 1 then 1 else 0 end) as "next", turn from conversations where not (conv_id % 10 = 1 and turn = 0))"""


@query("manifest_chain", f"""with recursive {_MANIFESTS}, h as (select conv_id || ':' || max(turn) as head from conversations group by conv_id),
walk as (select head, 0 as depth, head as ref, m.verse, m.epoch, m.first, m."next", case when m.ref is null then 'missing' end as problem, m.previous from h left join m on m.ref = h.head
  union all select w.head, w.depth + 1, w.previous, m.verse, m.epoch, m.first, m."next", case when m.ref is null then 'missing' when m."next" <> w.first then 'gap' end, m.previous from walk w left join m on m.ref = w.previous where w.problem is null and w.previous is not null)
select head, depth, ref, verse, epoch, first, "next", problem from walk""")
def manifest_chain(t):
    c = t["conversations"].select("conv_id", "turn").where("not (conv_id % 10 = 1 and turn = 0)")
    ref = lambda x: F.concat(F.col("conv_id").cast("string"), F.lit(":"), x.cast("string"))
    m = c.select(ref(F.col("turn")).alias("ref"), F.when(F.col("turn") > 0, ref(F.col("turn") - 1)).alias("previous"), F.col("conv_id").alias("verse"), F.lit(1).alias("epoch"), (F.col("turn") * 10).alias("first"), (F.col("turn") * 10 + 10 + F.when((F.col("conv_id") % 10 == 0) & (F.col("turn") == 1), 1).otherwise(0)).alias("next"))
    heads = t["conversations"].groupBy("conv_id").agg(F.max("turn").alias("turn")).select(ref(F.col("turn")).alias("ref"))
    return M.walk(m, heads)


@query("digest_pairing", """select verse as file, 100 + row_number() over (partition by verse order by "offset") - 1 as "offset", sha256(payload) as source_digest from history where event_id % 9 <> 0""", HIST)
def digest_pairing(t):
    h = t.history().select(F.col("verse").alias("file"), F.col("offset").alias("row"), F.when(F.col("event_id") % 9 != 0, F.sha2("payload", 256)).alias("source_digest"), F.floor(F.col("at_us") / 3_600_000_000).alias("hour"))
    h = H.running(h.where("source_digest is not null"), ["file"], F.col("hour"), ["row"], "offset")
    return h.select("file", (F.col("offset") + 100).alias("offset"), "source_digest")


#: Records of a materialized range.
BATCH = 1000


def _materialized(t: Tables) -> tuple[str, list[M.Register]]:
    """Every verse's history written range by range, by two owners in turn: the folder of it, and the registers.

    All ranges' rows are written in the same few jobs; verses are then published side by side, each one's ranges in turn.
    """
    first = F.floor(F.col("offset") / BATCH) * BATCH
    h = cut(t.history().select("verse", first.alias("first"), "offset", "payload"))
    folder = f"{shared_folder(t.spark)}/materialized-{uuid.uuid4().hex}"
    delete_at_end(t.spark, folder)
    fields = [Field("k", "int64"), Field("source_digest", "utf8", False)]
    staged = M.stage(t.spark, h, fields, f"{folder}/staged")
    store, out = ProgressStore(f"{folder}/progress", t.spark), Files(t.spark, f"{folder}/out")

    def publish(verse: str, end: int):
        for owner, start in enumerate(range(0, end, 2 * BATCH)):
            w = ParquetWorkload(t.spark, store, out, fields, "s.v1", "w", "c", verse, f"owner-{owner}")
            for first in range(start, min(start + 2 * BATCH, end), BATCH):
                w.process_staged(staged.get((verse, first)), first, min(first + BATCH, end))
        return store.observe("w", "c", verse)

    ends = h.groupBy("verse").agg((F.max("offset") + 1).alias("end")).orderBy("verse").collect()
    with ThreadPoolExecutor(8) as pool:
        registers = list(pool.map(publish, *zip(*ends))) if ends else []
    Files(t.spark, folder).delete("staged")
    return f"{folder}/out", registers


@query("parquet_summary", f"""n as (select verse, count(*) as row_count, min("offset") as first_offset, max("offset") + 1 as next_offset, max("offset") // {BATCH} as last, count(distinct "offset" // {BATCH}) as manifest_count from history group by all)
select verse, (last // 2 + 1)::bigint as binding_epoch, row_count, 'k,source_digest' as schema_fields, first_offset, next_offset, manifest_count,
  sha256(concat_ws(chr(0), 'w', 'c', verse, (last // 2 + 1)::bigint::varchar, (last * {BATCH})::varchar, next_offset::varchar)) || '.json' as canonical_manifest from n""", HIST)
def parquet_summary(t):
    schema = "verse string, binding_epoch long, row_count long, schema_fields string, first_offset long, next_offset long, manifest_count long, canonical_manifest string"
    return t.spark.createDataFrame(M.facts(t.spark, *_materialized(t), None), schema)


@query("parquet_digests", """select verse, "offset", 'sha256:' || sha256(payload) as source_digest from history""", HIST)
def parquet_digests(t):
    return M.summaries(t.spark, *_materialized(t), None)[1]


# --- telemetry ---


@query("openmetrics_parse", r"""p as (select event_id // 100 as body_id, row_number() over (partition by event_id // 100 order by event_id) - 1 as place, * from samples where l_k is not null and l_user is not null)
select body_id, place, name || '_total' as name, '{"user":"' || l_user || '","k":"a\"' || l_k || '"}' as labels, value, timestamp_ms, case when name = 'click' then 'counter' else 'untyped' end as metric_type, 0 as unparseable from p
union all select body_id, count(*), null, null, null, null, null, 2 from p group by all""", SAMPLES)
def openmetrics_parse(t):
    """Samples, a hundred to a text, written as exposition text and read back, with two lines that can't be read."""
    s = t.samples()
    line = F.concat(F.col("name"), F.lit('_total{user="'), F.col("labels")["user"], F.lit('",k="a\\"'), F.col("labels")["k"], F.lit('"} '), F.col("value").cast("string"), F.lit(" "), F.col("timestamp_ms").cast("string"), F.when(F.col("event_id") % 7 == 0, ' # {t="1"} 2').otherwise(""))
    blocks = s.groupBy((F.floor(F.col("event_id") / 100)).alias("body_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    body = F.concat(F.lit("# TYPE click_total counter\n# TYPE other_total\n"), F.col("lines"), F.lit("\nbad{line 1 2 3\n# EOF\n"))
    out = T.scrape(blocks.select("body_id", body.alias("body")))
    return out.withColumn("labels", F.to_json("labels"))


_LABELS = """'user=' || l_user || coalesce(',' || 'k=' || l_k, '')"""


@query("series_cap", """select event_id, case when name not in ('click', 'view') then 'not_allowlisted' when row_number() over (partition by scrape, name in ('click', 'view') order by timestamp_ms, event_id) > 5 then 'over_cap' else 'kept' end as fate from samples""", SAMPLES)
def series_cap(t):
    return _fated(t).select("event_id", "fate")


def _fated(t: Tables) -> DataFrame:
    return T.normalize(t.samples(), ["scrape"], ["timestamp_ms", "event_id"], ["click", "view"], 5, ["user", "k", "uid"], ["uid"])


@query("drop_counts", """f as (select scrape, case when name not in ('click', 'view') then 'not_allowlisted' when row_number() over (partition by scrape, name in ('click', 'view') order by timestamp_ms, event_id) > 5 then 'over_cap' else 'kept' end as fate from samples)
select scrape, count(*) filter (where fate = 'kept') as kept, count(*) filter (where fate = 'not_allowlisted') as not_allowlisted, count(*) filter (where fate = 'over_cap') as over_cap from f group by all""", SAMPLES)
def drop_counts(t):
    return T.drop_counts(_fated(t), ["scrape"])


@query("label_filter", """select event_id, 'k=' || l_k || ',user=' || l_user as labels from samples""", SAMPLES)
def label_filter(t):
    told = F.array_join(F.array_sort(F.transform(F.map_entries("labels"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return _fated(t).select("event_id", told.alias("labels"))


def _envelopes(t: Tables) -> DataFrame:
    s = t.samples().select("event_id", F.lit("p").alias("producer"), F.lit("c").alias("canon"), F.col("name").alias("verse"), F.lit("i0").alias("incarnation"), F.lit("t").alias("target"), "name", T.filter_labels(F.col("labels"), ["user"], []).alias("labels"), "value", F.when(F.col("event_id") % 2 == 0, F.col("timestamp_ms")).alias("timestamp_ms"), F.when(F.col("name") == "click", "counter").otherwise("gauge").alias("metric_type"))
    return T.envelope(s, F.timestamp_millis(F.lit(1_700_000_000_000)), F.floor(F.col("event_id") / 2))


@query("envelopes", """select event_id, name, case when name = 'click' then 'sum' else 'gauge' end as type, case when name = 'click' then 'true' end as monotonic, l_user as user_label, (case when event_id % 2 = 0 then timestamp_ms else 1700000000000 end)::varchar || '000000' as time_unix_nano, value as as_double,
  event_id // 2 as seq, '2023-11-14T22:13:20Z' as collected_at from samples""", SAMPLES)
def envelopes(t):
    g = lambda p: F.get_json_object("line", p)
    at = "$.otel.metric"
    return _envelopes(t).select("event_id", g(f"{at}.name").alias("name"), g(f"{at}.type").alias("type"), g(f"{at}.monotonic").alias("monotonic"), g(f"{at}.data_point.attributes.user").alias("user_label"), g(f"{at}.data_point.time_unix_nano").alias("time_unix_nano"), g(f"{at}.data_point.as_double").cast("double").alias("as_double"), g("$.seq").cast("bigint").alias("seq"), g("$.collected_at").alias("collected_at"))


@query("envelope_dedup", """select 'p' as producer_id, name as verse, 'i0' as incarnation, event_id // 2 as seq, min_by(value, event_id) as value from samples group by all""", SAMPLES)
def envelope_dedup(t):
    d = T.dedup_envelopes(_envelopes(t).select("event_id", "line"), ["event_id"])
    return d.select("producer_id", "verse", "incarnation", "seq", F.get_json_object("line", "$.otel.metric.data_point.as_double").cast("double").alias("value"))


@query("sequence_allocation", """select event_id, row_number() over (partition by user_id, event_type order by event_id) - 1 as seq from events""")
def sequence_allocation(t):
    e = t["events"].select("event_id", "user_id", "event_type")
    return H.running(e, ["user_id", "event_type"], F.floor(F.col("event_id") / 10_000), ["event_id"], "seq").select("event_id", "seq")


@query("wire_decode", """with e as (select event_id // 100 as stream_id, row_number() over (partition by event_id // 100 order by event_id) - 1 as s, count(*) over (partition by event_id // 100) as n, props from events),
f as (select stream_id, 0 as nth, 'hello' as kind, upper(lpad(to_hex(stream_id), 32, '0')) as producer, stream_id + 1 as epoch, null::bigint as sequence, null::varchar as payload, null::int as records, null::bigint as first_offset, null::bigint as next_offset, null::varchar as message from e where s = 0
  union all select stream_id, 1 + 2 * s, 'submit', null, null, s, upper(hex(encode(props))), 2, null, null, null from e
  union all select stream_id, 2 + 2 * s, case when cut then 'invalid' else 'ack' end, null, case when not cut then stream_id + 1 end, case when not cut then s end, null, null, case when not cut then 2 * s end, case when not cut then 2 * s + 2 end, case when cut then 'frame' end from (select *, s = n - 1 and stream_id % 10 = 9 as cut from e))
select * from f""")
def wire_decode(t):
    """Events, a hundred to a stream, as captured streams of the wire format; every tenth stream is cut short."""

    def capture(events: pd.DataFrame) -> pd.DataFrame:
        i = int(events["stream_id"].iloc[0])
        stream = encode_hello(i.to_bytes(16, "big"), i + 1)
        for s, props in enumerate(events.sort_values("event_id")["props"]):
            stream += encode_submit(s, [props.encode(), b"\x00\xff"]) + encode_ack(i + 1, s, 2 * s, 2 * s + 2)
        return pd.DataFrame({"stream_id": [i], "content": [stream[: len(stream) - (i % 10 == 9)]]})

    e = t["events"].select(F.floor(F.col("event_id") / 100).alias("stream_id"), "event_id", F.coalesce("props", F.lit("")).alias("props"))
    f = decode_wire(e.groupBy("stream_id").applyInPandas(capture, "stream_id long, content binary"))
    records = F.when(F.col("records").isNotNull(), F.size("records"))
    return f.withColumn("payload", F.hex(F.get("records", F.lit(0)))).withColumn("records", records).withColumn("producer", F.hex("producer"))


# --- SQL over the same tables, beside what ordered logs need ---


@query("sql_rollup", """select r_name, n_name, count(*) as orders, cast(round(sum(o_totalprice) * 100) as bigint) as cents, grouping(n_name)::int as total from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by rollup (r_name, n_name)""")
def sql_rollup(t):
    for name in ("orders", "customer", "nation", "region"):
        t[name].createOrReplaceTempView(name)
    return t.spark.sql("select r_name, n_name, count(*) as orders, cast(round(sum(cast(o_totalprice as decimal(18, 2))) * 100) as bigint) as cents, cast(grouping(n_name) as int) as total from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by rollup (r_name, n_name)")


@query("sql_windows", """select o_custkey, o_orderkey, rank() over (partition by o_custkey order by o_totalprice desc) as place, count(*) over (partition by o_custkey order by o_orderdate range between interval 90 days preceding and current row) as recent from orders""")
def sql_windows(t):
    t["orders"].createOrReplaceTempView("orders")
    return t.spark.sql("select o_custkey, o_orderkey, cast(rank() over (partition by o_custkey order by o_totalprice desc) as bigint) as place, count(*) over (partition by o_custkey order by o_orderdate range between interval 90 days preceding and current row) as recent from orders")
