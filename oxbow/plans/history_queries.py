"""Queries over ordered histories, ingest and blobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import record_digest, safe_payload
from ..operators import blobs as B
from ..operators import history as H
from ..operators import ingest as I
from ..operators import recovery as R
from ..operators import verify as V
from ._registry import SQL, Tables, query

SEGMENT = 1000
HIST, SUBS = ("history",), ("submissions",)


@query("history_summary", f"""select verse, "offset" // {SEGMENT} as segment, min("offset") as first_offset, max("offset") + 1 as next_offset, count(*) as n,
  sha256(string_agg(sha256(payload), '' order by "offset")) as chain from history group by all""", HIST)
def history_summary(t: Tables) -> DataFrame:
    """Bounds and digest chain of every segment of SEGMENT offsets: what a group gathers is bounded."""
    h = t.history().withColumn("segment", F.floor(F.col("offset") / SEGMENT))
    chain = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", F.sha2("payload", 256).alias("h")))), lambda x: x["h"]), ""), 256)
    return h.groupBy("verse", "segment").agg(F.min("offset").alias("first_offset"), (F.max("offset") + 1).alias("next_offset"), F.count("*").alias("n"), chain.alias("chain"))


@query("range_scan", """select verse, "offset", payload from history where verse = 'click' and "offset" >= 100 and "offset" < 200""", HIST)
def range_scan(t):
    return H.range_scan(t.history(), "click", 100, 200).select("verse", "offset", "payload")


@query("range_violations", """ranges(verse, first, "next", trim) as (values ('click', 100, 150, 100), ('click', 50, 60, 100), ('view', 100, 100000000, 100), ('error', 120, 190, 100), ('signup', 90, 80, 0)),
told as (select r.*, count(h."offset") as found, count(*) filter (where h.event_id % 97 = 0) as unmapped from ranges r left join history h on h.verse = r.verse and h."offset" >= r.first and h."offset" < r."next" group by all)
select verse, first::bigint as first, "next"::bigint as "next", trim::bigint as trim, found, unmapped, case when "next" < first then 'inverted' when first < trim then 'trimmed' when found < "next" - first then 'missing' when unmapped > 0 then 'unmapped' end as problem from told where problem is not null""", HIST)
def range_violations(t):
    ranges = t.spark.sql("select * from values ('click', 100L, 150L, 100L), ('click', 50L, 60L, 100L), ('view', 100L, 100000000L, 100L), ('error', 120L, 190L, 100L), ('signup', 90L, 80L, 0L) as r(verse, first, next, trim)")
    return H.range_violations(t.history().withColumn("mapped", F.col("event_id") % 97 != 0), ranges)


@query("resume_scan", """select h.verse, "offset", payload from history h join (select verse, max("offset") + 1 - 10 as next_offset from history group by all) c on c.verse = h.verse and h."offset" >= c.next_offset""", HIST)
def resume_scan(t):
    h = t.history()
    return H.resume(h, H.tails(h).select("verse", (F.col("tail") - 10).alias("next_offset"))).select("verse", "offset", "payload")


@query("tail_refresh", """select verse, max("offset") + 1 as tail from history group by all""", HIST)
def tail_refresh(t):
    return H.tails(t.history())


@query("console_scan", """select verse, "offset" as record_offset, octet_length(encode(payload))::bigint as bytes, 'sha256:' || sha256(payload) as digest, replace(replace(payload, '\\', '\\\\'), '"', '\\"') as text, 'text' as encoding
  from history where verse = 'view' and "offset" >= 5 order by "offset" limit 20""", HIST)
def console_scan(t):
    """From an offset on, until so many records: the limit is what the console asks for."""
    p = safe_payload(F.col("payload").cast("binary"))
    h = t.history().where("verse = 'view' and offset >= 5").orderBy("offset").limit(20)
    return h.select("verse", F.col("offset").alias("record_offset"), F.octet_length("payload").cast("long").alias("bytes"), F.concat(F.lit("sha256:"), F.sha2("payload", 256)).alias("digest"), p["text"].alias("text"), p["encoding"].alias("encoding"))


@query("attribute_filter", """select verse, "offset" from history where json_extract_string(payload, '$.k') = '42'""", HIST)
def attribute_filter(t):
    attributes = F.create_map(F.lit("k"), F.get_json_object("payload", "$.k"))
    return t.history().withColumn("attributes", attributes).where(F.col("attributes")["k"] == "42").select("verse", "offset")


@query("contiguous_end", """select verse, max_by(start + tail, epoch)::bigint as "end" from (select verse, epoch, min(first_offset) as start, sum(records) as tail from submissions group by all) group by all""", SUBS)
def contiguous_end(t):
    g = t.submissions().groupBy("verse", F.col("epoch").alias("generation")).agg(F.min("first_offset").alias("start"), F.sum("records").alias("contiguous_tail"))
    return H.contiguous_end(g)


@query("generation_counts", """select verse, epoch, count(*) as submissions, sum(records)::bigint as records from submissions group by all""", SUBS)
def generation_counts(t):
    return t.submissions().groupBy("verse", "epoch").agg(F.count("*").alias("submissions"), F.sum("records").alias("records"))


@query("reader_stalls", """select verse, at_us, gap_us from (select verse, at_us, at_us - lag(at_us) over (partition by verse order by at_us) as gap_us from history) where gap_us > 3600000000""", HIST)
def reader_stalls(t):
    return H.stalls(t.history().select("verse", "at_us"), 3600).select("verse", "at_us", "gap_us")


@query("trim_gap", """requests as (select verse, unnest([50, 150]) as requested from (select distinct verse from history)), trims as (select verse, 100 as trim from (select distinct verse from history))
select r.verse, requested::bigint as requested, requested < trim as gap, case when requested < trim then (select min("offset") from history h where h.verse = r.verse and "offset" >= trim) else requested end::bigint as new_start
from requests r join trims using (verse) where exists (select 1 from history h where h.verse = r.verse and "offset" >= trim)""", HIST)
def trim_gap(t):
    h = t.history()
    verses = h.select("verse").distinct()
    return H.trim_gap(h, verses.select("verse", F.explode(F.expr("array(50L, 150L)")).alias("requested")), verses.select("verse", F.lit(100).cast("long").alias("trim")))


@query("dense_offsets", """select verse, id, first_offset, next_offset, sequence from submissions""", SUBS)
def dense_offsets(t):
    return t.submissions().select("verse", "id", "first_offset", "next_offset", "sequence")


_COHORTS = """pairs as (select conv_id as verse, turn // 2 as position, min(turn) as base, count(*) as n from conversations group by all), kept as (select * from pairs where not (verse % 10 = 0 and position = 1))"""


@query("cohort_chain_violations", f"""with {_COHORTS} select verse, position, base, expected from (select *, lag(base + n) over (partition by verse order by position) as expected from kept) where expected is not null and base <> expected""")
def cohort_chain_violations(t):
    pairs = t["conversations"].groupBy(F.col("conv_id").alias("verse"), F.floor(F.col("turn") / 2).alias("position")).agg(F.min("turn").alias("base"), F.count("*").alias("n"))
    return H.chain_violations(pairs.where("not (verse % 10 = 0 and position = 1)"))


@query("generation_violations", """select producer as verse, id as position, epoch as generation, problem from (select *, case when epoch > 1999 then 'above_active' when epoch < lag(epoch) over (partition by producer order by id) then 'falls' end as problem from submissions) where problem is not null""", SUBS)
def generation_violations(t):
    s = t.submissions().select(F.col("producer").alias("verse"), F.col("id").alias("position"), F.col("epoch").alias("generation"))
    return H.generation_violations(s, F.lit(1999))


@query("offset_explode", """select doc_id, doc_id * 100000 + i - 1 as "offset", sha256(l[i]) as digest from (select doc_id, string_split(text, chr(10)) as l from documents), unnest(range(1, len(l) + 1)) u(i)""")
def offset_explode(t):
    """Documents as frames, their lines as records."""
    d = t["documents"].select("doc_id", (F.col("doc_id") * 100000).alias("base_offset"), F.split("text", "\n").alias("records"))
    return H.explode_frames(d).select("doc_id", "offset", F.sha2("record", 256).alias("digest"))


@query("attribution_spans", """select verse, o as "offset", producer, sequence from submissions, unnest(range(first_offset, next_offset)) u(o)""", SUBS)
def attribution_spans(t):
    s = t.submissions().select("verse", "producer", "sequence", "first_offset", F.col("records").alias("record_count"))
    return H.attribute_spans(s).select("verse", "offset", "producer", "sequence")


@query("stripe_map", """select event_id, event_id % 4 as stripe, event_id // 4 as local, (event_id // 4) * 4 + event_id % 4 as back from events""")
def stripe_map(t):
    return H.stripes(t["events"].select("event_id"), F.col("event_id"), 4)


@query("stripe_tails", """select stripe, count(*) filter (where local = rn - 1) as contiguous_tail, max(local) + 1 as tail, max(local) + 1 - count(*) as holes
  from (select event_id % 4 as stripe, event_id // 4 as local, row_number() over (partition by event_id % 4 order by event_id // 4) as rn from events where event_id % 301 <> 300) group by all""")
def stripe_tails(t):
    e = H.stripes(t["events"].where("event_id % 301 <> 300").select("event_id"), F.col("event_id"), 4)
    return H.stripe_tails(e.withColumnRenamed("local", "address"), ["stripe"])


_LINE = "l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"


def _lines(t: Tables) -> DataFrame:
    digest = F.sha2(F.concat_ws("|", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.col("l_quantity").cast("long").cast("string"), F.col("l_returnflag")), 256)
    return t["lineitem"].withColumn("digest", digest)


_DIGEST = "sha256(concat_ws('|', l_partkey::varchar, l_suppkey::varchar, l_quantity::bigint::varchar, l_returnflag))"


@query("dedup_first", f"""select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag from lineitem qualify row_number() over (partition by l_orderkey, l_linenumber order by {_LINE}) = 1""")
def dedup_first(t):
    return I.dedup_first(t["lineitem"], ["l_orderkey", "l_linenumber"], _LINE.split(", ")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")


@query("identity_conflicts", f"""select l_orderkey, l_linenumber, count(distinct {_DIGEST}) as digests, count(*) as rows from lineitem group by l_orderkey, l_linenumber having digests > 1""")
def identity_conflicts(t):
    return I.identity_conflicts(_lines(t), ["l_orderkey", "l_linenumber"], "digest")


@query("retry_kinds", f"""with d as (select *, {_DIGEST} as digest from lineitem), f as (select l_orderkey, l_linenumber, min(struct_pack(a := l_partkey, b := l_suppkey, c := l_extendedprice, d := digest)) as first from d group by all)
select case when d.l_partkey = first.a and d.l_suppkey = first.b and d.l_extendedprice = first.c then 'new' when d.digest = first.d then 'retry' else 'conflict' end as kind, l_returnflag, count(*) as n from d join f using (l_orderkey, l_linenumber) group by all""")
def retry_kinds(t):
    r = I.retries(_lines(t), ["l_orderkey", "l_linenumber"], "digest", ["l_partkey", "l_suppkey", "l_extendedprice"])
    return r.groupBy("kind", "l_returnflag").agg(F.count("*").alias("n"))


@query("sequence_gaps", """select producer, verse, seq as after, nxt as before from (select producer, verse, seq, lead(seq) over (partition by producer, verse order by seq) as nxt from ledger where pos % 11 <> 0) where nxt > seq + 1""", ("ledger",))
def sequence_gaps(t):
    return I.sequence_gaps(t.ledger().where("pos % 11 <> 0"), ["producer", "verse"], "seq")


@query("epoch_fencing", """select producer, id, epoch, max(epoch) over w as highest_epoch, epoch < max(epoch) over w as fenced from submissions window w as (partition by producer order by id rows unbounded preceding)""", SUBS)
def epoch_fencing(t):
    return I.fenced(t.submissions(), "producer", "epoch", ["id"], F.floor(F.col("id") / 10_000)).select("producer", "id", "epoch", "highest_epoch", "fenced")


_ADMISSION = f"""with recursive {SQL["submissions"]},
s as (select verse::varchar as verse, id * 2 as pos, producer, epoch, row_number() over (partition by producer, epoch order by id) - 1 as sequence, records, sha256(id::varchar) as digest from submissions),
sent as (select * from s union all select * replace (pos + 1 as pos) from s where pos % 34 = 0 union all select * replace (pos + 1 as pos, 'other' as digest) from s where pos % 46 = 0 and pos % 34 <> 0),
r as (select *, row_number() over (partition by producer order by pos) as rn from sent),
st as (select producer, pos, rn, case when sequence = 0 then epoch else -1 end as top, case when sequence = 0 then 0 else -1 end as highest, case when sequence = 0 then 'Accepted' else 'OutOfSequence' end as outcome from r where rn = 1
  union all select r.producer, r.pos, r.rn, case when r.epoch > top and sequence = 0 then r.epoch else top end,
    case when r.epoch > top and sequence = 0 then 0 when r.epoch = top and sequence = highest + 1 then sequence else highest end,
    case when r.epoch > top then case when sequence = 0 then 'Accepted' else 'OutOfSequence' end when r.epoch < top then 'Fenced' when sequence <= highest - 64 then 'Indeterminate'
      when sequence <= highest then 'Seen' when sequence = highest + 1 then 'Accepted' else 'OutOfSequence' end
  from st join r on r.producer = st.producer and r.rn = st.rn + 1),
acc as (select r.*, sum(records) over (partition by verse order by r.pos)::bigint as next_offset from r join st using (producer, pos) where outcome = 'Accepted')
select r.verse, r.pos, r.producer, r.epoch, r.sequence, r.records, r.digest, case when st.outcome <> 'Seen' then st.outcome when f.digest = r.digest then 'Replay' else 'IdentityConflict' end as outcome,
  coalesce(a.next_offset - r.records, case when f.digest = r.digest then f.next_offset - f.records end) as first_offset, coalesce(a.next_offset, case when f.digest = r.digest then f.next_offset end) as next_offset
from r join st using (producer, pos) left join acc a on a.producer = r.producer and a.pos = r.pos left join acc f on st.outcome = 'Seen' and f.producer = r.producer and f.epoch = r.epoch and f.sequence = r.sequence"""


@query("admission", _ADMISSION)
def admission(t):
    """The state machine over orders as submissions by order number: years are epochs, every 17th order is sent twice, every 23rd with other bytes."""
    s = t.submissions()
    s = H.running(s, ["producer", "epoch"], F.floor(F.col("id") / 10_000), ["id"], "sequence")
    digest = F.sha2(F.col("id").cast("string"), 256)
    sent = F.when(F.col("id") % 17 == 0, F.array(digest, digest)).when(F.col("id") % 23 == 0, F.array(digest, F.lit("other"))).otherwise(F.array(digest))
    s = s.select("verse", "id", "producer", "epoch", "sequence", "records", F.posexplode(sent).alias("nth", "digest"))
    return I.admit(s.withColumn("pos", F.col("id") * 2 + F.col("nth")))


def _items(t: Tables) -> DataFrame:
    return t.history().select("verse", "offset", F.lit(1).alias("records"), F.octet_length("payload").alias("bytes"), "at_us")


def _cut_sql(fresh: str, why: str) -> str:
    """The greedy cuts row by row; fresh: whether an item opens a batch, why: what is told of it, from the batch's records and size with it."""
    return f"""with recursive {SQL["history"]}, items as (select verse, "offset" as o, octet_length(encode(payload)) as bytes, at_us from history),
cut as (select verse, o, bytes, at_us, 0 as batch, 1 as records, bytes as size, at_us as opened, false as fresh, 0 as was_records, 0 as was_size, false as late from items where o = 0
  union all select verse, o, bytes, at_us, batch + fresh::int, case when fresh then 1 else records + 1 end, case when fresh then bytes else size + bytes end, case when fresh then at_us else opened end, fresh, records, size, late
  from (select i.*, batch, records, size, opened, i.at_us - opened >= {3_600_000_000 * 6} as late, {fresh} as fresh from cut join items i on i.verse = cut.verse and i.o = cut.o + 1))
select verse, batch::bigint as batch, min(o) as first, max(o) as last, sum(bytes)::bigint as bytes, max({why}) as why from cut group by verse, batch"""


@query("chunk_sealing", _cut_sql(f"i.at_us - opened >= {3_600_000_000 * 6} or records >= 100 or size >= 900", "case when records >= 100 then 'records' when size >= 900 then 'bytes' else '' end"))
def chunk_sealing(t):
    """Sealed after placing: 100 records, 900 bytes, or an hour."""
    c = I.cuts(_items(t), "verse", "offset", I.cut_after, max_records=100, max_bytes=900, max_age_us=3_600_000_000 * 6)
    return c.groupBy("verse", "batch").agg(F.min("offset").alias("first"), F.max("offset").alias("last"), F.sum("bytes").alias("bytes"), F.max("why").alias("why"))


@query("accumulator_cuts", _cut_sql(f"i.at_us - opened >= {3_600_000_000 * 6} or records + 1 > 100 or size + i.bytes > 900", "case when not fresh then '' when late then 'age' when was_records + 1 > 100 then 'records' else 'bytes' end"))
def accumulator_cuts(t):
    """Flushed before an item that would not fit."""
    c = I.cuts(_items(t), "verse", "offset", I.cut_before, max_records=100, max_bytes=900, max_age_us=3_600_000_000 * 6)
    return c.groupBy("verse", "batch").agg(F.min("offset").alias("first"), F.max("offset").alias("last"), F.sum("bytes").alias("bytes"), F.max("why").alias("why"))


_BLOBS = f"""with recursive {SQL["history"]}, items as (select verse, "offset" as o, octet_length(encode(payload)) as bytes, at_us from history),
cut as (select verse, o, bytes, at_us, 0 as batch, bytes as size, at_us as oldest, case when bytes >= 120 then 'size' else '' end as why from items where o = 0
  union all select verse, o, bytes, at_us, batch, size, oldest, case when size >= 120 then 'size' when at_us - oldest >= {3_600_000_000 * 6} then 'linger' else '' end
  from (select i.*, batch + (why <> '')::int as batch, case when why <> '' then i.bytes else size + i.bytes end as size, case when why <> '' then i.at_us else oldest end as oldest from cut join items i on i.verse = cut.verse and i.o = cut.o + 1))
select verse, batch::bigint as batch, min(o) as first, max(o) as last, sum(bytes)::bigint as bytes, case max(why) when '' then 'drained' else max(why) end as why from cut group by verse, batch"""


@query("blob_cuts", _BLOBS)
def blob_cuts(t):
    """Blobs of 120 bytes or six hours' wait, looked at when an item comes; what is left was drained."""
    c = I.cuts(_items(t), "verse", "offset", I.cut_blob, target_bytes=120, linger_us=3_600_000_000 * 6)
    return I.drained(c, "verse", "offset")


#: What is sent to a log, in SQL that both engines read: some appends fail and are sent again, some are pointers, batches of two or rewrites.
_WHICH = """case when id % 31 = 0 then 'bad_meta' when id % 37 = 0 then 'resend' when id % 41 = 0 then 'rewrite' when id % 43 = 0 then 'early_rewrite' when id % 7 = 0 then 'bad_ref'
  when id % 25 = 0 and records >= 2 then 'bad_batch' when id % 5 = 0 and records >= 2 then 'batch' else 'plain' end"""
_KIND = """case when which in ('batch', 'bad_batch') then 'batch' when which = 'bad_ref' then 'ref' when which = 'rewrite' and nth = 1 or which = 'early_rewrite' and nth = 0 then 'superseding' else 'chunk' end"""
_ITEM = {
    "base": "first_offset + case when item = 0 then 0 when which = 'bad_batch' and nth = 0 then 2 else 1 end",
    "n": "case when kind <> 'batch' then records when item = 0 then 1 else records - 1 end",
    "meta_ok": "not (which = 'bad_meta' and nth = 0 and id % 2 = 0)",
    "cohort_ok": "not (which = 'bad_meta' and nth = 0 and id % 4 = 1)",
    "generation_ok": "not (which = 'bad_meta' and nth = 0 and id % 4 = 3 and id % 3 <> 0)",
    "frame_ok": "not (which = 'bad_meta' and nth = 0 and id % 4 = 3 and id % 3 = 0)",
    "ref_n": "case when kind <> 'batch' then records when item = 0 then 1 else records - 1 end + case when which = 'bad_ref' and nth = 0 and id % 3 = 0 then 1 else 0 end",
    "ref_id_ok": "not (which = 'bad_ref' and nth = 0 and id % 3 = 1)",
    "ref_digest_ok": "not (which = 'bad_ref' and nth = 0 and id % 3 = 2)",
}
_APPENDS = f"""with recursive {SQL["submissions"]}, tried as (select *, {_KIND} as kind from (select *, {_WHICH} as which from submissions), (values (0), (1)) a(nth) where nth = 0 or which not in ('plain', 'batch')),
items as (select verse::varchar as verse, first_offset * 2 + nth as pos, item, kind, {", ".join(f"{e} as {c}" for c, e in _ITEM.items())} from tried, (values (0), (1)) b(item) where item = 0 or kind = 'batch'),
own as (select *, case when kind = 'superseding' then null when not meta_ok then 'sealed_metadata' when not cohort_ok then 'cohort' when not generation_ok then 'generation' when not frame_ok then 'frame' end as seal,
  case when kind not in ('ref', 'batch') then null when ref_n <> n then 'ref_records' when not ref_id_ok then 'ref_id' when not ref_digest_ok then 'ref_digest' end as pointer from items),
app as (select a.verse, a.pos, a.kind, a.base, a.n + coalesce(b.n, 0) as n, a.seal as early, coalesce(a.pointer, b.seal, case when b.base <> a.base + a.n then 'discontinuity' end, b.pointer) as late,
  row_number() over (partition by a.verse order by a.pos) as rn from own a left join own b on b.verse = a.verse and b.pos = a.pos and b.item = 1 where a.item = 0),
st as (select verse, 0::bigint as rn, null::bigint as pos, null::varchar as kind, 0::bigint as base, 0::bigint as n, 'appended' as outcome, 0::bigint as next_offset from (select distinct verse from app)
  union all select verse, rn, pos, kind, base, n, outcome, case when outcome = 'appended' and kind <> 'superseding' then tail + n else tail end
  from (select app.*, st.next_offset as tail, case when app.kind = 'superseding' then case when app.base + app.n <= st.next_offset then 'appended' else 'outside_log' end
    else coalesce(app.early, case when app.base <> st.next_offset then 'discontinuity' end, app.late, 'appended') end as outcome from st join app on app.verse = st.verse and app.rn = st.rn + 1))
select verse, pos, kind, base, n, outcome, next_offset from st where rn > 0"""


@query("append_outcomes", _APPENDS)
def append_outcomes(t):
    s = t.submissions().withColumn("which", F.expr(_WHICH))
    tries = F.when(F.col("which").isin("plain", "batch"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
    s = s.withColumn("nth", F.explode(tries)).withColumn("kind", F.expr(_KIND))
    items = F.when(F.col("kind") == "batch", F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    s = s.withColumn("item", F.explode(items))
    return I.append(I.append_claims(s.select("verse", (F.col("first_offset") * 2 + F.col("nth")).alias("pos"), "item", "kind", *[F.expr(e).alias(c) for c, e in _ITEM.items()])))


_OUTBOX = f"""with recursive {SQL["submissions"]}, ops as (select producer::varchar as journal, sequence * 4 as pos, 'admit' as op, id, case when id % 19 = 0 then 0 else records end as records from submissions
  union all select producer::varchar, sequence * 4 + 1, 'admit', id, records from submissions where id % 7 = 0 union all select producer::varchar, sequence * 4 + 6, 'commit', id, 0 from submissions where id % 3 <> 0),
r as (select *, row_number() over (partition by journal order by pos) as rn from ops),
st as (select journal, 0::bigint as rn, null::bigint as pos, null::varchar as op, null::bigint as id, 'start' as outcome, []::bigint[] as waiting, []::bigint[] as durable, []::bigint[] as done from (select distinct journal from r)
  union all select journal, rn, pos, op, id, outcome, case outcome when 'Admitted' then list_append(waiting, id) when 'Committed' then list_filter(waiting, lambda x: x <> id) else waiting end,
    case outcome when 'Admitted' then list_append(durable, id) else durable end, case when outcome = 'Committed' and not list_contains(done, id) then list_append(done, id) else done end
  from (select r.*, waiting, durable, done, case when r.op = 'commit' then 'Committed' when r.records < 1 then 'Empty' when list_contains(durable, r.id) then 'Duplicate' when len(waiting) >= 2 then 'Full' else 'Admitted' end as outcome
    from st join r on r.journal = st.journal and r.rn = st.rn + 1))
select journal, pos, op, id, outcome, len(waiting) as pending, len(durable) as durable, len(done) as committed, len(waiting) = 0 and len(durable) = len(done) as drained from st where rn > 0"""


@query("continuity_outbox", _OUTBOX)
def continuity_outbox(t):
    """Customers' outboxes with room for two: every seventh order is admitted twice, two of three are committed after the next."""
    s, i, q = t.submissions(), F.col("id"), F.col("sequence")
    op = lambda pos, kind, records: F.struct(pos.alias("pos"), F.lit(kind).alias("op"), records.cast("long").alias("records"))
    ops = F.array(op(q * 4, "admit", F.when(i % 19 == 0, 0).otherwise(F.col("records"))), F.when(i % 7 == 0, op(q * 4 + 1, "admit", F.col("records"))), F.when(i % 3 != 0, op(q * 4 + 6, "commit", F.lit(0))))
    return I.continuity(s.select(F.col("producer").alias("journal"), "id", F.inline(F.array_compact(ops))), 2)


@query("buffer_drop_oldest", """select verse, "offset", bytes <= 40 and n <= 500 and b <= 4000 as kept from (select *, sum(case when bytes <= 40 then 1 else 0 end) over w as n, sum(case when bytes <= 40 then bytes else 0 end) over w as b
  from (select verse, "offset", octet_length(encode(payload)) + producer % 40 as bytes from history) window w as (partition by verse order by "offset" desc rows unbounded preceding))""", HIST)
def buffer_drop_oldest(t):
    h = t.history().select("verse", "offset", (F.octet_length("payload") + F.col("producer") % 40).alias("bytes"))
    kept = F.col("kept") & (F.col("bytes") <= 40)
    return I.drop_oldest(h.withColumn("bytes", F.when(F.col("bytes") <= 40, F.col("bytes")).otherwise(1_000_000)), "verse", "offset", 500, 4000).select("verse", "offset", kept.alias("kept"))


@query("outbox_states", """select producer, sequence, count(distinct digest) filter (where op = 'stage') as versions, max(pos) filter (where op = 'ack') as acked, case when count(distinct digest) filter (where op = 'stage') > 1 then 'conflict' when max(pos) filter (where op = 'ack') is not null then 'retired' else 'staged' end as state
  from (select l_orderkey as producer, l_linenumber as sequence, l_partkey as pos, case when l_returnflag = 'R' then 'ack' else 'stage' end as op, l_suppkey::varchar as digest from lineitem) group by all""")
def outbox_states(t):
    line = t["lineitem"].select(F.col("l_orderkey").alias("producer"), F.col("l_linenumber").alias("sequence"), F.col("l_partkey").alias("pos"), F.when(F.col("l_returnflag") == "R", "ack").otherwise("stage").alias("op"), F.col("l_suppkey").cast("string").alias("digest"))
    return I.outbox(line)


@query("receipt_policy", """select id, given, wanted, given = wanted or (given = 'committed' and wanted = 'spooled') as satisfied from (select id, case when id % 2 = 0 then 'committed' else 'spooled' end as given, case when id % 3 = 0 then 'committed' else 'spooled' end as wanted from submissions)""", SUBS)
def receipt_policy(t):
    s = t.submissions().select("id", F.when(F.col("id") % 2 == 0, "committed").otherwise("spooled").alias("given"), F.when(F.col("id") % 3 == 0, "committed").otherwise("spooled").alias("wanted"))
    return s.withColumn("satisfied", I.receipt_satisfies(F.col("given"), F.col("wanted")))


@query("admission_disposition", """select id, case when id % 7 = 0 then 'Fenced' when id % 5 = 0 then 'RecoveryRequired' when id % 3 = 0 then 'Standby' when epoch < 1995 then 'Fenced' when id % 2 = 0 then 'Serving' else 'RecoveryRequired' end as disposition from submissions""", SUBS)
def admission_disposition(t):
    i = F.col("id")
    return t.submissions().select("id", I.disposition(i % 2 != 0, i % 7 == 0, i % 5 == 0, i % 3 == 0, F.col("epoch"), F.lit(1995)).alias("disposition"))


# --- blobs ---

_LAID = 'laid as (select *, coalesce(sum(length) over (partition by blob order by chunk rows between unbounded preceding and 1 preceding), 0)::bigint as "offset" from chunks)'


@query("blob_layout", f"""{_LAID} select blob, chunk, "offset", length, digest from laid""", ("chunks",))
def blob_layout(t):
    return B.layout(t.chunks(), "blob", ["chunk"], "length").select("blob", "chunk", "offset", "length", "digest")


@query("coalesced_gets", f"""{_LAID}, r as (select *, case when "offset" = lag("offset" + length) over (partition by blob order by chunk) then 0 else 1 end as new from laid where chunk % 7 <> 3),
runs as (select *, sum(new) over (partition by blob order by chunk)::bigint as run from r) select blob, run, min("offset") as "offset", sum(length)::bigint as length, count(*) as refs from runs group by all""", ("chunks",))
def coalesced_gets(t):
    refs = B.layout(t.chunks(), "blob", ["chunk"], "length").withColumn("pos", F.col("chunk")).where("chunk % 7 <> 3")
    return B.coalesced_gets(refs)


_REFS = """refs as (select verse, chunk, chunk as pos, chunk % 3 = 0 as inline, false as rewritten from chunks union all select verse, chunk, chunk + 1000000, chunk % 3 = 0, false from chunks where chunk % 2 = 0
  union all select verse, chunk, chunk + 2000000, false, true from chunks where blob % 2 = 0 union all select verse, chunk, chunk + 3000000, false, true from chunks where chunk % 5 = 0)"""


def _refs(t: Tables) -> DataFrame:
    c = t.chunks().select("verse", "chunk", "blob")
    of = lambda df, up, inline, rewritten: df.select("verse", "chunk", (F.col("chunk") + up).alias("pos"), inline.alias("inline"), F.lit(rewritten).alias("rewritten"))
    third = F.col("chunk") % 3 == 0
    return of(c, 0, third, False).unionByName(of(c.where("chunk % 2 = 0"), 1000000, third, False)).unionByName(of(c.where("blob % 2 = 0"), 2000000, F.lit(False), True)).unionByName(of(c.where("chunk % 5 = 0"), 3000000, F.lit(False), True))


@query("superseding_choice", f"""{_REFS} select verse, chunk, coalesce(min(pos) filter (where rewritten), max(pos) filter (where inline), min(pos)) as chosen, min(pos) as place from refs group by all""", ("chunks",))
def superseding_choice(t):
    return B.superseding(_refs(t))


@query("blob_collectable", """select blob, count(*) as members, count(*) filter (where chunk % 100 < 50 or blob % 2 = 0) as superseded, bool_and(chunk % 100 < 50 or blob % 2 = 0) as collectable from chunks group by all""", ("chunks",))
def blob_collectable(t):
    c = t.chunks()
    return B.collectable(c.select("blob", "chunk"), c.where("chunk % 100 < 50 or blob % 2 = 0").select("chunk"))


@query("rewrite_layout", """select verse, chunk, digest, coalesce(sum(length) over (partition by verse order by chunk rows between unbounded preceding and 1 preceding), 0)::bigint as new_offset from chunks""", ("chunks",))
def rewrite_layout(t):
    """Verse by verse, as the rewrite makes one object for each; long verses are laid out by slices of ids."""
    return H.running(t.chunks(), ["verse"], F.floor(F.col("chunk") / 1000), ["chunk"], "new_offset", F.col("length")).select("verse", "chunk", "digest", "new_offset")


@query("staged_keys", """select chunk, key, starts_with(key, 'staging/') as staging from (select chunk, case when chunk % 2 = 0 then 'staging/' else 'verse/' end || digest as key from chunks)""", ("chunks",))
def staged_keys(t):
    key = F.concat(F.when(F.col("chunk") % 2 == 0, "staging/").otherwise("verse/"), F.col("digest"))
    return t.chunks().select("chunk", key.alias("key")).withColumn("staging", F.col("key").startswith("staging/"))


@query("recovery_tail", """select verse, sequence as slot, first_offset as base, records as n_records, prev is null or prev = first_offset as continues from (select *, lag(first_offset + records) over (partition by verse order by id) as prev from (
  select verse, id, id as sequence, first_offset, records from submissions s where id >= (select max(id) + 1 - 500 from submissions m where m.verse = s.verse)))""", SUBS)
def recovery_tail(t):
    return B.recovery_tail(t.submissions().select("verse", F.col("id").alias("slot"), F.col("first_offset").alias("base"), F.col("records").alias("n_records")), 500)


_TAIL = ("case when id % 101 = 0 then 'b' else 'a' end as cohort", "epoch as generation", "case when id % 97 = 0 then 2 else 1 end as frames")


@query("recovered_tail", f"""kept as (select verse, id as slot, {", ".join(_TAIL)}, first_offset as base, records as n from submissions s where id % 83 <> 0 and id >= (select max(id) + 1 - 500 from submissions m where m.verse = s.verse)),
p as (select *, case when cohort <> 'a' then 'cohort' when generation > 1997 then 'future_generation' when generation < lag(generation) over w then 'generation_regression' when frames <> 1 then 'frames' when base <> lag(base + n) over w then 'discontinuity' end as problem
  from kept window w as (partition by verse order by slot))
select verse, slot, problem from p""", SUBS)
def recovered_tail(t):
    """The last 500 slots of each verse, by the checks of a recovery."""
    s = t.submissions().selectExpr("verse", "id as slot", *_TAIL, "first_offset as base", "records as n")
    ends = s.groupBy(F.col("verse").alias("e_verse")).agg((F.max("slot") + 1).alias("end"))
    s = s.where("slot % 83 <> 0").join(ends, F.col("verse") == F.col("e_verse")).where("slot >= end - 500")
    return R.tail_problems(s, F.lit("a"), F.lit(1997)).select("verse", "slot", "problem")


@query("checkpoint_problems", """select id, case when id % 11 = 0 then 'journal_mismatch' when id % 5 = 0 and first_offset <> 0 then 'missing_resume_hint' end as problem from submissions""", SUBS)
def checkpoint_problems(t):
    i = F.col("id")
    c = t.submissions().select("id", "verse", (F.col("verse") + F.when(i % 11 == 0, 1).otherwise(0)).alias("journal"), F.col("first_offset").alias("next_offset"), F.when(i % 5 != 0, i).alias("hint"))
    return R.checkpoint_problems(c, F.col("verse")).select("id", "problem")


@query("pull_events", """bounds as (select verse, 100 as trim, max("offset") - 9 as tail from history group by all), readers as (select verse, tail, trim, unnest([20, 100, 150, tail - 1, tail, tail + 5]) as next_offset from bounds)
select r.verse, r.next_offset, case when r.next_offset >= tail then 'caught_up' when r.next_offset < trim then 'gap' else 'record' end as event, case when r.next_offset < tail and r.next_offset >= trim then payload end as payload,
  case when r.next_offset >= tail then r.next_offset when r.next_offset < trim then least(trim, tail) else r.next_offset + 1 end as goes_on from readers r left join history h on h.verse = r.verse and h."offset" = r.next_offset""", HIST)
def pull_events(t):
    h = t.history()
    bounds = h.groupBy("verse").agg(F.lit(100).cast("long").alias("trim"), (F.max("offset") - 9).alias("tail"))
    tail = F.col("tail")
    readers = bounds.select("verse", F.posexplode(F.array(F.lit(20).cast("long"), F.lit(100).cast("long"), F.lit(150).cast("long"), tail - 1, tail, tail + 5)).alias("reader", "next_offset"))
    return R.read_next(h, readers, bounds).drop("reader")


@query("payload_resolution", """select doc_id as position, case when doc_id % 17 = 0 then 'missing' when doc_id % 9 = 0 then 'digest' end as problem, case when doc_id % 17 <> 0 and doc_id % 9 <> 0 then sha256(text) end as digest from documents where doc_id % 4 <> 0
  union all select doc_id, null, sha256(text) from documents where doc_id % 4 = 0""")
def payload_resolution(t):
    """Every fourth document inline, others as a reference to a blob of their own; some blobs are gone, some digests wrong."""
    d = t["documents"].select("doc_id", F.col("text").cast("binary").alias("b"))
    ref = F.struct(F.col("doc_id").alias("blob"), F.lit(0).alias("offset"), F.octet_length("b").alias("length"), F.when(F.col("doc_id") % 9 == 0, "sha256:0").otherwise(F.concat(F.lit("sha256:"), F.sha2("b", 256))).alias("digest"))
    log = d.select(F.col("doc_id").alias("position"), F.when(F.col("doc_id") % 4 == 0, "inline").otherwise("ref").alias("kind"), F.when(F.col("doc_id") % 4 == 0, F.col("b")).alias("payload"), F.array(ref).alias("refs"))
    blobs = d.where("doc_id % 17 <> 0").select(F.col("doc_id").alias("blob"), F.col("b").alias("content"))
    return B.resolve(log, blobs).select("position", "problem", F.sha2("content", 256).alias("digest"))


# --- verification ---


@query("three_way_equality", """a as (select verse, "offset", sha256(payload) as producer from history), b as (select verse, "offset", sha256(payload) as canon from history where event_id % 101 <> 0), c as (select verse, "offset", case when event_id % 103 = 0 then 'x' else sha256(payload) end as output from history)
select verse, "offset", producer, canon, output, producer is not null and producer is not distinct from canon and canon is not distinct from output as equal from a full join b using (verse, "offset") full join c using (verse, "offset")""", HIST)
def three_way_equality(t):
    h = t.history().select("verse", "offset", "event_id", F.sha2("payload", 256).alias("digest"))
    return V.three_way(h, h.where("event_id % 101 <> 0"), h.withColumn("digest", F.when(F.col("event_id") % 103 == 0, "x").otherwise(F.col("digest"))))


@query("interval_coverage", """o as (select verse, "offset" from history where event_id % 2003 <> 0 union all select verse, "offset" from history where event_id = 5)
select verse, count(*) as n, count(*) - count(distinct "offset") as duplicates, count(*) = any_value(e) and count(distinct "offset") = any_value(e) and max("offset") = any_value(e) - 1 as exactly_once from o join (select verse, count(*) as e from history group by all) using (verse) group by all""", HIST)
def interval_coverage(t):
    h = t.history()
    o = h.where("event_id % 2003 <> 0").unionByName(h.where("event_id = 5")).select("verse", "offset")
    ends = h.groupBy(F.col("verse").alias("e_verse")).agg((F.max("offset") + 1).alias("end"))
    return V.coverage(o.join(ends, F.col("verse") == F.col("e_verse")), ["verse"], F.lit(0).cast("long"), F.col("end"))


@query("ack_gaps", """select verse, first, "next", following, following = first as duplicate from (select verse, first_offset as first, next_offset as "next", lead(first_offset) over (partition by verse order by first_offset, next_offset) as following from submissions where id % 50 <> 0) where following <> "next" """, SUBS)
def ack_gaps(t):
    return V.span_gaps(t.submissions().where("id % 50 <> 0").select("verse", F.col("first_offset").alias("first"), F.col("next_offset").alias("next")), ["verse"])


@query("ack_continuation", """select verse, pos, first, "next", expected, problem from (select *, case when "next" <= first then 'empty' when expected is not null and first <> expected then 'jump' end as problem from (
  select verse, at_us + id as pos, first_offset as first, case when id % 77 = 0 then first_offset else next_offset end as "next", lag(case when id % 77 = 0 then first_offset else next_offset end) over (partition by verse order by at_us + id) as expected from submissions)) where problem is not null""", SUBS)
def ack_continuation(t):
    a = t.submissions().select("verse", (F.col("at_us") + F.col("id")).alias("pos"), F.col("first_offset").alias("first"), F.when(F.col("id") % 77 == 0, F.col("first_offset")).otherwise(F.col("next_offset")).alias("next"))
    return V.ack_continuation(a, ["verse"], F.floor(F.col("pos") / (7 * 86_400_000_000)))


@query("wal_classification", """select coalesce(s.k, p.k) as id, case when s.k is null then 'corrupt' when p.k is null then 'pending' else 'committed' end as state from (select distinct o_orderkey as k from orders where o_orderkey % 19 <> 0) s full join (select distinct l_orderkey as k from lineitem) p on s.k = p.k""")
def wal_classification(t):
    return V.wal_classification(t["orders"].where("o_orderkey % 19 <> 0").select(F.col("o_orderkey").alias("id")), t["lineitem"].select(F.col("l_orderkey").alias("id")), ["id"])


@query("orphan_progress", """select distinct l_orderkey as id from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderkey % 19 <> 0)""")
def orphan_progress(t):
    return t["lineitem"].select(F.col("l_orderkey").alias("id")).distinct().join(t["orders"].where("o_orderkey % 19 <> 0"), F.col("id") == F.col("o_orderkey"), "left_anti")


@query("generation_boundaries", """g as (select verse, epoch as generation, min(first_offset) as start, sum(records)::bigint as sealed_tail from submissions where id % 1000 <> 0 group by all)
select verse, generation, start + sealed_tail as "end", successor from (select *, lead(start) over (partition by verse order by generation) as successor from g) where successor <> start + sealed_tail""", SUBS)
def generation_boundaries(t):
    g = t.submissions().where("id % 1000 <> 0").groupBy("verse", F.col("epoch").alias("generation")).agg(F.min("first_offset").alias("start"), F.sum("records").alias("sealed_tail"))
    return V.boundaries(g)


@query("shared_producers", """select distinct verse, producer from submissions where epoch = 1995 intersect select distinct verse, producer from submissions where epoch = 1996""", SUBS)
def shared_producers(t):
    s = t.submissions()
    return V.producers_on_both(s.where("epoch = 1995"), s.where("epoch = 1996"))


@query("trace_merge", """select user_id as actor, event_id as line, row_number() over (order by user_id, event_id) as global_seq from events""")
def trace_merge(t):
    e = t["events"].select(F.col("user_id").alias("actor"), F.col("event_id").alias("line"))
    return V.merge_traces(e, F.col("actor"))


@query("digest_crosslinks", """m as (select sha256(text) as digest, max_by(doc_id, doc_id) as message from documents group by all), p as (select sha256(text) as digest, max_by(doc_id, doc_id) as producer from documents where doc_id % 3 <> 0 group by all),
r as (select sha256(text) as digest, max_by(doc_id, doc_id) as readback from documents where doc_id % 5 = 0 group by all), o as (select sha256(text) as digest, max_by(doc_id, doc_id) as output from documents where doc_id % 2 = 0 group by all)
select digest, message, producer, readback, output, output is not null as complete from m join p using (digest) left join r using (digest) left join o using (digest)""".replace("m as", "with m as", 1))
def digest_crosslinks(t):
    d = t["documents"].select(F.sha2("text", 256).alias("digest"), F.col("doc_id").alias("id"), F.col("doc_id").alias("pos"))
    return V.crosslinks(d, d.where("id % 3 <> 0"), d.where("id % 5 = 0"), d.where("id % 2 = 0"))


@query("record_digests", """select event_id, 'sha256:' || sha256(case when json_extract_string(props, '$.k') is null then 'record:1:' || length('user')::varchar || ':useri' || user_id || ':' || props
  else 'record:2:' || '1:ks' || length(json_extract_string(props, '$.k')) || ':' || json_extract_string(props, '$.k') || ',4:useri' || user_id || ':' || props end) as digest from events""")
def record_digests(t):
    kind = "map<string, struct<s: string, i: bigint, b: boolean>>"
    none = F.lit(None)
    user = F.struct(none.cast("string").alias("s"), F.col("user_id").alias("i"), none.cast("boolean").alias("b"))
    k = F.struct(F.get_json_object("props", "$.k").alias("s"), none.cast("bigint").alias("i"), none.cast("boolean").alias("b"))
    attrs = F.when(F.get_json_object("props", "$.k").isNull(), F.create_map(F.lit("user"), user)).otherwise(F.create_map(F.lit("user"), user, F.lit("k"), k)).cast(kind)
    return t["events"].select("event_id", record_digest(attrs, F.col("props")).alias("digest"))


@query("model_density", """select verse, count(*) as records, max("offset") + 1 - count(*) as holes, count(*) - count(distinct "offset") as duplicates from history group by all""", HIST)
def model_density(t):
    """Offsets are dense and none is twice: holes and duplicates are 0."""
    return t.history().groupBy("verse").agg(F.count("*").alias("records"), (F.max("offset") + 1 - F.count("*")).alias("holes"), (F.count("*") - F.count_distinct("offset")).alias("duplicates"))


@query("model_receipt_soundness", """select verse, count(*) as receipts, count(*) filter (where h."offset" is null) as unsound from (select verse, split_part(ack_status, ':', 2)::bigint as "offset", digest from ledger where ack_status <> 'denied' and not unacked) l
  left join (select verse, "offset", sha256(payload) as digest from history) h using (verse, "offset", digest) group by all""", ("ledger",))
def model_receipt_soundness(t):
    """Every committed receipt names a record of its digest."""
    acked = t.ledger().where("ack_status <> 'denied' and not unacked").select("verse", F.split("ack_status", ":")[1].cast("bigint").alias("offset"), "digest")
    h = t.history().select("verse", "offset", F.sha2("payload", 256).alias("digest")).withColumn("there", F.lit(True))
    return acked.join(h, ["verse", "offset", "digest"], "left").groupBy("verse").agg(F.count("*").alias("receipts"), F.count_if(F.col("there").isNull()).alias("unsound"))


@query("model_loss_bound", """select verse, max("offset") + 1 as acknowledged, count(*) filter (where pos % 29 = 0) as lost, count(*) filter (where pos % 29 = 0) <= 100 as within_bound from ledger group by all""", ("ledger",))
def model_loss_bound(t):
    return t.ledger().groupBy("verse").agg((F.max("offset") + 1).alias("acknowledged"), F.count_if(F.col("pos") % 29 == 0).alias("lost"), (F.count_if(F.col("pos") % 29 == 0) <= 100).alias("within_bound"))
