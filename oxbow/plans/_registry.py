"""The registry of queries, and the log concepts that the star schema's tables stand for, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import history as H

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """A folder's tables, and what stands for log concepts."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def history(self) -> DataFrame:
        """Verses are event types in the order of time; offsets are dense."""
        e = self["events"].select(F.col("event_type").alias("verse"), F.col("props").alias("payload"), micros("ts").alias("at_us"), "event_id", F.col("user_id").alias("producer"), "value")
        return H.dense_offsets(e, "verse", F.floor(F.col("at_us") / 3_600_000_000), ["at_us", "event_id"])

    def submissions(self) -> DataFrame:
        """Orders are submissions of their customers, line items their records; verses are sixteenths of the customers."""
        n = self["lineitem"].groupBy("l_orderkey").agg(F.count("*").alias("records"))
        o = self["orders"].join(n, F.col("o_orderkey") == F.col("l_orderkey"))
        o = o.select((F.col("o_custkey") % 16).alias("verse"), F.col("o_custkey").alias("producer"), F.year("o_orderdate").alias("epoch"), F.col("o_orderkey").alias("id"), "records", micros("o_orderdate").alias("at_us"), F.col("o_totalprice").alias("latency"), F.col("o_orderpriority").alias("endpoint"))
        o = H.running(o, ["producer"], F.floor(F.col("at_us") / (365 * 86_400_000_000)), ["at_us", "id"], "sequence")
        return H.running(o, ["verse"], F.floor(F.col("at_us") / (7 * 86_400_000_000)), ["at_us", "id"], "first_offset", F.col("records")).withColumn("next_offset", F.col("first_offset") + F.col("records"))

    def chunks(self) -> DataFrame:
        """Documents are chunks; a hundred ids share a blob."""
        d = self["documents"].select(F.col("doc_id").alias("chunk"), F.floor(F.col("doc_id") / 100).alias("blob"), F.col("source").alias("verse"), F.octet_length("text").cast("long").alias("length"), F.sha2("text", 256).alias("digest"))
        return d

    def ledger(self) -> DataFrame:
        """Sends: errors were denied, others committed."""
        h = self.history()
        h = H.running(h, ["producer", "verse"], F.floor(F.col("at_us") / 86_400_000_000), ["at_us", "event_id"], "seq")
        status = F.when(F.col("verse") == "error", "denied").otherwise(F.concat(F.lit("committed:"), F.col("offset").cast("string"), F.lit(":"), (F.col("offset") + 1).cast("string")))
        return h.select("producer", "verse", "seq", F.col("event_id").alias("pos"), "offset", F.sha2("payload", 256).alias("digest"), status.alias("ack_status"), (F.col("event_id") % 13 == 0).alias("unacked"), "at_us")

    def directory(self) -> DataFrame:
        """Suppliers announce that they serve their nation's stream; how long that holds comes from their balance."""
        s = self["supplier"].join(self["nation"], F.col("s_nationkey") == F.col("n_nationkey")).join(self["region"], F.col("n_regionkey") == F.col("r_regionkey"))
        return s.select(F.col("s_name").alias("owner"), F.col("r_name").alias("canon"), F.col("n_name").alias("verse"), (F.col("s_suppkey") * 100).alias("published_at_ms"), F.greatest(F.floor("s_acctbal"), F.lit(0)).alias("valid_for_ms"), (F.col("s_suppkey") % 3 != 0).alias("serving"))

    def samples(self) -> DataFrame:
        e = self["events"]
        labels = F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("k"), F.get_json_object("props", "$.k"), F.lit("uid"), F.col("event_id").cast("string"))
        return e.select("event_id", F.col("event_type").alias("name"), labels.alias("labels"), "value", F.floor(micros("ts") / 1000).alias("timestamp_ms"), (F.col("event_id") % 50).alias("scrape"))


def micros(ts: str):
    """Microseconds since the epoch of a timestamp as written, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({ts} as timestamp_ntz))")


#: The same in DuckDB's SQL.
SQL = {
    "history": """history as (select event_type as verse, props as payload, epoch_us(ts) as at_us, event_id, user_id as producer, value,
  row_number() over (partition by event_type order by ts, event_id) - 1 as "offset" from events)""",
    "submissions": """submissions as (select *, first_offset + records as next_offset from (select *, coalesce(sum(records) over (partition by verse order by at_us, id rows between unbounded preceding and 1 preceding), 0)::bigint as first_offset,
  row_number() over (partition by producer order by at_us, id) - 1 as sequence from (select o_custkey % 16 as verse, o_custkey as producer, year(o_orderdate)::int as epoch, o_orderkey as id, count(*) as records, epoch_us(o_orderdate) as at_us,
  o_totalprice as latency, o_orderpriority as endpoint from orders join lineitem on o_orderkey = l_orderkey group by all)))""",
    "chunks": """chunks as (select doc_id as chunk, cast(floor(doc_id / 100) as bigint) as blob, source as verse, octet_length(encode(text))::bigint as length, sha256(text) as digest from documents)""",
    "ledger": """ledger as (select producer, verse, row_number() over (partition by producer, verse order by at_us, event_id) - 1 as seq, event_id as pos, "offset", sha256(payload) as digest,
  case when verse = 'error' then 'denied' else 'committed:' || "offset" || ':' || ("offset" + 1) end as ack_status, event_id % 13 = 0 as unacked, at_us from history)""",
    "directory": """directory as (select s_name as owner, r_name as canon, n_name as verse, s_suppkey * 100 as published_at_ms, greatest(cast(floor(s_acctbal) as bigint), 0) as valid_for_ms, s_suppkey % 3 <> 0 as serving
  from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey)""",
    "samples": """samples as (select event_id, event_type as name, user_id::varchar as l_user, json_extract_string(props, '$.k') as l_k, event_id::varchar as l_uid, value, epoch_us(ts) // 1000 as timestamp_ms, event_id % 50 as scrape from events)""",
}
_NEEDS = {"ledger": ["history"]}


def with_(*names: str, rest: str) -> str:
    """rest, the tail of a WITH or a SELECT, after the common tables it needs."""
    have: list[str] = []
    for n in names:
        have += [x for x in [*_NEEDS.get(n, []), n] if x not in have]
    return "with " + ",\n".join(SQL[n] for n in have) + ("\n" if rest.lstrip().lower().startswith(("select", "from")) else ",\n") + rest


def query(name: str, sql: str | None = None, uses: tuple[str, ...] = ()):
    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            ORACLE_SQL[name] = with_(*uses, rest=sql) if uses else sql
        return f

    return add
