"""Operational analytics: latencies, throughput, outages, request costs, candidates, summaries, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import saturating_sub
from .history import beside


def nearest_rank(df: DataFrame, by: list[str], value: str, quantiles: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """min, max and, for each quantile q, the value at place round((n - 1) * q), half away from zero, of the sorted values.

    Values are counted first, so a group costs its distinct values; their running counts give the places.
    """
    c = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    every = Window.partitionBy(*by)
    c = c.withColumn("_upto", F.sum("_c").over(every.orderBy(value))).withColumn("_n", F.sum("_c").over(every))
    place = lambda q: F.floor((F.col("_n") - 1) * q + 0.5)
    out = [F.min(F.when(F.col("_upto") > place(q), F.col(value))).alias(f"p{q * 100:g}") for q in quantiles]
    return c.groupBy(*by).agg(F.sum("_c").alias("n"), F.min(value).alias("least"), *out, F.max(value).alias("most"))


def throughput(acks: DataFrame, by: list[str], wall_s: Column) -> DataFrame:
    """Records and bytes a second, submissions a second, over the wall time, and records a second and worker."""
    t = acks.groupBy(*by).agg(F.sum("records").alias("records"), F.sum("bytes").alias("bytes"), F.count("*").alias("submissions"), F.count_distinct("worker").alias("workers"), wall_s.alias("wall_s"))
    per = lambda c: F.col(c) / F.nullif(F.col("wall_s"), F.lit(0.0))
    return t.select(*by, "records", "submissions", "workers", "wall_s", per("records").alias("records_s"), per("bytes").alias("bytes_s"), per("submissions").alias("submissions_s"), (per("records") / F.greatest("workers", F.lit(1))).alias("records_s_worker"))


def outages(acks: DataFrame, by: list[str], seconds: float = 1.0, most: int = 5) -> DataFrame:
    """The first gaps of over so many seconds between commits (at_s)."""
    a = beside(acks.select(*by, "at_s"), by, F.floor(F.col("at_s") / 3600), ["at_s"], "from_s", F.col("at_s"))
    gaps = a.select(*by, "from_s", F.col("at_s").alias("to_s")).where(F.col("to_s") - F.col("from_s") > seconds)
    return gaps.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy("from_s", "to_s")).cast("long")).where(F.col("nth") <= most)


COUNTERS = ("data_puts", "data_gets", "authority_puts", "authority_gets")


def request_cost(before_after: DataFrame, by: list[str]) -> DataFrame:
    """Requests a record, by kind and in all, authority's share, and records a batch; columns: before_x, after_x, records, batches."""
    d = {c: saturating_sub(F.col(f"after_{c}"), F.col(f"before_{c}")) for c in COUNTERS}
    total = sum(d.values(), F.lit(0))
    per = [(x / F.nullif("records", F.lit(0))).alias(f"{c}_record") for c, x in d.items()]
    return before_after.select(*by, *per, (total / F.nullif("records", F.lit(0))).alias("requests_record"), ((d["authority_puts"] + d["authority_gets"]) / F.nullif(total, F.lit(0))).alias("authority_share"), F.coalesce(F.col("records") / F.nullif("batches", F.lit(0)), F.lit(0.0)).alias("records_batch"))


def worker_completeness(acks: DataFrame, workers: int) -> DataFrame:
    """Records, submissions and largest sequence of each worker, those without any included."""
    a = acks.groupBy("worker").agg(F.sum("records").alias("records"), F.count("*").alias("submissions"), F.max("sequence").alias("max_sequence"))
    every = acks.sparkSession.range(workers).withColumnRenamed("id", "worker")
    return every.join(a, "worker", "left").select("worker", F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("submissions", F.lit(0)).alias("submissions"), "max_sequence")


def endpoints(acks: DataFrame) -> DataFrame:
    """Submissions by endpoint, with the first place (pos) each was seen at."""
    return acks.groupBy("endpoint").agg(F.count("*").alias("submissions"), F.min("pos").alias("first_seen"))


def producer_summary(ledger: DataFrame) -> DataFrame:
    """Largest sequence, last ack and state, and committed sends of each producer and verse (ledger: seq, pos, ack_status, unacked)."""
    committed = F.col("ack_status").startswith("committed:") & ~F.col("unacked")
    return ledger.groupBy("producer", "verse").agg(F.max("seq").alias("max_seq"), F.max_by("ack_status", "pos").alias("last_ack"), F.count_if(committed).alias("committed"), F.count("*").alias("sends"))


def server_summary(log: DataFrame) -> DataFrame:
    """Of each node (at text, event_kind), the last time up and down, as text, and its state."""
    up, down = F.col("event_kind").isin("available", "recovered", "serving"), F.col("event_kind").isin("down", "denied")
    s = log.groupBy("node").agg(F.max(F.when(up, F.col("at"))).alias("last_up"), F.max(F.when(down, F.col("at"))).alias("last_down"))
    return s.withColumn("up", F.col("last_up").isNotNull() & (F.col("last_down").isNull() | (F.col("last_up") > F.col("last_down"))))


def latest(records: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last published row of each key: last write wins."""
    rest = [c for c in records.columns if c not in key]
    out = records.groupBy(*key).agg(F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("_last"))
    return out.select(*[F.col(c) if c in key else F.col(f"_last.{c}").alias(c) for c in records.columns])


def fresh(now_ms: Column) -> Column:
    """Whether a directory record (published_at_ms, valid_for_ms) still holds."""
    return now_ms < F.col("published_at_ms") + F.col("valid_for_ms")


def rank_candidates(directory: DataFrame, by: list[str], now_ms: Column) -> DataFrame:
    """Place of each record: fresh ones first, then those that claim to serve, then the youngest, then by owner."""
    age = saturating_sub(now_ms, F.col("published_at_ms"))
    d = directory.withColumn("fresh", fresh(now_ms)).withColumn("age_ms", age)
    return d.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("fresh").desc(), F.col("serving").desc(), "age_ms", "owner")).cast("long"))


def capability(directory: DataFrame, by: list[str], now_ms: Column, needed: int) -> DataFrame:
    """Fresh and eligible (fresh and able to serve) records of each stream, and whether there are enough."""
    eligible = fresh(now_ms) & F.col("serving")
    d = directory.groupBy(*by).agg(F.count_if(fresh(now_ms)).alias("fresh"), F.count_if(eligible).alias("eligible"))
    return d.withColumn("verdict", F.when(F.col("eligible") >= needed, "satisfied").when(F.col("fresh") >= needed, "not_serving").otherwise("missing"))


def availability(published: Column, fresh_: Column, naming: Column) -> Column:
    """One of four texts, by how many records were published, are fresh, and name the stream."""
    return F.when(published == 0, "never published").when(fresh_ == 0, "all expired").when(naming == 0, "none names it").otherwise(F.concat(naming.cast("string"), F.lit(" heartbeating")))


def suite_code(reports: DataFrame, dry_run: bool = False) -> DataFrame:
    """Exit code: 0 for a dry run, 3 if a report failed, 4 if one is inconclusive or exited with 4, else 0."""
    failed, open_ = F.bool_or(F.col("verdict") == "fail"), F.bool_or((F.col("verdict") == "inconclusive") | (F.col("exit_code") == 4))
    return reports.agg(F.when(F.lit(dry_run), 0).when(F.coalesce(failed, F.lit(False)), 3).when(F.coalesce(open_, F.lit(False)), 4).otherwise(0).alias("code"))


def coverage_matrix(catalog: DataFrame, reports: DataFrame, forced: tuple[int, ...] = ()) -> DataFrame:
    """Verdict of each scenario family (family, scenario) by its last report (scenario, pos, verdict); not_run if none; forced families pass."""
    last = reports.groupBy("scenario").agg(F.max_by("verdict", "pos").alias("verdict"))
    return catalog.join(last, "scenario", "left").withColumn("verdict", F.when(F.col("family").isin(*forced), "pass").otherwise(F.coalesce("verdict", F.lit("not_run"))))


#: The first of these parts in a source's name tells its layer.
LAYERS = (("producer", "producer"), ("server", "server"), ("object", "objects"), ("parquet", "parquet"), ("iceberg", "iceberg"), ("manifest", "consumer"), ("register", "consumer"))


def claim_layer(source: Column, rules: tuple[tuple[str, str], ...] = LAYERS) -> Column:
    """The layer that a verdict's source belongs to; missing without one, bundle if no rule holds.  rules: for a deployment's own names."""
    out = F.when(F.coalesce(source, F.lit("")).isin("", "not supplied"), "missing")
    for part, layer in rules:
        out = out.when(source.contains(part), layer)
    return out.otherwise("bundle")


def claim_matrix(verdicts: DataFrame, table_state: Column, oracle: Column, rules: tuple[tuple[str, str], ...] = LAYERS) -> DataFrame:
    """A row for each verdict (claim, verdict, source) with its layer, one for the table's presence and one for the oracle's.

    table_state: verified, absent or another; oracle: present or another.
    """
    spark = verdicts.sparkSession
    state = F.when(table_state == "verified", "pass").when(table_state == "absent", "observed").otherwise("not_run")
    given = F.when(oracle == "present", "observed").otherwise("not_run")
    none = F.lit(None).cast("string")
    rows = verdicts.select("claim", "verdict", "source", claim_layer(F.col("source"), rules).alias("layer"))
    rows = rows.unionByName(spark.range(1).select(F.lit("table presence").alias("claim"), state.alias("verdict"), none.alias("source"), F.lit("iceberg").alias("layer")))
    return rows.unionByName(spark.range(1).select(F.lit("oracle").alias("claim"), given.alias("verdict"), none.alias("source"), F.lit("oracle").alias("layer")))


def live(operations: DataFrame, key: str) -> DataFrame:
    """The records that are left of a directory's operations (key, at, op publish|withdraw, ...): the last one of each key, unless it withdrew."""
    return latest(operations, [key], ["at", "op"]).where("op = 'publish'").drop("op")


def evidence_problems(verdicts: DataFrame, sources: DataFrame) -> DataFrame:
    """Verdicts (id, verdict, source) without declared evidence: pass and observed need a real source, others may be synthetic."""
    s = sources.select(F.col("source").alias("s_source"), "synthetic")
    j = verdicts.join(s, F.col("source") == F.col("s_source"), "left")
    problem = F.when(F.col("s_source").isNull() & F.col("verdict").isin("pass", "observed"), "undeclared").when(F.col("synthetic") & ~F.col("verdict").isin("not_run", "inconclusive"), "synthetic")
    return j.withColumn("problem", problem).where("problem is not null").select("id", "verdict", "source", "problem")


def event_feed(failovers: DataFrame, server_log: DataFrame, summary: DataFrame, most: int = 32) -> DataFrame:
    """The first events of three feeds (at, kind, text)."""
    return failovers.unionByName(server_log).unionByName(summary).orderBy("at", "kind", "text").limit(most)
