"""Verification: what was produced, committed and materialized are the same records exactly once.

Checks return their violations: no rows means they pass.  assert_empty turns one into an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .history import beside, running


def assert_empty(violations: DataFrame, what: str) -> None:
    if rows := violations.limit(5).collect():
        raise AssertionError(f"{what}: {rows}")


def three_way(producer: DataFrame, canon: DataFrame, output: DataFrame) -> DataFrame:
    """Digests of each (verse, offset) by the three sides (verse, offset, digest), and whether they are equal."""
    a = producer.select("verse", "offset", F.col("digest").alias("producer"))
    b = canon.select("verse", "offset", F.col("digest").alias("canon"))
    c = output.select("verse", "offset", F.col("digest").alias("output"))
    j = a.join(b, ["verse", "offset"], "full").join(c, ["verse", "offset"], "full")
    equal = F.col("producer").isNotNull() & F.col("producer").eqNullSafe(F.col("canon")) & F.col("canon").eqNullSafe(F.col("output"))
    return j.withColumn("equal", equal)


def coverage(offsets: DataFrame, by: list[str], first: Column, next_: Column) -> DataFrame:
    """Whether offsets cover [first, next) exactly once; an inverted range never is."""
    found = offsets.groupBy(*by).agg(F.count("*").alias("n"), F.count_distinct("offset").alias("distinct"), F.min("offset").alias("least"), F.max("offset").alias("most"), F.min(first).alias("first"), F.min(next_).alias("next"))
    span = F.col("next") - F.col("first")
    whole = (span >= 0) & (F.col("n") == span) & (F.col("distinct") == span) & ((span == 0) | ((F.col("least") == F.col("first")) & (F.col("most") == F.col("next") - 1)))
    return found.select(*by, "n", (F.col("n") - F.col("distinct")).alias("duplicates"), whole.alias("exactly_once"))


def span_gaps(spans: DataFrame, by: list[str]) -> DataFrame:
    """Neighbouring spans (first, next), sorted, that don't meet: a duplicate starts where the one before did, and is a gap too."""
    s = beside(spans.select(*by, "first", "next"), by, F.floor(F.col("first") / 10_000), ["first", "next"], "following", F.col("first"), ahead=True)
    return s.where("following <> next").withColumn("duplicate", F.col("following") == F.col("first"))


def ack_continuation(acks: DataFrame, by: list[str], slice_: Column) -> DataFrame:
    """Acks (pos, first, next) that are empty or don't go on from the one that arrived before; slice_ rises with pos."""
    a = beside(acks, by, slice_, ["pos"], "expected", F.col("next"))
    problem = F.when(F.col("next") <= F.col("first"), "empty").when(F.col("expected").isNotNull() & (F.col("first") != F.col("expected")), "jump")
    return a.withColumn("problem", problem).where("problem is not null").select(*by, "pos", "first", "next", "expected", "problem")


def wal_classification(submissions: DataFrame, progress: DataFrame, key: list[str]) -> DataFrame:
    """committed, pending (no progress) or corrupt (progress without a submission) for each key."""
    s = submissions.select(*key).distinct().withColumn("logged", F.lit(True))
    p = progress.select(*key).distinct().withColumn("done", F.lit(True))
    state = F.when(F.col("logged").isNull(), "corrupt").when(F.col("done").isNull(), "pending").otherwise("committed")
    return s.join(p, key, "full").select(*key, state.alias("state"))


def boundaries(generations: DataFrame) -> DataFrame:
    """Generations (verse, generation, start, sealed_tail) whose successor doesn't start where they end."""
    w = Window.partitionBy("verse").orderBy("generation")
    g = generations.select("verse", "generation", (F.col("start") + F.col("sealed_tail")).alias("end"), F.lead("start").over(w).alias("successor"))
    return g.where("successor <> end")


def producers_on_both(before: DataFrame, after: DataFrame) -> DataFrame:
    return before.select("verse", "producer").intersect(after.select("verse", "producer"))


def merge_traces(traces: DataFrame, slice_: Column) -> DataFrame:
    """Traces (actor, line) one after the other, numbered from 1."""
    return running(traces.withColumn("_all", F.lit(0)), ["_all"], slice_, ["actor", "line"], "global_seq").withColumn("global_seq", F.col("global_seq") + 1).drop("_all")


def crosslinks(messages: DataFrame, ledger: DataFrame, readback: DataFrame, outputs: DataFrame) -> DataFrame:
    """Each digest that has a message and a producer's row, with what else knows it; of a digest's rows the last (pos) counts."""

    def last(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("digest").agg(F.max_by("id", "pos").alias(name))

    j = last(messages, "message").join(last(ledger, "producer"), "digest").join(last(readback, "readback"), "digest", "left").join(last(outputs, "output"), "digest", "left")
    return j.withColumn("complete", F.col("output").isNotNull())


def payloads_match(seen: Column, required: Column, optional: Column) -> Column:
    """Whether seen is required, or required with optional put in at one place."""
    at = F.sequence(F.lit(0), F.size(required))
    with_it = F.exists(at, lambda k: seen == F.concat(F.slice(required, F.lit(1), k), F.array(optional), F.slice(required, k + 1, F.size(required))))
    return (seen == required) | with_it
