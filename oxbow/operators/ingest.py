"""Ingest: retries, fencing, batch cuts, receipts, outboxes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .history import running


def dedup_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; a struct minimum, partially aggregated, so no key is gathered."""
    rest = [c for c in df.columns if c not in key]
    first = F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("_first")
    out = df.groupBy(*key).agg(first)
    return out.select(*[F.col(c) if c in key else F.col(f"_first.{c}").alias(c) for c in df.columns])


def identity_conflicts(df: DataFrame, key: list[str], digest: str) -> DataFrame:
    """Keys that came with more than one digest."""
    return df.groupBy(*key).agg(F.count_distinct(digest).alias("digests"), F.count("*").alias("rows")).where("digests > 1")


def retries(df: DataFrame, key: list[str], digest: str, order: list[str]) -> DataFrame:
    """What each row is: new, retry (the first row's digest again) or conflict."""
    first = df.groupBy(*key).agg(F.min(F.struct(*order, digest)).alias("_first")).select(*[F.col(c).alias(f"_k_{c}") for c in key], "_first")
    on = F.lit(True)
    for c in key:
        on = on & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    same = F.lit(True)
    for c in order:
        same = same & F.col(c).eqNullSafe(F.col(f"_first.{c}"))
    kind = F.when(same, "new").when(F.col(digest).eqNullSafe(F.col(f"_first.{digest}")), "retry").otherwise("conflict")
    return df.join(first, on).withColumn("kind", kind).drop("_first", *[f"_k_{c}" for c in key])


def sequence_gaps(df: DataFrame, by: list[str], seq: str) -> DataFrame:
    """Where a producer's sequence skips: by, after, before."""
    w = Window.partitionBy(*by).orderBy(seq)
    return df.select(*by, seq).distinct().select(*by, F.col(seq).alias("after"), F.lead(seq).over(w).alias("before")).where("before > after + 1")


def fenced(df: DataFrame, producer: str, epoch: str, order: list[str], slice_: Column) -> DataFrame:
    """df with fenced: whether a higher epoch of the producer came before the row; slice_ rises with order."""
    df = running(df, [producer], slice_, order, "_before", F.col(epoch), largest=True)
    df = df.withColumn("highest_epoch", F.greatest(epoch, F.col("_before").cast(df.schema[epoch].dataType))).drop("_before")
    return df.withColumn("fenced", F.col(epoch) < F.col("highest_epoch"))


class Admission:
    """The rules for one verse's submissions, in order: the outcome of each, and the offsets that accepted ones get.

    One without records is Empty, whatever else it says.  An epoch below the producer's is Fenced; a higher one starts at sequence 0.  A sequence already seen is a Replay, with the
    first receipt, if its digest is the same, an IdentityConflict if not, and Indeterminate once the window of the last
    `window` sequences has passed it.  Any other but the next is OutOfSequence.
    """

    def __init__(self, next_offset: int = 0, window: int = 64, producers: dict | None = None):
        self.next_offset, self.window, self.producers = next_offset, window, producers or {}

    def admit(self, producer, epoch: int, sequence: int, records: int, digest: str) -> tuple[str, int | None, int | None]:
        if records < 1:
            return "Empty", None, None
        known = self.producers.get(producer)
        if known is None or epoch > known["epoch"]:
            known = {"epoch": epoch, "highest": -1, "seen": {}}
            if sequence != 0:
                return "OutOfSequence", None, None
        elif epoch < known["epoch"]:
            return "Fenced", None, None
        elif sequence <= known["highest"]:
            first = known["seen"].get(sequence)
            if first is None:
                return "Indeterminate", None, None
            return ("Replay", first[1], first[2]) if first[0] == digest else ("IdentityConflict", None, None)
        elif sequence != known["highest"] + 1:
            return "OutOfSequence", None, None
        first, self.next_offset = self.next_offset, self.next_offset + records
        known["highest"] = sequence
        known["seen"][sequence] = (digest, first, self.next_offset)
        known["seen"].pop(sequence - self.window, None)
        self.producers[producer] = known
        return "Accepted", first, self.next_offset


ADMITTED = "verse string, pos long, producer long, epoch int, sequence long, records long, digest string, outcome string, first_offset long, next_offset long"


def admit(submissions: DataFrame, window: int = 64) -> DataFrame:
    """Outcome and offsets of each submission (verse, pos, producer, epoch, sequence, records, digest), verse by verse in the order of pos.

    The rules are sequential inside a verse; rows stream through a task, which keeps producers' windows only.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        verse, rules = None, Admission(window=window)
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if r.verse != verse:
                    verse, rules = r.verse, Admission(window=window)
                out.append(rules.admit(r.producer, r.epoch, r.sequence, r.records, r.digest))
            told = pd.DataFrame(out, columns=["outcome", "first_offset", "next_offset"], index=batch.index)
            yield pd.concat([batch, told], axis=1).astype({"first_offset": "Int64", "next_offset": "Int64"})

    cols = ["verse", "pos", "producer", "epoch", "sequence", "records", "digest"]
    parts = int(submissions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = submissions.select(F.col("verse").cast("string"), "pos", F.col("producer").cast("long"), F.col("epoch").cast("int"), F.col("sequence").cast("long"), F.col("records").cast("long"), "digest")
    return ordered.repartition(parts, "verse").sortWithinPartitions("verse", "pos").select(*cols).mapInPandas(run, ADMITTED)


def cut_after(sizes: Iterator[tuple[int, int, int]], max_records: int, max_bytes: int, max_age_us: int) -> Iterator[tuple[int, str]]:
    """(batch number, why it was sealed after this item, or '') for items (records, bytes, at_us): the seal is tested after placing.

    A batch older than max_age_us is sealed before the item that comes that late.
    """
    n = records = size = 0
    opened = None
    for r, b, at in sizes:
        if opened is not None and at - opened >= max_age_us:
            n, records, size, opened = n + 1, 0, 0, None
        opened = at if opened is None else opened
        records, size = records + r, size + b
        why = "records" if records >= max_records else "bytes" if size >= max_bytes else ""
        yield n, why
        if why:
            n, records, size, opened = n + 1, 0, 0, None


def cut_before(sizes: Iterator[tuple[int, int, int]], max_records: int, max_bytes: int, max_age_us: int) -> Iterator[tuple[int, str]]:
    """As cut_after, but an item that would exceed a bound opens a new batch; one item alone may exceed it."""
    n = records = size = 0
    opened = None
    for r, b, at in sizes:
        why = ""
        if opened is not None:
            why = "age" if at - opened >= max_age_us else "records" if records + r > max_records else "bytes" if size + b > max_bytes else ""
        if why:
            n, records, size, opened = n + 1, 0, 0, None
        opened = at if opened is None else opened
        records, size = records + r, size + b
        yield n, why


def cuts(df: DataFrame, by: str, order: str, rule, **bounds: int) -> DataFrame:
    """df's by, order, records, bytes, at_us with batch and why; greedy cuts are sequential inside by, so rows stream through."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, feed, told = object(), None, None
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if r[0] != key:
                    key, feed = r[0], []
                    told = rule(iter(lambda f=feed: f.pop(0), None), **bounds)
                feed.append((r[2], r[3], r[4]))
                out.append(next(told))
            yield pd.concat([batch, pd.DataFrame(out, columns=["batch", "why"], index=batch.index)], axis=1)

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = df.select(F.col(by).cast("string"), F.col(order).cast("long"), F.col("records").cast("long"), F.col("bytes").cast("long"), F.col("at_us").cast("long"))
    return cols.repartition(parts, by).sortWithinPartitions(by, order).mapInPandas(run, f"{by} string, {order} long, records long, bytes long, at_us long, batch long, why string")


def disposition(sealed: Column, fenced_: Column, recovering: Column, standby: Column, epoch: Column, current: Column) -> Column:
    """What a server says to a submission, by the first rule that holds."""
    return F.when(fenced_, "Fenced").when(recovering, "RecoveryRequired").when(standby, "Standby").when(epoch < current, "Fenced").when(~sealed, "Serving").otherwise("RecoveryRequired")


def receipt_satisfies(given: Column, wanted: Column) -> Column:
    """A committed receipt satisfies a spooled one's need, not the other way round."""
    return (given == wanted) | ((given == "committed") & (wanted == "spooled"))


def outbox(transcript: DataFrame) -> DataFrame:
    """State of each staged sequence (producer, sequence, pos, op stage|ack, digest): conflict if bytes differ, retired once acked."""
    t = transcript.groupBy("producer", "sequence").agg(F.count_distinct(F.when(F.col("op") == "stage", F.col("digest"))).alias("versions"), F.max(F.when(F.col("op") == "ack", F.col("pos"))).alias("acked"))
    return t.withColumn("state", F.when(F.col("versions") > 1, "conflict").when(F.col("acked").isNotNull(), "retired").otherwise("staged"))


def drop_oldest(df: DataFrame, by: str, order: str, max_records: int, max_bytes: int) -> DataFrame:
    """Whether each item (bytes) is still in a buffer that never drained: the longest suffix within both caps; items beyond the byte cap never get in.

    order is a number; its thousands are the slices, taken from the end.
    """
    fits = F.col("bytes") <= max_bytes
    last_first = ([by], -F.floor(F.col(order) / 1000), [F.col(order).desc()])
    one, size = F.when(fits, 1).otherwise(0), F.when(fits, F.col("bytes")).otherwise(0)
    df = running(running(df, *last_first, "_n", one), *last_first, "_b", size)
    kept = fits & (F.col("_n") + one <= max_records) & (F.col("_b") + size <= max_bytes)
    return df.withColumn("kept", kept).drop("_n", "_b")


def cut_blob(sizes: Iterator[tuple[int, int, int]], target_bytes: int, linger_us: int, polled: bool = False) -> Iterator[tuple[int, str]]:
    """As cut_after for blobs: cut once an item takes them to target_bytes, or once the oldest one's wait has reached linger_us.

    Without a timer the wait is looked at when an item comes, which still gets in; polled: a timer has cut before that.  What is
    left at the end is drained (`drained`).
    """
    n = size = 0
    oldest = None
    for _, b, at in sizes:
        if polled and oldest is not None and at - oldest >= linger_us:
            n, size, oldest = n + 1, 0, None
        oldest = at if oldest is None else oldest
        size += b
        why = "size" if size >= target_bytes else "linger" if at - oldest >= linger_us else ""
        yield n, why
        if why:
            n, size, oldest = n + 1, 0, None


def drained(cut: DataFrame, by: str, order: str) -> DataFrame:
    """A row for each batch of cut (by, order, bytes, batch, why): first, last, bytes, and why; the last one without a reason was drained, others lingered."""
    batches = cut.groupBy(by, "batch").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.sum("bytes").alias("bytes"), F.max("why").alias("why"))
    ends = cut.groupBy(F.col(by).alias("_by")).agg(F.max(order).alias("_end"))
    open_ = F.when(F.col("last") == F.col("_end"), "drained").otherwise("linger")
    out = batches.join(ends, F.col(by).eqNullSafe(F.col("_by"))).withColumn("why", F.when(F.col("why") == "", open_).otherwise(F.col("why")))
    return out.drop("_by", "_end")


def append_claims(items: DataFrame) -> DataFrame:
    """One row for each append to a log: what its items (verse, pos, item, kind, base, n, sealed_*, ref_*) say without the log's end.

    kind: chunk, ref, batch or superseding; meta_ok, cohort_ok, generation_ok, frame_ok: whether the sealed chunk's id and digest,
    cohort, generation and single frame are the writer's; ref_n, ref_id_ok, ref_digest_ok: what its pointer says (kind chunk: ignored).
    early is the first item's problem that comes before its offset is looked at, late the first problem after that: an item's own
    checks in order, and for later items of a batch whether they go on from the one before.
    """
    w = Window.partitionBy("verse", "pos").orderBy("item")
    expected = F.lag(F.col("base") + F.col("n")).over(w)
    early = F.when(~F.col("meta_ok"), "sealed_metadata").when(~F.col("cohort_ok"), "cohort").when(~F.col("generation_ok"), "generation").when(~F.col("frame_ok"), "frame")
    early = F.when(F.col("kind") != "superseding", early)
    pointer = F.when(F.col("kind").isin("ref", "batch"), F.when(F.col("ref_n") != F.col("n"), "ref_records").when(~F.col("ref_id_ok"), "ref_id").when(~F.col("ref_digest_ok"), "ref_digest"))
    i = items.withColumn("_expected", expected).withColumn("_early", early).withColumn("_pointer", pointer)
    jump = F.when(F.col("_expected") != F.col("base"), "discontinuity")
    late = F.when(F.col("_expected").isNull(), F.col("_pointer")).otherwise(F.coalesce("_early", jump, "_pointer"))
    i = i.withColumn("_late", late)
    return i.groupBy("verse", "pos").agg(
        F.min_by("kind", "item").alias("kind"),
        F.min_by("base", "item").alias("base"),
        F.sum("n").alias("n"),
        F.max(F.when(F.col("_expected").isNull(), F.col("_early"))).alias("early"),
        F.min_by("_late", F.when(F.col("_late").isNotNull(), F.col("item"))).alias("late"),
    )


APPENDED = "verse string, pos long, kind string, base long, n long, outcome string, next_offset long"


def append(claims: DataFrame) -> DataFrame:
    """Outcome of each append (append_claims) in the order of pos, and the log's end after it: appended, or the first check that failed.

    An append starts where the log ends and moves the end on; one that fails leaves it.  A superseding pointer names records that
    are in the log already (else outside_log) and leaves the end.  Greedy inside a verse, so rows stream through a task, which keeps one number.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        verse, end = None, 0
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if r.verse != verse:
                    verse, end = r.verse, 0
                if r.kind == "superseding":
                    out.append(("appended" if r.base + r.n <= end else "outside_log", end))
                    continue
                problem = r.early or ("discontinuity" if r.base != end else None) or r.late
                end += 0 if problem else r.n
                out.append((problem or "appended", end))
            told = pd.DataFrame(out, columns=["outcome", "next_offset"], index=batch.index)
            yield pd.concat([batch[["verse", "pos", "kind", "base", "n"]], told], axis=1)

    parts = int(claims.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    c = claims.select(F.col("verse").cast("string"), F.col("pos").cast("long"), "kind", F.col("base").cast("long"), F.col("n").cast("long"), "early", "late")
    return c.repartition(parts, "verse").sortWithinPartitions("verse", "pos").mapInPandas(run, APPENDED)


class Continuity:
    """A journal's local outbox: admits what is new while there is room, and lets go of what was committed."""

    def __init__(self, max_pending: int):
        self.max_pending = max(max_pending, 1)
        self.pending: dict = {}  # in the order of admission
        self.durable: set = set()
        self.committed: set = set()

    def admit(self, identity, records: int) -> str:
        if records < 1:
            return "Empty"
        if identity in self.durable:
            return "Duplicate"
        if len(self.pending) >= self.max_pending:
            return "Full"
        self.durable.add(identity)
        self.pending[identity] = None
        return "Admitted"

    def commit(self, identity) -> str:
        self.committed.add(identity)
        self.pending.pop(identity, None)
        return "Committed"

    @property
    def drained(self) -> bool:
        return not self.pending and len(self.durable) == len(self.committed)


OUTBOX = "journal string, pos long, op string, id long, outcome string, pending long, durable long, committed long, drained boolean"


def continuity(ops: DataFrame, max_pending: int) -> DataFrame:
    """Outcome of each operation (journal, pos, op admit|commit, id, records) in the order of pos, and the outbox's counts after it.

    Whether there is room depends on everything before, so a journal's rows stream through a task, which keeps the identities it has admitted.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        journal, box = None, Continuity(max_pending)
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if r.journal != journal:
                    journal, box = r.journal, Continuity(max_pending)
                outcome = box.admit(r.id, r.records) if r.op == "admit" else box.commit(r.id)
                out.append((outcome, len(box.pending), len(box.durable), len(box.committed), box.drained))
            told = pd.DataFrame(out, columns=["outcome", "pending", "durable", "committed", "drained"], index=batch.index)
            yield pd.concat([batch[["journal", "pos", "op", "id"]], told], axis=1)

    parts = int(ops.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    o = ops.select(F.col("journal").cast("string"), F.col("pos").cast("long"), "op", F.col("id").cast("long"), F.col("records").cast("long"))
    return o.repartition(parts, "journal").sortWithinPartitions("journal", "pos").mapInPandas(run, OUTBOX)
