"""Structured Streaming forms: stateful admission and sealing, bounded dedup, an exactly-once Parquet sink."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ingest import ADMITTED, Admission


def admit_stream(submissions: DataFrame, window: int = 64) -> DataFrame:
    """Admission of a stream of submissions (verse, pos, producer, epoch, sequence, records, digest), with state by verse.

    Offsets are a verse's, so the state is too.  A micro-batch's rows of a verse are admitted in the order of pos; the batch
    operator of the same name is this over all rows at once.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        next_offset, told = state.get if state.exists else (0, "{}")
        producers = {int(p): x | {"seen": {int(s): tuple(v) for s, v in x["seen"].items()}} for p, x in json.loads(told).items()}
        rules = Admission(next_offset, window, producers)
        rows = pd.concat(list(batches), ignore_index=True).sort_values("pos", kind="stable")
        out = [rules.admit(int(r.producer), int(r.epoch), int(r.sequence), int(r.records), r.digest) for r in rows.itertuples(index=False)]
        state.update((rules.next_offset, json.dumps(rules.producers)))
        found = pd.DataFrame(out, columns=["outcome", "first_offset", "next_offset"], index=rows.index)
        yield pd.concat([rows[["verse", "pos", "producer", "epoch", "sequence", "records", "digest"]], found], axis=1).astype({"first_offset": "Int64", "next_offset": "Int64"})

    return submissions.groupBy("verse").applyInPandasWithState(run, ADMITTED, "next_offset long, producers string", "append", GroupStateTimeout.NoTimeout)


SEALED = "verse string, batch long, records long, bytes long, why string"


def seal(held: tuple[int, int, int, int], items: list[tuple[int, int]], now: int, max_records: int, max_bytes: int, max_age_ms: int) -> tuple[tuple[int, int, int, int], list[tuple[int, int, int, str]]]:
    """The open batch (number, records, bytes, when its first item came) after items (records, bytes) that came now, and the batches sealed on the way.

    One as old as max_age_ms is sealed before the items get in, so a stream that never pauses is sealed by age too.
    """
    n, records, size, opened = held
    out = []
    if records and now - opened >= max_age_ms:
        out.append((n, records, size, "age"))
        n, records, size = n + 1, 0, 0
    for r, b in items:
        opened = opened if records else now
        records, size = records + r, size + b
        why = "records" if records >= max_records else "bytes" if size >= max_bytes else ""
        if why:
            out.append((n, records, size, why))
            n, records, size = n + 1, 0, 0
    return (n, records, size, opened), out


def seal_stream(items: DataFrame, max_records: int, max_bytes: int, max_age_ms: int) -> DataFrame:
    """Batches (verse, batch, records, bytes, why) of a stream of items (verse, pos, records, bytes), sealed after placing or by processing-time age."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = tuple(state.get) if state.exists else (0, 0, 0, 0)
        rows = pd.DataFrame(columns=["pos", "records", "bytes"]) if state.hasTimedOut else pd.concat(list(batches), ignore_index=True).sort_values("pos", kind="stable")
        now = state.getCurrentProcessingTimeMs()
        held, out = seal(held, [(int(r.records), int(r.bytes)) for r in rows.itertuples(index=False)], now, max_records, max_bytes, max_age_ms)
        state.update(held)
        if held[1]:
            state.setTimeoutDuration(max(1, held[3] + max_age_ms - now))
        yield pd.DataFrame([(key[0], *x) for x in out], columns=[c.split()[0] for c in SEALED.split(", ")])

    return items.groupBy("verse").applyInPandasWithState(run, SEALED, "n long, records long, bytes long, opened long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def dedup_stream(rows: DataFrame, key: list[str], at: str, within: str) -> DataFrame:
    """The first row of each key; keys are remembered for so long, so the state is bounded."""
    return rows.withWatermark(at, within).dropDuplicatesWithinWatermark(key)


def append_once(write: Callable[[DataFrame, int], None], done: Callable[[], int]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that skips batches up to done(), the last one that the sink has."""

    def sink(df: DataFrame, batch_id: int) -> None:
        if batch_id > done():
            write(df, batch_id)

    return sink


def parquet_batches(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that writes each micro-batch to a folder of its own, so that writing it again replaces it."""

    def sink(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return sink


def windowed_counts(events: DataFrame, at: str, by: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts by event-time window with late data dropped after the watermark."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), by).agg(F.count("*").alias("n"))
