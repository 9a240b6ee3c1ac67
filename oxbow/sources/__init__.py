"""Sources: ledgers, directories, raw lines, the producers' wire format, histories as a data source."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEND = "row_type string, at string, producer_id string, verse string, canon string, incarnation string, seq bigint, payload_digest string, ack_status string, unacked boolean, endpoint string, receipt struct<kind: string, result: string, first_offset: bigint, next_offset: bigint>"
FAILOVER = "row_type string, at string, verse string, from_endpoint string, to_endpoint string, reason string, message string"
DIRECTORY = "owner string, advertise string, published_at_ms bigint, valid_for_ms bigint, assignments array<struct<canon: string, verse: string, serving: boolean>>"


def ledger(spark: SparkSession, path: str, row_type: str = "send", max_rows: int = 20_000) -> DataFrame:
    """A JSONL ledger's rows of one type; a line that is no object, or more rows than allowed, is an error."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    n, wrong = lines.agg(F.count("*"), F.count_if(~F.trim("value").rlike(r"(?s)^\{.*\}$"))).first()
    if wrong or n > max_rows:
        raise ValueError(f"{path}: {wrong} lines are no objects, {n} rows of at most {max_rows}")
    schema = SEND if row_type == "send" else FAILOVER
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path).where(F.col("row_type") == row_type)


def directory(spark: SparkSession, path: str) -> DataFrame:
    """The directory's records, stale ones too, by owner."""
    return spark.read.schema(DIRECTORY).json(path).orderBy("owner")


def assignments(records: DataFrame) -> DataFrame:
    return records.select("owner", "advertise", "published_at_ms", "valid_for_ms", F.explode("assignments").alias("a")).select("*", "a.canon", "a.verse", "a.serving").drop("a")


def raw_lines(spark: SparkSession, path: str, max_bytes: int = 8192, **attributes: str) -> DataFrame:
    """Lines as records with fixed attributes; a line beyond max_bytes is a problem."""
    attrs = F.create_map(*[F.lit(x) for kv in attributes.items() for x in kv]) if attributes else F.create_map().cast("map<string, string>")
    lines = spark.read.text(path).withColumnRenamed("value", "payload")
    return lines.select("payload", attrs.alias("attributes"), F.when(F.octet_length("payload") > max_bytes, "too long").alias("problem"))


# --- the wire: a big-endian u32 length, then magic, a type byte and the type's fields ---

#: Fixed values of the format.
MAGIC, MAX_BODY, MAX_RECORDS, MAX_DIAGNOSTIC = b"SPW1", 4 << 20, 1024, 1024
HELLO, SUBMIT, ACK, ERROR, CLOSE = 1, 2, 3, 4, 5
ERROR_CODES = {1: "NotServing", 2: "Backpressure", 3: "IdentityConflict", 4: "Unsupported", 5: "Ambiguous"}
_FIXED = {HELLO: ">16sI", ACK: ">IQQQ", CLOSE: ">"}


def encode_frame(kind: int, fields: bytes) -> bytes:
    body = MAGIC + bytes([kind]) + fields
    if len(body) > MAX_BODY:
        raise ValueError("body too large")
    return struct.pack(">I", len(body)) + body


def encode_hello(producer: bytes, epoch: int) -> bytes:
    return encode_frame(HELLO, struct.pack(_FIXED[HELLO], producer, epoch))


def encode_submit(sequence: int, records: list[bytes]) -> bytes:
    if not 1 <= len(records) <= MAX_RECORDS:
        raise ValueError("record count")
    return encode_frame(SUBMIT, struct.pack(">QI", sequence, len(records)) + b"".join(struct.pack(">I", len(r)) + r for r in records))


def encode_ack(epoch: int, sequence: int, first: int, next_: int) -> bytes:
    return encode_frame(ACK, struct.pack(_FIXED[ACK], epoch, sequence, first, next_))


def encode_error(epoch: int, sequence: int, code: int, diagnostic: str) -> bytes:
    text = diagnostic.encode()
    return encode_frame(ERROR, struct.pack(">IQBI", epoch, sequence, code, len(text)) + text)


def _body(kind: int, b: bytes) -> dict:
    """The fields of a frame; every byte must be used."""
    if kind in _FIXED:
        values = struct.unpack(_FIXED[kind], b)
        if kind == HELLO:
            if not values[1]:
                raise ValueError("epoch")
            return {"kind": "hello", "producer": values[0], "epoch": values[1]}
        if kind == ACK:
            if values[2] >= values[3] or values[3] >= 1 << 63 or values[1] >= 1 << 63:
                raise ValueError("offsets")
            return {"kind": "ack", "epoch": values[0], "sequence": values[1], "first_offset": values[2], "next_offset": values[3]}
        return {"kind": "close"}
    if kind == ERROR:
        epoch, sequence, code, n = struct.unpack_from(">IQBI", b)
        if n > MAX_DIAGNOSTIC or len(b) != 17 + n or code not in ERROR_CODES or sequence >= 1 << 63:
            raise ValueError("error frame")
        return {"kind": "error", "epoch": epoch, "sequence": sequence, "message": f"{ERROR_CODES[code]}: {b[17:].decode()}"}
    if kind != SUBMIT:
        raise ValueError("type")
    sequence, n = struct.unpack_from(">QI", b)
    if not 1 <= n <= MAX_RECORDS or sequence >= 1 << 63:
        raise ValueError("record count")
    at, records = 12, []
    for _ in range(n):
        (size,) = struct.unpack_from(">I", b, at)
        if at + 4 + size > len(b):
            raise ValueError("record")
        records.append(b[at + 4 : at + 4 + size])
        at += 4 + size
    if at != len(b):
        raise ValueError("trailing bytes")
    return {"kind": "submit", "sequence": sequence, "records": records}


def decode_frames(stream: bytes) -> Iterator[dict]:
    """The stream's frames; from one that can't be read on, a last frame of kind "invalid"."""
    at = 0
    try:
        while at < len(stream):
            (size,) = struct.unpack_from(">I", stream, at)
            if not 5 <= size <= MAX_BODY or at + 4 + size > len(stream) or stream[at + 4 : at + 8] != MAGIC:
                raise ValueError("frame")
            yield _body(stream[at + 8], stream[at + 9 : at + 4 + size])
            at += 4 + size
    except (ValueError, struct.error) as e:
        yield {"kind": "invalid", "message": str(e)}


FRAMES = "stream_id long, nth int, kind string, producer binary, epoch long, sequence long, records array<binary>, first_offset long, next_offset long, message string"


def decode_wire(streams: DataFrame) -> DataFrame:
    """The frames of captured streams (stream_id, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in FRAMES.split(", ")]
        for batch in batches:
            rows = [{"stream_id": i, "nth": n} | f for i, content in zip(batch["stream_id"], batch["content"], strict=True) for n, f in enumerate(decode_frames(bytes(content or b"")))]
            out = pd.DataFrame(rows, columns=names).astype(object)
            yield out.where(out.notna(), None).astype({c: "Int64" for c in ("epoch", "sequence", "first_offset", "next_offset")})

    return streams.select("stream_id", "content").mapInPandas(run, FRAMES)
