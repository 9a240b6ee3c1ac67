"""Column functions: digests, safe rendering, time formats, parsing of status texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(x: Column) -> Column:
    """sha256:<hex> of bytes or of a string's UTF-8."""
    return F.concat(F.lit("sha256:"), F.sha2(x.cast("binary"), 256))


def sized(x: Column) -> Column:
    """A string with its byte length before it, so that a concatenation of such strings can be read in one way only."""
    x = F.coalesce(x, F.lit(""))
    return F.concat(F.octet_length(x).cast("string"), F.lit(":"), x)


def record_digest(attributes: Column, payload: Column) -> Column:
    """Digest of a record: its attribute count, its attributes (key, type tag, value) by key, and its payload.

    attributes: map of string to struct(s string, i bigint, b boolean), one of which is set; null is the empty map.
    """

    def told(e: Column) -> Column:
        v = e["value"]
        tagged = F.when(v["s"].isNotNull(), F.concat(F.lit("s"), sized(v["s"]))).when(v["i"].isNotNull(), F.concat(F.lit("i"), v["i"].cast("string"))).otherwise(F.concat(F.lit("b"), F.coalesce(v["b"].cast("string"), F.lit("null"))))
        return F.concat(sized(e["key"]), tagged)

    entries = F.array_sort(F.transform(F.coalesce(F.map_entries(attributes), F.array().cast("array<struct<key: string, value: struct<s: string, i: bigint, b: boolean>>>")), told))
    head = F.concat(F.lit("record:"), F.size(entries).cast("string"), F.lit(":"), F.array_join(entries, ","), F.lit(":"))
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(head.cast("binary"), payload.cast("binary")), 256))


def object_name(*identity: Column) -> Column:
    """A path-safe name from an output's identity (workload, canon, verse, epoch, first, next)."""
    return F.concat(F.sha2(F.concat_ws("\0", *[x.cast("string") for x in identity]), 256), F.lit(".parquet"))


def safe_payload(x: Column) -> Column:
    """struct(encoding, text): escaped text if bytes are UTF-8 without control characters but tabs, else lower-case hex."""
    text = x.cast("string")
    plain = F.is_valid_utf8(text) & ~text.rlike(r"[\x00-\x08\x0A-\x1F\x7F-\x{9F}]")
    escaped = F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\t"), F.lit("\\t"))
    return F.when(plain, F.struct(F.lit("text").alias("encoding"), escaped.alias("text"))).otherwise(F.struct(F.lit("hex").alias("encoding"), F.lower(F.hex(x)).alias("text")))


def rfc3339_seconds(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def unix_nanos(ms: Column) -> Column:
    """Milliseconds since the epoch as a string of nanoseconds."""
    return (ms.cast("decimal(20,0)") * F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(27,0)").cast("string")


def age_text(seconds: Column) -> Column:
    return F.when(seconds < 60, F.concat(F.format_string("%.1f", seconds.cast("double")), F.lit("s ago"))).otherwise(F.concat(F.floor(seconds / 60).cast("string"), F.lit("m ago")))


def saturating_sub(a: Column, b: Column) -> Column:
    return F.greatest(a - b, F.lit(0))


def round_half_away(x: Column) -> Column:
    return F.when(x < 0, -F.floor(-x + 0.5)).otherwise(F.floor(x + 0.5))


def safe_name(x: Column) -> Column:
    """Whether x names a file inside its folder: not empty, no NUL, slash or backslash, no dot-dot."""
    return x.isNotNull() & (x != "") & ~x.rlike(r"[\x00/\\]") & ~x.contains("..")


def commit_ref(x: Column) -> Column:
    """struct(file, digest) of ``parquet:<file>#<digest>``; null if x isn't one or its file's name isn't safe."""
    file, hashed = F.regexp_extract(x, r"^parquet:([^#]*)#(.+)$", 1), F.regexp_extract(x, r"^parquet:([^#]*)#(.+)$", 2)
    return F.when(x.startswith("parquet:") & (hashed != "") & safe_name(file), F.struct(file.alias("file"), hashed.alias("digest")))


def token(x: Column, key: str) -> Column:
    """The value of ``key=value`` among a text's tokens; null if there is none."""
    found = F.filter(F.split(x, r"\s+"), lambda t: t.startswith(f"{key}="))
    return F.substr(F.get(found, F.lit(0)), F.lit(len(key) + 2))


def ack_line(x: Column) -> Column:
    """struct(first_offset, next_offset) of ``OK first next``, else null."""
    m = [F.regexp_extract(x, r"^OK ([0-9]+) ([0-9]+)\s*$", k).try_cast("bigint") for k in (1, 2)]
    return F.when(m[0].isNotNull() & m[1].isNotNull(), F.struct(m[0].alias("first_offset"), m[1].alias("next_offset")))


def tiles(spans: Column, n: Column) -> Column:
    """Whether spans, an array of (first, count) in order, covers [0, n) without gap, overlap or empty span."""
    ends = F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: F.when((a == s["first"]) & (s["count"] > 0), a + s["count"]).otherwise(F.lit(-1).cast("long")))
    return ends == n


#: Patterns of texts that may not leave.
SECRETS = (
    r"AKIA[0-9A-Z]{16}",
    r"(?i)AWS_SECRET_ACCESS_KEY",
    r"Bearer\s+[A-Za-z0-9\-._~+/]+=*",
    r"BEGIN (RSA |OPENSSH )?PRIVATE KEY",
    r'"SecretAccessKey"\s*:',
    r"(?i)X-Amz-Signature=",
)


def has_secret(x: Column) -> Column:
    out = F.lit(False)
    for p in SECRETS:
        out = out | x.rlike(p)
    return F.coalesce(out, F.lit(False))
