"""Chat formatting with typed content parts.

A turn's content is plain text or a list of parts {type: text | image | audio | document, ...}.  A visitor flattens the
parts in order: text is escaped, every other part becomes a placeholder ``<|type:n|>`` (n counts the turn's
attachments) and an attachment record with its reference and the tokens it expands to.  A turn is framed as

    <|role|>ROLE<|text|>BODY<|end|>

and any ``<|`` inside a role or text is written ``<||``, which unescaping undoes, so no text can hold a control
string: after the escape, ``<|`` is followed by ``|`` in texts and by a letter in control strings.  The bodies of assistant
turns are the loss mask.

Turns are formatted once, where they lie after they are sorted into range partitions that split a large conversation.  A
conversation is the concatenation of its pieces in the order of turn, role and text, so it is never gathered: its
pieces are joined to segments of up to SEGMENT characters there, with the attachments and tokens of their turns, and
``read_back`` parses the segments of a conversation in order, one at a time.

Defined results: null texts and roles are empty; a null turn comes first; a null conv_id is a conversation of its
own; a content list that is no valid JSON is plain text.  Repeated turns are repeated.  An empty table gives only the
query's own conversation.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import read

ROLE, TEXT, END = "<|role|>", "<|text|>", "<|end|>"
SEGMENT = 1 << 20
#: Tokens that parts expand to: by tile of an image, by second of audio, by page of a document.
IMAGE_TILE, IMAGE_TILE_TOKENS, IMAGE_BASE_TOKENS, AUDIO_TOKENS, PAGE_TOKENS = 512, 170, 85, 25, 800
TEXT_TOKENS = re.compile(r"\w+|[^\w\s]")
_HOLDER = re.compile(r"<\|(image|audio|document):([0-9]+)\|>")


def escape(text: str) -> str:
    return text.replace("<|", "<||")


def unescape(text: str) -> str:
    return text.replace("<||", "<|")


class Flatten:
    """Visits a turn's parts in order; body, attachments (type, reference, tokens) and tokens are its results."""

    def __init__(self, count=lambda text: len(TEXT_TOKENS.findall(text))):
        self.count, self.body, self.attachments, self.tokens = count, [], [], 0

    def visit(self, part) -> None:
        if isinstance(part, str):
            part = {"type": "text", "text": part}
        visitor = getattr(self, f"visit_{part.get('type', 'text')}", None) if isinstance(part, dict) else None
        if visitor is None:
            raise ValueError(f"no such content part: {part!r}")
        visitor(part)

    def visit_text(self, part: dict) -> None:
        text = str(part.get("text") or "")
        self.body.append(escape(text))
        self.tokens += self.count(text)

    def visit_image(self, part: dict) -> None:
        w, h = int(part.get("width") or IMAGE_TILE), int(part.get("height") or IMAGE_TILE)
        self._attach("image", part, IMAGE_BASE_TOKENS + IMAGE_TILE_TOKENS * math.ceil(w / IMAGE_TILE) * math.ceil(h / IMAGE_TILE))

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, math.ceil(AUDIO_TOKENS * float(part.get("seconds") or 1)))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, PAGE_TOKENS * int(part.get("pages") or 1))

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self.body.append(f"<|{kind}:{len(self.attachments)}|>")
        self.attachments.append((kind, str(part.get("ref") or part.get("url") or ""), tokens))
        self.tokens += tokens


def parts_of(content: str, typed: bool) -> list:
    """The parts of a turn's content: with typed, a JSON list is a list of parts."""
    if typed and content.lstrip()[:1] == "[":
        try:
            parts = json.loads(content)
            if isinstance(parts, list) and all(isinstance(p, dict) and p.get("type") in ("text", "image", "audio", "document") for p in parts):
                return parts
        except ValueError:
            pass
    return [content]


def format_turn(role: str | None, content: str | None, typed: bool = False) -> tuple[str, list[tuple[str, str, int]], int]:
    """A turn's piece, attachments and tokens."""
    seen = Flatten()
    for part in parts_of(content or "", typed):
        seen.visit(part)
    return f"{ROLE}{escape(role or '')}{TEXT}{''.join(seen.body)}{END}", seen.attachments, seen.tokens


_ATTACHED = "array<struct<type: string, ref: string, tokens: long>>"
_ATTACHED_ARROW = pa.list_(pa.struct([("type", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))


def _named(attachments: list[tuple[str, str, int]]) -> list[dict]:
    return [dict(zip(("type", "ref", "tokens"), x, strict=True)) for x in attachments]


def _plain(turns: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), text.alias("text"))


def format_turns(turns: DataFrame, typed: bool = False) -> DataFrame:
    """conv_id, turn, role, text, piece, loss, attachments, n_tokens of each turn (conv_id, turn, role, text).

    typed: texts that are JSON lists of parts are read as such; else every text is one text part.
    """
    arrow = pa.struct([("piece", pa.string()), ("attachments", _ATTACHED_ARROW), ("n_tokens", pa.int64())])

    @F.arrow_udf(f"struct<piece: string, attachments: {_ATTACHED}, n_tokens: long>")
    def of(role: pa.Array, text: pa.Array) -> pa.Array:
        rows = (format_turn(r.as_py(), t.as_py(), typed) for r, t in zip(role, text, strict=True))
        return pa.array([{"piece": p, "attachments": _named(a), "n_tokens": n} for p, a, n in rows], arrow)

    return _plain(turns).withColumn("f", of("role", "text")).select("conv_id", "turn", "role", "text", "f.piece", (F.col("role") == "assistant").alias("loss"), "f.attachments", "f.n_tokens")


# --- conversations as streams of pieces ---

_SEGMENT = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("nth", pa.int64()), ("formatted", pa.string()), ("attachments", _ATTACHED_ARROW), ("n_tokens", pa.int64())])
_SEGMENT_SQL = f"conv_id long, part long, nth long, formatted string, attachments {_ATTACHED}, n_tokens long"
_TOLD = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, n_tokens long"


def _formatter(typed: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted turns of conversations (conv_id, role, text) as segments."""
        from pyspark import TaskContext

        part, nth, key, rows, ready = TaskContext.get().partitionId(), 0, None, [], 0
        held, attached, size, tokens = [], [], 0, 0

        def end() -> None:
            nonlocal held, attached, size, tokens, nth, ready
            if held:
                rows.append({"conv_id": key, "part": part, "nth": nth, "formatted": "".join(held), "attachments": attached, "n_tokens": tokens})
                ready += size
                nth, held, attached, size, tokens = nth + 1, [], [], 0, 0

        for batch in batches:
            for c, r, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if c != key or size >= SEGMENT:
                    end()
                    key = c
                    if ready >= 8 * SEGMENT:
                        yield pa.RecordBatch.from_pylist(rows, _SEGMENT)
                        rows, ready = [], 0
                piece, found, n = format_turn(r, t.as_py(), typed)
                held.append(piece)
                attached += _named(found)
                size, tokens = size + len(piece), tokens + n
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _SEGMENT)
                rows, ready = [], 0
        end()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _SEGMENT)

    return run


def conversations(turns: DataFrame, typed: bool = False) -> DataFrame:
    """conv_id, part, nth, formatted, attachments, n_tokens: each conversation's formatted text, in segments ordered by part and nth.

    attachments: those of the segment's turns, in the order of their placeholders.
    """
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", "turn", "role", "text"]
    return _plain(turns).repartitionByRange(parts, *order).sortWithinPartitions(*order).select("conv_id", "role", "text").mapInArrow(_formatter(typed), _SEGMENT_SQL)


class Reader:
    """Parses formatted text fed to it in segments that end with a turn's end, and digests what it reads."""

    def __init__(self):
        self.turns = self.loss_chars = self.chars = self.attachments = self.tokens = 0
        self.turns_sha, self.loss_sha = hashlib.sha256(), hashlib.sha256()

    def feed(self, formatted: str, tokens: int = 0) -> None:
        self.chars += len(formatted)
        self.tokens += tokens
        for turn in formatted.split(END)[:-1]:  # no text holds a control string
            role, _, body = turn.removeprefix(ROLE).partition(TEXT)
            self.attachments += len(_HOLDER.findall(body))
            role, text = unescape(role), unescape(body)
            self.turns += 1
            self.turns_sha.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if role == "assistant":
                self.loss_chars += len(text)
                self.loss_sha.update(text.encode("utf-8", "surrogatepass"))

    def told(self, conv_id: int | None) -> tuple:
        return conv_id, self.turns, self.turns_sha.hexdigest(), self.loss_chars, self.loss_sha.hexdigest(), self.chars, self.attachments, self.tokens


def _read_segments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, reader, names = None, None, [x.split()[0] for x in _TOLD.split(", ")]
    schema = pa.schema([(n, pa.string() if "sha256" in n else pa.int64()) for n in names])
    for batch in batches:
        rows = []
        for c, text, tokens in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            if reader is None or c != key:
                if reader is not None:
                    rows.append(reader.told(key))
                key, reader = c, Reader()
            reader.feed(text.as_py(), tokens)
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema)
    if reader is not None:
        yield pa.RecordBatch.from_pylist([dict(zip(names, reader.told(key), strict=True))], schema)


def read_back(segments: DataFrame) -> DataFrame:
    """What the formatted conversations say: a row of counts and digests for each."""
    parts = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = segments.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "part", "nth")
    return ordered.select("conv_id", "formatted", "n_tokens").mapInArrow(_read_segments, _TOLD)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.sql("select -7L as conv_id, 0L as turn, 'user' as role, '</s>[INST] ok [/INST]' as text union all select -7L, 1L, 'assistant', '</s>[INST] ok [/INST]'")
    return read_back(conversations(turns.unionByName(own)))


#: As TEXT_TOKENS, in the SQL's regular expressions.
_SQL_TOKENS = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\p{Z}\x09-\x0D\x1C-\x1F\x85]"
_E = "replace({0}, '<|', '<||')"
SQL = f"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]')
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, encode(role), encode(text))) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, encode(text)) filter (role = 'assistant'), '')) as loss_sha256,
  sum({len(ROLE + TEXT + END)} + length({_E.format("role")}) + length({_E.format("text")}))::bigint as formatted_chars,
  0::bigint as n_attachments, sum(len(regexp_extract_all(text, '{_SQL_TOKENS}')))::bigint as n_tokens
from t group by conv_id
"""
