"""Personal data: patterns, and a skip-chain conditional random field for what they miss.

The patterns give the base spans.  The field's nodes are these, which are observed, and the text's other mentions that could
be one: numbers of 7 to 19 digits, however they are grouped, and of four parts up to 255; at signs with what stands
around them, also written out ("[at]", "(at)", " at " before a domain); and tokens that are the name of an observed
address.  All other text is clamped to "no entity".  A node's labels are "none" and the four kinds.  Its potentials: a softmax
of its shape and of the words before and after it; transitions to the next node where only white space lies between;
and skip edges between mentions that are the same or similar (equal digits; the same last nine of nine to fifteen digits, so
with and without a country's code; the same four parts; equal addresses but for case and spelling of the signs; the same
name).  Skip edges link a key's occurrences in turn, and each occurrence to the key's nearest observed ones before
and after it, so its distance to them does not matter and a document has a bounded number for each node.  Loopy
belief propagation, damped, passes messages along all edges until they converge, for at most ROUNDS rounds for each node of
the longest chain of skip edges that leads to an observed node; a node whose likeliest label is a kind, with at
least LEAST probability, gives a span of that kind if skip edges lead from it to an observed one: so what a
pattern finds in one place is also found where it is written otherwise, and shapes alone add nothing.

The field is trained piecewise: softmax weights by gradient descent, transitions and skip potentials from
smoothed counts.  The labels are the base spans themselves (so no labelled data is needed), each shown twice: as it is, and
without the signs that the patterns go by, so the softmax does not learn the patterns.  They come from at most TRAIN_DOCS
different texts, those of smallest hash, whole.  All texts are then scanned whole; every step takes time in
proportion to the text, also where it has no white space.

Defined results: a null or empty text has no spans.  Repeated rows are scanned one by one.  An empty table gives no
rows; with no training rows the softmax says "none" unless a skip edge says otherwise.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import pairwise
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import fresh, read

KINDS = ("email", "ip", "card", "phone")
ROUNDS, DAMP, LEAST = 10, 0.5, 0.6
TRAIN_DOCS, TRAIN_STEPS = 1000, 150
#: The logarithm of another label's potential at an observed node, which however many edges cannot outweigh.
OBSERVED = -1e9

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
#: A number in groups, with up to three signs between two digits.
_NUMBER = re.compile(r"[0-9](?:[()\[\].\x20-]{0,3}[0-9])*")
_GROUPS = re.compile(r"[0-9]+")
#: The at sign, as it is or written out, and a domain after it.
_AT = re.compile(r"@|\x20?[\[({]at[\])}]\x20?|\x20at\x20", re.I)
_DOT = re.compile(r"\x20?(?:\.|[\[({]dot[\])}])\x20?", re.I)
_DOT_BEFORE = re.compile(r"\x20?[\[({]dot[\])}]\x20?\Z", re.I)
_LABEL = re.compile(r"[A-Za-z0-9-]{1,63}")
_NAME = re.compile(r"[A-Za-z0-9._%+-]{5,64}")
_NOT_LETTER = re.compile(r"[0-9._%+-]")
#: Characters of an address's name, and labels of its domain.
LONGEST_NAME, LABELS = 64, 6
_BEFORE, _AFTER = re.compile(r"(\w{1,32})\W{0,4}\Z"), re.compile(r"\W{0,4}(\w{1,32})")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As the pattern's leftmost matches; each at sign's left side is read once."""
    pos, at = 0, text.find("@")
    while at != -1:
        start = at
        while start > pos and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            pos = m.end()
        at = text.find("@", max(at + 1, pos))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """As the pattern's leftmost matches: of a chain of dotted numbers, four by four."""
    for chain in _DOTTED.finditer(text):
        parts = list(_GROUPS.finditer(text, chain.start(), chain.end()))
        for k in range(0, len(parts) - 3, 4):
            if all(len(x := p[0].lstrip("0")) <= 3 and int(x or 0) <= 255 for p in parts[k : k + 4]):
                yield parts[k].start(), parts[k + 3].end()


def luhn(digits: str) -> bool:
    d = [int(x) for x in reversed(digits)]
    return (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end), sorted."""
    out = []
    if "@" in text:
        out += [(a, 0, b) for a, b in _emails(text)]
    if "." in text:
        out += [(a, 1, b) for a, b in _ips(text)]
    for m in _CARD.finditer(text):
        if 12 <= m.end() - m.start() and 12 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# --- the field ---

#: Of a node's shape, and for each word beside it.
_SHAPE, _CONTEXT = 24, 32
_FEATURES = _SHAPE + 2 * _CONTEXT


def _numbers(text: str) -> Iterator[tuple[int, int]]:
    """Numbers of 7 to 19 digits, or of four parts, that no letter touches; longer ones are taken apart at spaces."""
    for run in _NUMBER.finditer(text):
        if run.end() - run.start() < 7:
            continue
        pieces = [run.span()]
        if len(_NOT_DIGIT.sub("", run[0])) > 19:
            pieces = [m.span() for m in re.compile(r"[^\x20]+").finditer(text, *run.span())]
        for a, b in pieces:
            while a < b and not text[a].isdigit():
                a += 1
            while a < b and not text[b - 1].isdigit():
                b -= 1
            n = len(_NOT_DIGIT.sub("", text[a:b]))
            if (7 <= n <= 19 or (n >= 4 and _parts(text[a:b]))) and not text[a - 1 : a].isalpha() and not text[b : b + 1].isalpha():
                yield a, b


def _parts(number: str) -> tuple[int, ...]:
    """The four parts of an address of numbers, or none."""
    parts = [m[0] for m in _GROUPS.finditer(number)]
    return tuple(map(int, parts)) if len(parts) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in parts) else ()


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """What stands around at signs, also written out."""
    for sign in _AT.finditer(text):
        a, b, labels = sign.start(), sign.end(), 0
        while a > 0 and sign.start() - a < LONGEST_NAME:
            if text[a - 1] in _LOCAL:
                a -= 1
            elif a < sign.start() and (m := _DOT_BEFORE.search(text[max(0, a - 7) : a])):
                a -= len(m[0])
            else:
                break
        while labels < LABELS and (m := _LABEL.match(text, b)):
            labels, b = labels + 1, m.end()
            dot = _DOT.match(text, b)
            if dot is None or not _LABEL.match(text, dot.end()):
                break
            b = dot.end()
        if a < sign.start() and labels > (0 if sign[0] == "@" else 1):
            yield a, b


def _address(mention: str) -> str:
    return _DOT.sub(".", _AT.sub("@", mention, count=1)).lower()


class Nodes:
    """A text's nodes: where they are, their base labels (0 none), features, and edges."""

    def __init__(self, text: str, base: list[tuple[int, int, int]]):
        names = {text[a:b].partition("@")[0].lower() for a, k, b in base if k == 0}
        names = {x for x in names if len(x) >= 5 and _NOT_LETTER.search(x)}
        found = [*_numbers(text)]
        if "@" in text or names:
            found += _addresses(text)
        if names:
            found += [(m.start(), m.start() + len(x)) for m in _NAME.finditer(text) if (x := m[0].rstrip(".").lower()) in names]
        # Longer mentions first; none overlaps a base span or one before it.
        taken, spans = sorted((a, b) for a, _, b in base), []
        for a, b in sorted(set(found), key=lambda x: (x[0], -x[1])):
            if (not spans or a >= spans[-1][1]) and not _overlaps(taken, a, b):
                spans.append((a, b))
        nodes = sorted([(a, b, 0) for a, b in spans] + [(a, b, k + 1) for a, k, b in base])
        self.text, self.at = text, [(a, b) for a, b, _ in nodes]
        self.label = np.array([k for _, _, k in nodes], int)
        self.inside = self.label > 0
        self.next = [(i, i + 1) for i in range(len(nodes) - 1) if 0 < nodes[i + 1][0] - nodes[i][1] <= 2 and text[nodes[i][1] : nodes[i + 1][0]].isspace()]
        keys: dict[tuple, list[int]] = {}
        for i, (a, b, k) in enumerate(nodes):
            for key in _keys(text[a:b], k, names):
                keys.setdefault(key, []).append(i)
        self.skip = sorted({x for at in keys.values() for x in pairwise(at)})
        #: Skip edges over occurrences that lie between, to observed ones.
        self.far = sorted({x for at in keys.values() for x in self._far(at)})

    def _far(self, at: list[int]) -> Iterator[tuple[int, int]]:
        for way in (at, at[::-1]):
            seen = None  # the place in way of the last observed occurrence
            for k, i in enumerate(way):
                if self.inside[i]:
                    seen = k
                elif seen is not None and seen < k - 1:
                    yield way[seen], i

    def hops(self) -> np.ndarray:
        """How many skip edges lead from a node to the nearest one inside a base span; -1 if none do."""
        beside: dict[int, list[int]] = {}
        for i, j in [*self.skip, *self.far]:
            beside.setdefault(i, []).append(j)
            beside.setdefault(j, []).append(i)
        out = np.where(self.inside, 0, -1)
        edge, far = np.flatnonzero(self.inside).tolist(), 0
        while edge:
            far += 1
            edge = sorted({j for i in edge for j in beside.get(i, ()) if out[j] < 0})
            out[edge] = far
        return out

    def features(self) -> np.ndarray:
        x = np.zeros((len(self.at), _FEATURES), np.float32)
        for i, (start, end) in enumerate(self.at):
            w = self.text[start:end]
            digits = _NOT_DIGIT.sub("", w)
            d, a = len(digits), sum(c.isalpha() for c in w)
            x[i, [0, 1 + min(d // 2, 8), 10 + min(a, 3)]] = 1
            x[i, 14] = "@" in w
            x[i, 15] = bool(_parts(w))
            x[i, 16] = self.text[start - 1 : start] == "+" or w[0] == "+"
            x[i, 17] = d >= 12 and luhn(digits)
            x[i, 18] = " " in w
            x[i, 19] = "-" in w
            x[i, 20] = "." in w
            x[i, 21] = "(" in w
            x[i, 22] = d == len(w)
            for k, m in enumerate((_BEFORE.search(self.text[max(0, start - 40) : start]), _AFTER.match(self.text, end, end + 40))):
                if m:
                    x[i, _SHAPE + k * _CONTEXT + crc32(m[1].lower().encode("utf-8", "surrogatepass")) % _CONTEXT] = 1
        return x


def _overlaps(taken: list[tuple[int, int]], a: int, b: int) -> bool:
    """taken: sorted spans, of which those of one kind do not overlap."""
    k = bisect_left(taken, (b,))
    return any(end > a for _, end in taken[max(0, k - len(KINDS)) : k])


def _keys(mention: str, label: int, names: set[str]) -> set[tuple]:
    if label == 1 or (label == 0 and _AT.search(mention)):
        whole = _address(mention)
        return {("e", whole)} | {("l", name) for name in {whole.partition("@")[0]} & names}
    if label == 0 and mention.lower() in names:
        return {("l", mention.lower())}
    digits, parts, keys = _NOT_DIGIT.sub("", mention), _parts(mention), set()
    if len(digits) >= 7:
        keys.add(("d", digits))
    if 9 <= len(digits) <= 15:
        keys.add(("t", digits[-9:]))
    if parts:
        keys.add(("g", parts))
    return keys


def _otherwise(features: np.ndarray) -> np.ndarray:
    """Features of mentions as if they were written as plain numbers or words, without the signs that a pattern goes by."""
    out = features.copy()
    out[:, [14, 16, 18, 19, 20, 21]] = 0
    return out


class Field:
    """The trained potentials, as logarithms."""

    def __init__(self, docs: list[str]):
        labels = len(KINDS) + 1
        xs, ys = [], []
        self.step, self.skip = np.ones((labels, labels)), np.ones((labels, labels))
        for text in docs:
            nodes = Nodes(text, base_spans(text))
            if not nodes.at:
                continue
            x = nodes.features()
            xs += [x, _otherwise(x[nodes.inside])]
            ys += [nodes.label, nodes.label[nodes.inside]]
            for counts, pairs in ((self.step, nodes.next), (self.skip, nodes.skip)):
                for i, j in pairs:
                    counts[nodes.label[i], nodes.label[j]] += 1
        self.skip += self.skip.T + 60 * np.eye(labels)  # the constraint itself: alike tokens tend to have one label
        self.weights = np.zeros((_FEATURES, labels))
        self.weights[0, 0] = 4.0
        if xs:
            x, y = np.concatenate(xs).astype(float), np.eye(labels)[np.concatenate(ys)]
            for _ in range(TRAIN_STEPS):
                s = x @ self.weights
                p = np.exp(s - s.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                self.weights += 2.0 * (x.T @ (y - p) / len(x) - 1e-4 * self.weights)
        for counts in (self.step, self.skip):  # pointwise mutual information, smoothed
            counts /= counts.sum()
            np.log(counts / (counts.sum(1, keepdims=True) * counts.sum(0, keepdims=True)), out=counts)

    def beliefs(self, nodes: Nodes, hops: np.ndarray) -> np.ndarray:
        """Each node's label probabilities, by loopy message passing; hops as the nodes' own."""
        labels = len(KINDS) + 1
        unary = nodes.features() @ self.weights
        unary = np.where(nodes.inside[:, None], np.where(np.arange(labels) == nodes.label[:, None], 0.0, OBSERVED), unary)
        skip = nodes.skip + nodes.far
        edges = nodes.next + skip
        if not edges:
            return _softmax(unary)
        pots = np.array([self.step] * len(nodes.next) + [self.skip] * len(skip))
        a, b = np.array(edges).T
        src, dst = np.r_[a, b], np.r_[b, a]
        pot = np.concatenate([pots, pots.transpose(0, 2, 1)])
        back = np.r_[np.arange(len(a), 2 * len(a)), np.arange(len(a))]
        msg = np.zeros((len(src), labels))
        for _ in range(ROUNDS * (1 + int(hops.max()))):
            total = unary.copy()
            np.add.at(total, dst, msg)
            out = (total[src] - msg[back])[:, :, None] + pot
            top = out.max(1)
            new = top + np.log(np.exp(out - top[:, None, :]).sum(1))
            new -= new.max(1, keepdims=True)
            new = DAMP * msg + (1 - DAMP) * new
            if np.abs(new - msg).max() < 1e-3:
                break
            msg = new
        total = unary.copy()
        np.add.at(total, dst, msg)
        return _softmax(total)

    def spans(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """The base spans, and all spans."""
        base = base_spans(text)
        if not base:  # nothing is observed, and the softmax was trained to agree with the patterns
            return base, base
        nodes = Nodes(text, base)
        if nodes.inside.all() or not nodes.skip:
            return base, base
        hops = nodes.hops()
        if hops.max() < 1:
            return base, base
        p = self.beliefs(nodes, hops)
        best = p.argmax(1)
        added = [(nodes.at[i][0], int(best[i]) - 1, nodes.at[i][1]) for i in np.flatnonzero((hops > 0) & (best > 0)) if p[i, best[i]] >= LEAST]
        return base, sorted(base + added)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(docs: DataFrame) -> Field:
    text = F.col("text").cast("string")
    chosen = docs.select(text.alias("text")).where(text.rlike(r"[0-9][0-9][0-9]|@")).select(F.xxhash64("text").alias("h"), "text")
    # The hashes first, as a task may hold as many of the smallest as all: texts would be too much for the driver.
    least = [r[0] for r in chosen.select("h").distinct().orderBy("h").limit(TRAIN_DOCS).collect()]
    if not least:
        return Field([])
    rows = chosen.where(F.col("h") <= least[-1]).groupBy("h").agg(F.min("text").alias("text")).collect()
    return Field([r.text for r in sorted(rows, key=lambda r: r.h)])


def told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


_OUT = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_spans", pa.int64())])


def find(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, how many base spans of each kind, their digest, all spans and how many there are, of each document."""
    held = docs.sparkSession.sparkContext.broadcast(field or train(docs))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(1):
                base, spans = held.value.spans(t.as_py() or "")
                kinds = [k for _, k, _ in base]
                rows.append((*(kinds.count(k) for k in range(len(KINDS))), hashlib.sha256(told(base).encode()).hexdigest(), told(spans), len(spans)))
            columns = zip(*rows, strict=True) if rows else [[]] * (len(_OUT) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(_OUT)[1:], strict=True))], schema=_OUT)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span of its texts replaced by its kind in angle brackets; n_chars, if there is one, follows."""
    held = docs.sparkSession.sparkContext.broadcast(train(docs))

    @F.arrow_udf("string")
    def hide(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array([_hidden(held.value, x.as_py()) for x in batch], pa.string())

    (text,) = fresh(docs, "text")
    out = docs.withColumn(text, hide(F.col("text").cast("string")))
    kinds = dict(docs.dtypes)
    return out.select(*[F.col(text).alias(c) if c == "text" else F.when(~F.col("text").eqNullSafe(F.col(text)), F.length(text)).otherwise(F.col(c)).cast(kinds[c]).alias(c) if c == "n_chars" else out[c] for c in docs.columns])


def _hidden(field: Field, text: str | None) -> str | None:
    if not text:
        return text
    out, pos = [], 0
    for a, k, b in field.spans(text)[1]:
        if b <= pos:
            continue
        if a >= pos:
            out += [text[pos:a], f"<{KINDS[k].upper()}>"]
        pos = b  # overlapping spans are hidden by one mark
    return "".join([*out, text[pos:]])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(read(spark, sf_dir, "documents"))
