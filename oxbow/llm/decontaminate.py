"""Benchmark decontamination: SimHash of item-sized windows, a multi-index over Hamming blocks, exact verification.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, lower-cased.  An item's size class is
the largest of CLASSES (one class is a third above the last, up to LONGEST words) of at most four fifths of its words: a
document that leaks the item has such a stretch of it in one piece, or nearly so, even where the ends or some words
are changed.  From each item stretches of its class's size are taken, at its start, middle and end and as many in
between as cover it.  Every window, of every class's size, of every document has a 64-bit SimHash fingerprint of its
pairs of successive words, each weighing as often as it occurs; so have the stretches.

The index cuts the 64 bits into BLOCKS blocks.  Two fingerprints within RADIUS bits differ in one block at least by at
most that block's NEAR, and each stretch is entered for every value of a block that is as near to its own: looking up
a window's four block values gives all stretches within RADIUS, and few others, which the whole distance rules out.  A hit
aligns the window with the item; item-sized windows around it are verified by the weighted Jaccard similarity of their
five-word shingles, which weigh as often as they occur: a leak has SIMILARITY or more.  A document shorter than the
item is verified whole.

Items come in blocks of bounded size, which go to all tasks as their texts; a task makes the index from them.  Each task
reads its documents whole, CHUNK words at a time.  There is no shuffle.

Defined results: a null or empty text has no windows; an item without words matches nothing; an item or window of
under five words is one shingle, the whole.  Of a document's windows near one item the most similar is returned, then
the first.  Repeated documents, and items with the same id, are matched one by one.  Empty tables give no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import read

SHINGLE, SIMILARITY, RADIUS, BLOCKS = 5, 0.8, 10, 4
#: Of two fingerprints within RADIUS, one block differs by at most its number: more in each would be more than RADIUS in all.
NEAR = [RADIUS // BLOCKS - (k > RADIUS % BLOCKS) for k in range(BLOCKS)]
LONGEST = 63
#: Characters of items in one block.
BLOCK_CHARS = 4_000_000
#: Words fingerprinted at a time, and bytes of documents held at a time (or one document).
CHUNK, HELD = 4096, 1 << 19
#: Letters and digits are kept, and all bytes beyond ASCII.
_CUT = bytes(c if c >= 128 or bytes([c]).isalnum() else 32 for c in range(256))


def _classes() -> list[int]:
    out = [2]
    while (n := max(out[-1] + 1, out[-1] * 4 // 3)) <= LONGEST:
        out.append(n)
    return out


CLASSES = _classes()


def _cut(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_CUT)


def words_of(text: str | None) -> list[bytes]:
    return _cut(text).split()


def shingles(words: list[bytes]) -> Counter:
    return Counter(_shingles(words))


def _shingles(words: list[bytes]) -> list[tuple[bytes, ...]]:
    if len(words) < SHINGLE:
        return [tuple(words)] if words else []
    return list(zip(*(words[k:] for k in range(SHINGLE)), strict=False))


def similarity(a: Counter, b: Counter) -> float:
    both = sum((a & b).values())
    union = a.total() + b.total() - both
    return both / union if union else 0.0


_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xC4CEB9FE1A85EC53)]
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # the lowest k bytes


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD[2]
    return x ^ (x >> np.uint64(29))


def _hashes(cut: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of a cut text, of its length and its first and last eight bytes, and the words' starts."""
    codes = np.frombuffer(b" " + cut + b"         ", np.uint8)
    edges = np.flatnonzero(np.diff(codes != 32)) + 1
    starts, ends = edges[::2], edges[1::2]
    eight = np.lib.stride_tricks.as_strided(codes.view(np.uint8)[:8].view("<u8"), (len(codes) - 7,), (1,))  # from every byte on
    short = np.minimum(ends - starts, 8)
    h = (eight[starts] & _LOW[short]) * _ODD[0] + eight[ends - short] % (_LOW[short] + (short < 8)) * _ODD[1] + (ends - starts).astype(np.uint64)
    return _mix(h), starts - 1


def _sums(hashes: np.ndarray) -> np.ndarray:
    """Running counts, modulo 256, of each of 64 bits over the hashes of words and their successors: exact for windows of up to LONGEST words."""
    pairs = _mix(hashes[:-1] * _ODD[0] + hashes[1:])
    n, step = len(pairs), 128
    out = np.zeros((1 + n // step, step, 64), np.uint8)
    rows = out.reshape(-1, 64)
    rows[1 : n + 1] = np.unpackbits(pairs.view(np.uint8)).reshape(-1, 64)
    # Eight counts are added as one number: inside a step none reaches 256.
    np.cumsum(out.view(np.uint64), axis=1, out=out.view(np.uint64))
    out[1:] += np.cumsum(out[:-1, -1], axis=0, dtype=np.uint8)[:, None]
    return rows[: n + 1]


def _windows(sums: np.ndarray, size: int) -> np.ndarray:
    """The fingerprint of every window of size words, at least two."""
    return np.packbits((sums[size - 1 :] - sums[: 1 - size] > (size - 1) // 2).ravel()).view(np.uint64)


def size_class(words: int) -> int:
    return max(c for c in CLASSES if c <= max(CLASSES[0], words * 4 // 5))


def _stretches(words: int, size: int) -> list[int]:
    """Where an item's stretches start."""
    last = words - size
    return sorted({0, last // 2, last, *range(0, last, size)})


_NEAR = [np.array([sum(1 << b for b in bits) for n in range(near + 1) for bits in combinations(range(64 // BLOCKS), n)], np.uint16) for near in NEAR]


class Table:
    """The multi-index of one class's stretches: of prints by their places."""

    def __init__(self, prints: np.ndarray):
        self.prints, self.blocks = prints, []
        for values, near in zip(prints.view(np.uint16).reshape(-1, BLOCKS).T, _NEAR, strict=True):
            entered = values[:, None] ^ near[None, :]
            order = np.argsort(entered, axis=None, kind="stable")
            ends = np.cumsum(np.bincount(entered.ravel(), minlength=1 << 16))
            places = order // len(near)
            self.blocks.append((np.diff(ends, prepend=0) > 0, np.r_[0, ends], np.diff(ends, prepend=0), places, prints[places]))

    def near(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of fps and of prints of all pairs within RADIUS."""
        out = []
        for (known, starts, counts, places, prints), values in zip(self.blocks, fps.view(np.uint16).reshape(-1, BLOCKS).T.astype(np.intp, "C"), strict=True):
            at = known[values].nonzero()[0]
            if len(at):
                v = values[at]
                n = counts[v]
                ends = n.cumsum()
                entry = np.arange(ends[-1]) + (starts[v] - ends + n).repeat(n)
                close = (np.bitwise_count(prints[entry] ^ fps[at].repeat(n)) <= RADIUS).nonzero()[0]
                if len(close):
                    out.append(at[ends.searchsorted(close, "right")] * len(self.prints) + places[entry[close]])
        pairs = np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)
        return np.divmod(pairs, len(self.prints))


class Index:
    """Items, and for each class the table of their stretches, with the item and the place in it of each."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.items = [(i, w, shingles(w)) for i, w in ((i, words_of(t)) for i, t in items) if w]
        #: Items of one word, which no window of CLASSES is in.
        self.single: dict[bytes, list[int]] = {}
        taken: dict[int, list[tuple[int, int, int]]] = {}
        for n, (_, w, _) in enumerate(self.items):
            if len(w) == 1:
                self.single.setdefault(w[0], []).append(n)
                continue
            size = size_class(len(w))
            prints = _windows(_sums(_hashes(b" ".join(w))[0]), size)
            taken.setdefault(size, []).extend((int(prints[at]), n, at) for at in _stretches(len(w), size))
        self.tables = {}
        for size, of in taken.items():
            prints, item, place = zip(*of, strict=True)
            self.tables[size] = (Table(np.array(prints, np.uint64)), np.array(item), np.array(place))

    def found(self, texts: Iterable[str | None]) -> Iterator[list[tuple[int, int, int, float]]]:
        """For each text, (item's place, first word, words, similarity) of the best window for each item that it leaks."""
        held, size = [], 0
        for text in texts:
            held.append(_cut(text))
            size += len(held[-1])
            if size >= HELD:
                yield from self._search(held)
                held, size = [], 0
        yield from self._search(held)

    def leaks(self, text: str | None) -> list[tuple[int, int, int, float]]:
        return next(self.found([text]))

    def _search(self, docs: list[bytes]) -> Iterator[list[tuple[int, int, int, float]]]:
        hashes, starts = _hashes(b" ".join(docs))
        ends = np.searchsorted(starts, np.cumsum([len(d) + 1 for d in docs]))  # of each document's words
        hits: list[dict[int, set[int]]] = [{} for _ in docs]  # by document: of each item, where its windows may start
        for lo in range(0, len(hashes), CHUNK):
            part = hashes[lo : lo + CHUNK + LONGEST - 1]
            sums = _sums(part)
            for size, (table, items, places) in self.tables.items():
                if len(part) < size:
                    continue
                at, n = table.near(_windows(sums, size)[:CHUNK])
                at = at + lo
                of = np.searchsorted(ends, at, "right")
                inside = at + size <= ends[of]
                first = np.where(of > 0, ends[of - 1], 0)
                for d, i, start in zip(of[inside].tolist(), items[n[inside]].tolist(), (at - places[n] - first)[inside].tolist(), strict=True):
                    hits[d].setdefault(i, set()).add(start)
        for cut, of in zip(docs, hits, strict=True):
            doc = cut.split() if of or self.single else []
            for word in self.single.keys() & set(doc):
                of.update(dict.fromkeys(self.single[word], {doc.index(word)}))
            yield [(i, *best) for i, at in sorted(of.items()) if (best := self._best(doc, i, at))]

    def _best(self, doc: list[bytes], item: int, starts: set[int]) -> tuple[int, int, float] | None:
        """First word, words and similarity of the best of the windows around the starts."""
        _, words, mine = self.items[item]
        size, last = min(len(words), len(doc)), max(0, len(doc) - len(words))
        n, total = max(1, size - SHINGLE + 1), mine.total()
        least = SIMILARITY / (1 + SIMILARITY) * (n + total) - 1e-9  # shingles that a leak has in common at least
        slack, best, runs = 2 + len(words) // 8, None, []
        for at in sorted(starts):
            lo, hi = min(max(0, at - slack), last), min(max(0, at + slack), last)
            if runs and lo <= runs[-1][1]:
                runs[-1][1] = max(hi, runs[-1][1])
            else:
                runs.append([lo, hi])
        for lo, hi in runs:
            known = list(map(mine.__contains__, _shingles(doc[lo : hi + size]))) if size >= SHINGLE else None
            if known is not None and sum(known) < least:
                continue
            for at in range(lo, hi + 1):
                if known is not None and sum(known[at - lo : at - lo + n]) < least:
                    continue
                s = similarity(shingles(doc[at : at + size]), mine)
                if s >= SIMILARITY and (best is None or s > best[2]):
                    best = (at, size, s)
        return best


@lru_cache(4)
def _index(items: tuple[tuple[int | None, str | None], ...]) -> Index:
    """Made once in a process, not once a task."""
    return Index(list(items))


def _blocks(items: DataFrame) -> Iterator[tuple[tuple[int | None, str | None], ...]]:
    block, chars = [], 0
    for row in items.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        block.append((row[0], row[1]))
        chars += len(row[1] or "")
        if chars >= BLOCK_CHARS:
            yield tuple(block)
            block, chars = [], 0
    if block:
        yield tuple(block)


_FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("similarity", pa.float64())])


def _finder(items):
    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(items.value)
        for batch in batches:
            rows = []
            for d, found in zip(batch.column(0).to_pylist(), index.found(x.as_py() for x in batch.column(1)), strict=True):
                rows += [(d, index.items[i][0], at, n, s) for i, at, n, s in found]
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(_FOUND.names, r, strict=True)) for r in rows], schema=_FOUND)

    return find


def _tester(items):
    @F.arrow_udf("boolean")
    def leaks_none(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = _index(items.value)
        for batch in texts:
            yield pa.array([not found for found in index.found(x.as_py() for x in batch)], pa.bool_())

    return leaks_none


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, first_word, n_words, similarity of every document and item that it leaks."""
    spark, docs = docs.sparkSession, docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema, out = "doc_id long, item_id long, first_word long, n_words long, similarity double", None
    for block in _blocks(items):
        found = docs.mapInArrow(_finder(spark.sparkContext.broadcast(block)), schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], schema)


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that leak no item."""
    for block in _blocks(items):
        docs = docs.where(_tester(docs.sparkSession.sparkContext.broadcast(block))(F.col("text").cast("string")))
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
