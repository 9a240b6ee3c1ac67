"""SimHash near-duplicates: fingerprints, BK-trees over shards of them, and components of the links.

A fingerprint has a bit for each of 64 that more than half of the text's 4-word shingle hashes have set.  Two
fingerprints link if they differ in at most RADIUS bits.  Shards: the 64 bits are cut into BLOCKS blocks; of
BLOCKS blocks at most RADIUS can differ, so two linked fingerprints agree in AGREE = BLOCKS - RADIUS blocks at
least, and meet in the shard of those blocks and their values.  Every set of AGREE blocks has its shards, so no link
is missed.  In every shard a BK-tree is grown over its distinct fingerprints: a node's children are keyed by their
integer distance to it.  All members ask the tree at once for their neighbours: those at distance d of a node follow
only its edges keyed d - RADIUS to d + RADIUS, as no link can join others (triangle inequality), and no edge to
a subtree that is already joined with all that would follow it.  A shard gives at most one link less than it has
members: a spanning forest, never all pairs.

The trees stand where their shard's rows are and are not broadcast: all shards' trees together grow with the corpus.
A shard of more than SHARD members is cut into pieces of SHARD; a task holds two pieces at a time, and every pair
of pieces has its task.  Exact copies are one fingerprint with a count before any of this.

Defined results: a null or empty text, or one of white space, has fingerprint zero, linked like any other.
Repeated rows and null ids keep their rows; a component without any id has a null component_id.  An empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import fresh, join_small, read, stage
from ._graph import components

SHINGLE, SEED, RADIUS = 4, 42, 4
BLOCKS, AGREE = 6, 2
SHARD = 20_000
#: So few that follow an edge are not worth a look at whether they are joined with its subtree already.
FEW = 8
#: Shingles hashed at a time: a very long text needs no more memory than this many.
CHUNK = 50_000
_CUTS = [64 * k // BLOCKS for k in range(BLOCKS + 1)]


def fingerprint(text: bytes | None) -> int:
    """Unsigned; text in UTF-8."""
    words = (text or b"").lower().split()  # of bytes, both know ASCII only
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    n, set_bits = len(words) - SHINGLE + 1, np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, n, CHUNK):
        part = words[at : at + CHUNK + SHINGLE - 1]
        digests = b"".join([digest(s, SEED) for s in map(b" ".join, zip(*(part[k:] for k in range(SHINGLE)), strict=False))])
        set_bits += _bit_sums(np.frombuffer(digests, np.uint8).reshape(-1, 8))
    return int.from_bytes(np.packbits(2 * set_bits > n).tobytes(), "big")


def _bit_sums(rows: np.ndarray) -> np.ndarray:
    """How many of rows (8 bytes, the highest first) have each of 64 bits set."""
    return np.concatenate([np.bincount(rows[:, k], minlength=256) @ _BITS for k in range(8)])


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprints(text: Column) -> Column:
    """A column of fingerprints, as signed 64-bit numbers."""

    @F.arrow_udf("long")
    def of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array(np.fromiter((fingerprint(x.as_py()) for x in batch), np.uint64, len(batch)).view(np.int64))

    return of(text.cast("binary"))


class Tree:
    """A BK-tree over distinct fingerprints.  edges[x]: the children of the fingerprint at place x, by their distance to it.

    members[x]: the places in the subtree of x, its own first.
    """

    def __init__(self, fps: np.ndarray):
        self.fps, self.root = fps, 0
        self.edges: dict[int, dict[int, int]] = {}
        self.members: dict[int, np.ndarray] = {}
        todo = [np.arange(len(fps))]
        while todo:
            members = todo.pop()
            node, rest = int(members[0]), members[1:]
            self.members[node], edges = members, {}
            if len(rest):
                d = self.distance(rest, node)
                for k in np.flatnonzero(np.bincount(d)).tolist():
                    ring = rest[d == k]
                    edges[k] = int(ring[0])
                    todo.append(ring)
            self.edges[node] = edges

    def distance(self, places: np.ndarray, node: int) -> np.ndarray:
        return np.bitwise_count(self.fps[places] ^ self.fps[node]).astype(np.int64)

    def links(self, radius: int) -> list[tuple[int, int]]:
        """A spanning forest of the links of at most radius, as pairs of places."""
        forest, todo = _Forest(len(self.fps)), [(self.root, self.members[self.root])]
        while todo:
            node, asking = todo.pop()
            d = self.distance(asking, node)
            if len(found := asking[(d > 0) & (d <= radius)]):
                forest.join(node, found)
            for k, child in self.edges[node].items():
                near = asking[np.abs(d - k) <= radius]
                if len(near) and (len(near) < FEW or not forest.one(near, self.members[child])):
                    todo.append((child, near))
        return forest.links


class _Forest:
    def __init__(self, n: int):
        self.parent, self.links = np.arange(n), []

    def roots(self, places: np.ndarray) -> np.ndarray:
        r = self.parent[places]
        while not np.array_equal(r, up := self.parent[r]):
            r = up
        self.parent[places] = r
        return r

    def join(self, node: int, places: np.ndarray) -> None:
        """Links node with the places, one of each component."""
        own = now = int(self.roots(np.array([node]))[0])
        roots = self.roots(places)
        apart = roots != own
        if not apart.any():
            return
        components, first = np.unique(roots[apart], return_index=True)
        for c, k in zip(components.tolist(), places[apart][first].tolist(), strict=True):
            self.links.append((node, k))
            self.parent[max(c, now)], now = min(c, now), min(c, now)

    def one(self, a: np.ndarray, b: np.ndarray) -> bool:
        """Whether all are in one component."""
        r = self.roots(a)
        return bool((r == r[0]).all() and (self.roots(b) == r[0]).all())


def link(fps: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning forest of the links between distinct unsigned fingerprints, as pairs of places."""
    return Tree(fps).links(radius) if len(fps) else []


def _shards(fp: Column) -> Column:
    """The shards of a fingerprint: for each set of AGREE blocks, its number and the blocks' values."""
    out = []
    for n, blocks in enumerate(combinations(range(BLOCKS), AGREE)):
        mask = sum(((1 << _CUTS[k + 1]) - (1 << _CUTS[k])) for k in blocks)
        signed = mask - (1 << 64) if mask >> 63 else mask
        out.append(F.struct(F.lit(n).cast("byte").alias("set"), fp.bitwiseAND(F.lit(signed)).alias("value")))
    return F.array(*out)


def _link_sorted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each shard; rows come in the order of their shards (set, value, piece)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    held: list[np.ndarray] = []
    found: list[np.ndarray] = []
    key = None

    def linked() -> list[np.ndarray]:
        fps = np.unique(np.concatenate(held))
        pairs = link(fps)
        return [fps.view(np.int64)[np.array(pairs)]] if pairs else []

    def flushed() -> pa.RecordBatch:
        pairs = np.concatenate([np.zeros((0, 2), np.int64), *found])
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=schema)

    for batch in batches:
        if not batch.num_rows:
            continue
        s, v, p, q, f = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
        f = f.view(np.uint64)
        cut = np.flatnonzero((s[1:] != s[:-1]) | (v[1:] != v[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])) + 1
        starts, ends = np.r_[0, cut], np.r_[cut, len(f)]
        for at, end in zip(starts, ends, strict=True):
            k = (s[at], v[at], p[at], q[at])
            if k != key:
                if key is not None:
                    found += linked()
                key, held = k, []
            held.append(f[at:end])
        yield flushed()
    if key is not None:
        found += linked()
        yield flushed()


def links(distinct: DataFrame) -> DataFrame:
    """a, b: links between the values of distinct (fp, without repeats) that join all that are linked."""
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = distinct.select("fp", F.explode(_shards(F.col("fp"))).alias("s")).select(F.col("s.set").alias("set"), F.col("s.value").alias("value"), "fp")
    many = stage(placed.groupBy("set", "value").agg(F.count("*").alias("n")).where("n > 1"), "shards")
    pieces = F.ceil(F.col("n") / SHARD).cast("int")
    many = many.select(F.col("set").alias("s_set"), F.col("value").alias("s_value"), pieces.alias("pieces"))
    placed = placed.join(many, (F.col("set") == F.col("s_set")) & (F.col("value") == F.col("s_value")), "inner")
    mine = F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int")
    # With one piece, that piece; with more, each other one: the pair of them is a task's.
    other = F.when(F.col("pieces") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("pieces") - 1), lambda x: x != mine))
    placed = placed.select("set", "value", mine.alias("mine"), F.explode(other).alias("other"), "fp")
    placed = placed.select("set", "value", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"), "fp")
    keys = ["set", "value", "p", "q"]
    return placed.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(_link_sorted, "a long, b long")


def groups(prints: DataFrame) -> DataFrame:
    """fp, component_id: the smallest doc_id of all that are linked; prints: doc_id, fp, staged."""
    own = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(own.select("fp")))
    own = stage(own.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", "root"), "rooted")
    linked, alone = own.where("root is not null"), own.where("root is null")
    least = linked.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component_id"))
    linked = join_small(linked, least, F.col("root") == F.col("r"), F.col("fp"), "inner")  # one component may have most fingerprints
    linked = linked.select(F.col("fp").alias("g_fp"), F.col("root").alias("g_root"), "component_id")
    return linked.unionByName(alone.select(F.col("fp").alias("g_fp"), F.col("fp").alias("g_root"), F.col("least").alias("component_id")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id of each document."""
    prints = stage(docs.select("doc_id", fingerprints(F.col("text")).alias("fp")), "prints")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(groups(prints), F.col("fp") == F.col("g_fp"), "left").select("doc_id", hexed.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that come first of their group, by doc_id (null last) and then by place."""
    row, fp = fresh(docs, "row", "fp")
    docs = stage(docs.withColumn(row, F.monotonically_increasing_id()).withColumn(fp, fingerprints(F.col("text"))), "docs")
    prints = stage(docs.select("doc_id", F.col(fp).alias("fp"), F.col(row).alias("row")), "prints")
    members = prints.join(groups(prints), F.col("fp") == F.col("g_fp"))
    first = members.groupBy("g_root").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row").alias("row")))["row"].alias(f"{row}_first"))
    kept = docs.join(first, F.col(row) == F.col(f"{row}_first"), "left_semi")
    return kept.drop(row, fp)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
