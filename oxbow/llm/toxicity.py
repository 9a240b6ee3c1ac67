"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word, a run of letters and digits in lower case, is the bag of its hashed character n-grams, of MIN_GRAM to MAX_GRAM
characters with its ends marked.  A passage, of PASSAGE words, is the mean of its words' vectors (a shorter one's is over LEAST_WORDS at least), and a word the mean of its
n-grams' embeddings; a linear softmax over that tells the classes.  Embeddings and softmax are trained together, by
Adagrad, so a misspelling, or a word never seen, shares the vectors of its n-grams.  A word right after itself counts once.

A text's score is that of its most toxic passage, of those that start at any of its words, so one passage in a long text is not averaged away.  In training a
labelled text stands for passages of its own: at first one at random, later the most toxic one by the model so far
(multiple-instance learning: one positive passage makes a text positive).

Training takes at most TRAIN_ROWS labelled rows of each class, those of smallest crc32 of their id, none of which is
held out, and their whole texts.  The score is calibrated on the same rows: one of PARTS parts is scored by a model of
the others, and the bias moved so that the cut that tells the classes best there (most F0.5, in the middle of the gap)
scores THRESHOLD.  Scores read whole texts and nothing but texts, a CHUNK of
characters at a time.  As the softmax is linear in averaged embeddings, an n-gram adds one number to its passage.

Defined results: a null or empty text, or one without words, scores as the softmax's bias alone.  A row without doc_id
is not held out, and cannot be labelled.  Repeated rows get equal scores; of repeated labels the largest counts, of
repeated documents the smallest text trains.  Without labelled rows of both classes every score is the share of toxic ones
(0 if there are none).  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import read

MIN_GRAM, MAX_GRAM, BUCKETS, WIDTH = 3, 5, 1 << 17, 8
PASSAGE, LEAST_WORDS, TRAIN_ROWS, PARTS, CHUNK = 40, 20, 3000, 3, 1 << 20
STEPS, WARM_STEPS, WARM_PASSAGE, RATE, BATCH, SEED = 700, 200, 200, 0.5, 64, 7
THRESHOLD, HELD_OUT = 0.7, 1
_GRAMS = range(MIN_GRAM, MAX_GRAM + 1)


class _Letters:
    """Whether a code point is a letter or digit, as a table made when first needed."""

    table: np.ndarray | None = None

    @classmethod
    def of(cls, codes: np.ndarray) -> np.ndarray:
        if cls.table is None:
            cls.table = np.array([chr(c).isalnum() for c in range(0x110000)])
        return cls.table[codes]


def grams_of(text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """The bucket and the word's number of every n-gram of the text, and the number of words."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    word = _Letters.of(codes)
    codes = np.where(word, codes, 1).astype(np.uint32)
    starts = word[1:] & ~word[:-1]
    n_words = int(starts.sum())
    if not n_words:
        return np.zeros(0, np.int32), np.zeros(0, np.int32), 0
    nth = np.r_[0, np.cumsum(starts)].astype(np.int32) - 1  # of the word at, or else before, a place
    mixed = codes * np.uint32(0x9E3779B1)
    mixed ^= mixed >> np.uint32(15)
    buckets, owners = [], []
    h, inner = mixed, np.ones(len(codes), bool)
    for n in range(2, MAX_GRAM + 1):
        h = (h[: len(codes) - n + 1] * np.uint32(0x85EBCA77) + mixed[n - 1 :]) if n <= len(codes) else h[:0]
        if n >= 3:
            inner = inner[: len(h)] & word[n - 2 : n - 2 + len(h)]
        if n in _GRAMS:
            at = np.flatnonzero(inner)
            mine = h[at] + np.uint32(n)
            buckets.append(((mine ^ (mine >> np.uint32(13))) * np.uint32(0xC2B2AE3D) >> np.uint32(15)).astype(np.int32))
            owners.append(nth[at + 1])
    bucket, owner = np.concatenate(buckets), np.concatenate(owners)
    same = np.bincount(owner, bucket.astype(float) ** 1.5, n_words)
    again = np.r_[False, same[1:] == same[:-1]]
    if again.any():
        kept = ~again[owner]
        bucket, owner = bucket[kept], (np.cumsum(~again) - 1).astype(np.int32)[owner[kept]]
        n_words = int((~again).sum())
    return bucket, owner, n_words


def chunks_of(text: str) -> Iterator[str]:
    """The text in pieces of about CHUNK characters that end between words."""
    at = 0
    while at < len(text):
        end = at + CHUNK
        while end < len(text) and text[end].isalnum():
            end += 1
        yield text[at:end]
        at = end


class Model:
    def __init__(self):
        rng = np.random.default_rng(SEED)
        self.vectors = (rng.uniform(-0.5, 0.5, (BUCKETS, WIDTH)) / WIDTH).astype(np.float32)
        self.weights = np.zeros((WIDTH, 2), np.float32)
        self.bias = np.zeros(2, np.float32)
        self.share: float | None = None

    def _told(self) -> np.ndarray:
        return self.vectors @ (self.weights[:, 1] - self.weights[:, 0])

    def fit(self, texts: list[str], labels: list[int]) -> Model:
        return self.fit_bags([bags_of(t) for t in texts], labels)

    def fit_bags(self, docs: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: list[int]) -> Model:
        y = np.array(labels)
        if len(set(labels)) < 2:
            self.share = float(y.mean()) if len(y) else 0.0
            return self
        rng = np.random.default_rng(SEED)
        seen_v, seen_w = np.full((BUCKETS, 1), 1e-6, np.float32), np.full_like(self.weights, 1e-6)
        step = 0
        while step < STEPS:
            told = self._told()
            for at in np.array_split(rng.permutation(len(y)), max(1, len(y) // BATCH)):
                step += 1
                bags, per, kept = [], [], []
                for k in at:
                    bucket, owner, ends = docs[k]
                    n = len(ends) - 1
                    if not n:
                        continue
                    size = WARM_PASSAGE if step <= WARM_STEPS else PASSAGE
                    lo = 0 if n <= size else int(rng.integers(0, n - size + 1)) if step <= WARM_STEPS else _worst(_word_means(told[bucket], owner, n))
                    hi = min(n, lo + size)
                    lens = np.diff(ends[lo : hi + 1])
                    bags.append(bucket[ends[lo] : ends[hi]])
                    per.append(np.repeat(1.0 / (lens * max(LEAST_WORDS, hi - lo)), lens))
                    kept.append(k)
                if not kept:
                    continue
                grams, per, sizes = np.concatenate(bags), np.concatenate(per).astype(np.float32), np.array([len(b) for b in bags])
                mine = np.repeat(np.arange(len(bags)), sizes)
                h = np.add.reduceat(self.vectors[grams] * per[:, None], np.r_[0, np.cumsum(sizes)[:-1]], axis=0)
                z = h @ self.weights + self.bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                g = p - np.eye(2, dtype=np.float32)[y[kept]]
                g_w, g_h = h.T @ g / len(kept), g @ self.weights.T
                seen_w += g_w**2
                self.weights -= RATE * g_w / np.sqrt(seen_w)
                self.bias -= 0.1 * g.mean(0)
                buckets, back = np.unique(grams, return_inverse=True)
                g_v = np.stack([np.bincount(back, g_h[mine, d] * per, len(buckets)) for d in range(WIDTH)], axis=1).astype(np.float32)
                seen_v[buckets] += (g_v**2).mean(1, keepdims=True)
                self.vectors[buckets] -= RATE * g_v / np.sqrt(seen_v[buckets])
        return self

    def calibrate(self, docs: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: list[int]) -> Model:
        """Moves the bias so that the cut that tells the classes best, of the rows that a model of the others scores, scores THRESHOLD."""
        apart = np.random.default_rng(SEED).permutation(len(labels)) % PARTS == 0
        ours, theirs, y = np.flatnonzero(~apart), np.flatnonzero(apart), np.array(labels)
        if len(set(y[ours])) == 2 and len(set(y[theirs])) == 2:
            scorer = Model().fit_bags([docs[i] for i in ours], y[ours].tolist()).scorer()
            z = np.array([scorer.margin([docs[i]]) for i in theirs])
            self.bias[1] += np.log(THRESHOLD / (1 - THRESHOLD)) - _best_cut(z, y[theirs])
        return self

    def scorer(self) -> Scorer:
        return Scorer(self._told(), float(self.bias[1] - self.bias[0]), self.share)


def bags_of(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buckets of a text's n-grams by word, the words' numbers, and where each word's begin."""
    parts, words = [], 0
    for chunk in chunks_of(text):
        bucket, owner, n = grams_of(chunk)
        order = np.argsort(owner, kind="stable")
        parts.append((bucket[order], owner[order] + words))
        words += n
    bucket, owner = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int32),) * 2
    return bucket, owner, np.searchsorted(owner, np.arange(words + 1))


def _best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """The cut of most F0.5, which weighs false alarms more than misses, in the middle between the scores on its sides."""
    order = np.argsort(-z, kind="stable")
    z, caught = z[order], np.cumsum(y[order])
    ends = np.r_[z[1:] < z[:-1], False]  # a cut stands between different scores
    f = np.where(ends, 1.25 * caught / (np.arange(1, len(z) + 1) + 0.25 * caught[-1]), -1.0)
    k = int(f.argmax())
    return float(z[k] + z[k + 1]) / 2 if ends.any() else 0.0


def _word_means(told: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, told, n) / np.maximum(np.bincount(owner, minlength=n), 1)


def _passages(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where passages start, at every word that a whole one fits after, and their means."""
    n = len(words)
    starts = np.arange(max(1, n - PASSAGE + 1))
    sums = np.r_[0, np.cumsum(words)]
    return starts, (sums[np.minimum(starts + PASSAGE, n)] - sums[starts]) / min(max(n, LEAST_WORDS), PASSAGE)


def _worst(words: np.ndarray) -> int:
    starts, means = _passages(words)
    return int(starts[means.argmax()])


class Scorer:
    """What an n-gram of each bucket adds, and the bias."""

    def __init__(self, told: np.ndarray, bias: float, share: float | None):
        self.told, self.bias, self.share = told.astype(np.float32), bias, share

    def score(self, text: str | None) -> float:
        if self.share is not None:
            return self.share
        z = self.margin((b, o, range(n + 1)) for b, o, n in map(grams_of, chunks_of(text or "")))
        return 1 / (1 + float(np.exp(-np.clip(z, -500, 500))))

    def margin(self, chunks) -> float:
        """The logarithm of the odds; chunks of the text: buckets, words' numbers, and one more than there are words of anything."""
        words = [_word_means(self.told[b], o, len(ends) - 1) for b, o, ends in chunks if len(ends) > 1]
        return self.bias + (float(_passages(np.concatenate(words))[1].max()) if words else 0.0)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == HELD_OUT, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of the labelled documents that are not held out; labels: doc_id, toxic."""
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    order = [F.crc32(F.col("doc_id").cast("string").cast("binary")), F.col("doc_id")]
    ids = [r for x in (0, 1) for r in known.where(F.col("toxic") == x).orderBy(*order).limit(TRAIN_ROWS).select("doc_id", "toxic").collect()]
    spark = docs.sparkSession
    chosen = F.broadcast(spark.createDataFrame(ids, "l_id long, toxic int"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.join(chosen, F.col("doc_id") == F.col("l_id")).select("l_id", text.alias("text"), "toxic").groupBy("l_id").agg(F.min(F.struct("text", "toxic")).alias("r"))
    rows = sorted((r[0], r[1][0], r[1][1]) for r in rows.collect())
    bags, classes = [bags_of(r[1]) for r in rows], [r[2] for r in rows]
    return Model().fit_bags(bags, classes).calibrate(bags, classes)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of each document."""
    held = docs.sparkSession.sparkContext.broadcast(model.scorer())

    @F.arrow_udf("double")
    def of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array([held.value.score(x.as_py()) for x in batch], pa.float64())

    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), of(F.col("text").cast("string")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, train(docs, read(spark, sf_dir, "labels")))
