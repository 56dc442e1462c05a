"""Quality classifier: supervised subword embeddings.

A document's features are its words, the character n-grams of each word (of 2 to
4 bytes, ends marked, whatever the word's length), and its pairs of neighbouring
words, each hashed to a bucket that has a learned vector.  The vectors are
averaged over the document and a softmax layer gives the two classes'
probabilities.  Both are trained by stochastic gradient descent in numpy, on a
bounded sample of the labelled rows.

Averaging and the last layer are linear, so for scoring the vectors fold into
one weight a bucket, and the weights of a word and its n-grams into one sum,
which a bounded memo keeps.  Weights are multiples of 1 / FIXED, so that sums of
them are exact and equal texts have equal scores, whatever was added up first.
Long texts are read in blocks and long words in slices; nothing of them is left out.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.arrow import blocks, ship, worker_memo

BUCKET_BITS, DIM = 18, 8
BUCKETS = 1 << BUCKET_BITS
#: Bytes of the n-grams, and bytes of text whose n-grams are taken at once.
NGRAMS, SLICE = (2, 3, 4), 1 << 18
#: The bucket of a word that is said twice in a row.
SAME_PAIR = 0
#: At most so many labelled rows are learned from, those with the least hashed identifiers,
#: of at most so many bytes together, none longer than the last.
SAMPLE, SAMPLE_BYTES, LONGEST = 3000, 32 << 20, 4 << 20
EPOCHS, RATE = 8, 0.4
THRESHOLD = 0.3
#: Words, and bytes of words, that a worker's memo keeps.
MEMO_WORDS, MEMO_BYTES = 300_000, 16 << 20
FIXED = 1 << 24
_MIX = np.uint64(0x9E3779B97F4A7C15)


def gram_buckets(raw: np.ndarray, n: int) -> np.ndarray:
    """The buckets of the n-grams that start at each byte."""
    value = np.full(len(raw) - n + 1, n, np.uint64)
    for i in range(n):
        value = (value << np.uint64(8)) | raw[i : len(raw) - n + 1 + i]
    return ((value * _MIX) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def grams(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The n-grams of every word, in slices: the word's number and the bucket of each."""
    raw = np.frombuffer(b"<" + b"><".join(words) + b">", np.uint8)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 2)
    for at in range(0, len(raw), SLICE):
        part = raw[at : at + SLICE + max(NGRAMS) - 1]
        low, high = np.searchsorted(ends, (at, at + len(part) - 1), side="right")
        owner = np.repeat(np.arange(low, high + 1), np.diff(np.concatenate(([at], ends[low:high], [at + len(part)]))))
        for n in NGRAMS:
            k = min(len(part) - n + 1, SLICE)
            if k > 0:
                whole = owner[:k] == owner[n - 1 : n - 1 + k]
                yield owner[:k][whole], gram_buckets(part[: k + n - 1], n)[whole]


def word_buckets(words: list[bytes]) -> np.ndarray:
    """The words' own buckets."""
    return np.fromiter((zlib.crc32(w, 1) for w in words), np.int64, len(words)) % BUCKETS


def word_hashes(words: list[bytes]) -> np.ndarray:
    """Hashes that pairs are made of."""
    return np.fromiter((zlib.crc32(w, 7) for w in words), np.uint64, len(words))


class Words:
    """Row numbers of words; by row: the hashed word, the sum of the weights of the word and its n-grams, and their number."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.rows, self.held = weights, {}, 0
        self.hash, self.total, self.n = (np.zeros(MEMO_WORDS, k) for k in (np.uint64, np.float64, np.int64))

    def learn(self, words: list[bytes]) -> None:
        missing = [w for w in dict.fromkeys(words) if w not in self.rows]
        if len(self.rows) + len(missing) > len(self.n) or self.held > MEMO_BYTES:
            self.rows.clear()
            self.held = 0
            missing = list(dict.fromkeys(words))
            if len(missing) > len(self.n):
                self.hash, self.total, self.n = (np.zeros(2 * len(missing), a.dtype) for a in (self.hash, self.total, self.n))
        at, k = len(self.rows), len(missing)
        total, n = self.weights[word_buckets(missing)], np.ones(k, np.int64)
        for owner, buckets in grams(missing) if k else ():
            total += np.bincount(owner, self.weights[buckets], k)
            n += np.bincount(owner, minlength=k)
        self.hash[at : at + k], self.total[at : at + k], self.n[at : at + k] = word_hashes(missing), total, n
        self.held += sum(map(len, missing))
        self.rows.update(zip(missing, range(at, at + k), strict=True))

    def numbers(self, words: list[bytes]) -> np.ndarray:
        try:
            return np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))
        except KeyError:
            self.learn(words)
            return np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))


def pair_buckets(hashes: np.ndarray) -> np.ndarray:
    """Buckets of neighbouring words; a word that follows itself is one feature, whatever the word."""
    mixed = hashes[:-1] * _MIX + hashes[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    found = ((mixed >> np.uint64(31)) % np.uint64(BUCKETS)).astype(np.int64)
    found[hashes[:-1] == hashes[1:]] = SAME_PAIR
    return found


def features(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and how often each occurs."""
    found, last = [], np.zeros(0, np.uint64)
    for block in blocks(data):
        words = block.split()
        if words:
            hashes = np.concatenate((last, word_hashes(words)))
            last = hashes[-1:]
            found.append(np.unique(np.concatenate([word_buckets(words), pair_buckets(hashes), *(b for _, b in grams(words))]), return_counts=True))
    if len(found) == 1:
        return found[0]
    counts = np.zeros(BUCKETS, np.int64)
    for buckets, n in found:
        counts[buckets] += n
    return (at := np.flatnonzero(counts)), counts[at]


class Model:
    """Folded weights of the buckets and the bias; ``score`` is the probability of label 1."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = np.rint(weights.astype(np.float64) * FIXED) / FIXED, float(bias)
        self.key = hashlib.sha256(self.weights.tobytes() + repr(self.bias).encode()).hexdigest()

    def scorer(self) -> Scorer:
        """This worker's scorer for the model; the one of an earlier model is dropped."""
        return worker_memo(("quality", self.key), lambda: Scorer(self))


class Scorer:
    def __init__(self, model: Model):
        self.model, self.words = model, Words(model.weights)

    def score(self, data: bytes) -> float:
        total, n, last = 0.0, 0, np.zeros(0, np.uint64)
        for block in blocks(data):
            rows = self.words.numbers(block.split())
            if len(rows):
                hashes = np.concatenate((last, self.words.hash[rows]))
                last = hashes[-1:]
                total += float(self.words.total[rows].sum()) + float(self.model.weights[pair_buckets(hashes)].sum())
                n += int(self.words.n[rows].sum()) + len(hashes) - 1
        z = self.model.bias + (total / n if n else 0.0)
        return float(1 / (1 + np.exp(-z)))


def train(texts: list[bytes], labels: list[int], epochs: int = EPOCHS, rate: float = RATE, seed: int = 6) -> Model:
    """Fit vectors and softmax by SGD, one document a step, the rate falling to 0.

    A vector's step is its share of the document's average, times half the
    document's distinct buckets, as an average's own gradient is small; no share
    counts as more than four times the mean one.  Without rows of both labels
    the model gives the share of label 1, or a half.
    """
    y = np.asarray(labels, np.int64)
    share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
    prior = float(np.log(share / (1 - share)))
    if len(set(labels)) < 2:
        return Model(np.zeros(BUCKETS, np.float32), prior)
    rng = np.random.default_rng(seed)
    docs = []
    for text in texts:
        buckets, counts = features(text)
        docs.append((buckets.astype(np.int32), (counts / max(1, counts.sum())).astype(np.float32)))
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    layer, bias = np.zeros((DIM, 2), np.float32), np.array([0, prior], np.float32)
    steps, done = epochs * len(docs), 0
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            buckets, part = docs[i]
            r = rate * (1 - done / steps)
            done += 1
            hidden = part @ vectors[buckets]
            z = hidden @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = layer @ p
            layer -= r * np.outer(hidden, p)
            bias -= np.float32(0.1 * r) * p
            # each distinct bucket moves by its share of the document, scaled up as plain averages are small
            vectors[buckets] -= (r * len(buckets) * 0.5) * np.minimum(part, 4 / max(1, len(buckets)))[:, None] * back[None]
    way = layer[:, 1] - layer[:, 0]
    return Model(vectors @ way, float(bias[1] - bias[0]))


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the identifier as text is divisible by 5; false for a null identifier."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Train on labelled, not held-out rows of ``docs``: on the ``sample`` with the least hashed identifiers, as far as ``sample_bytes`` go.

    Rows equal in identifier, label and text count once; texts over LONGEST bytes
    aren't learned from.  The bounds are these parameters, so what the driver
    gathers doesn't grow with the tables, however often an identifier occurs.
    """
    known = labels.select(F.col(id_col).alias("label_id"), F.col(label_col).cast("int").alias("label"))
    known = known.filter(F.col("label_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("label_id"))).distinct()
    order = [F.xxhash64("label_id"), "label_id", "label"]
    chosen = known.orderBy(*order).limit(sample)
    texts = docs.select(F.col(id_col).alias("label_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body")).withColumn("h", F.xxhash64("body"))
    sizes = texts.select("label_id", "h", F.octet_length("body").cast("long").alias("size")).filter(F.col("size") <= LONGEST)
    # one row of each identifier, label and text; then as many as the bounds allow, a number that doesn't grow
    distinct = sizes.join(F.broadcast(chosen), "label_id").groupBy("label_id", "label", "h").agg(F.min("size").alias("size"))
    taken = distinct.orderBy(*order, "h").limit(sample).withColumn("sum", F.sum("size").over(Window.orderBy(*order, "h").rowsBetween(Window.unboundedPreceding, 0)))
    taken = taken.filter(F.col("sum") <= sample_bytes).select("label_id", "label", "h")
    met = texts.join(F.broadcast(taken), ["label_id", "h"]).groupBy("label_id", "label", "h").agg(F.first("body").alias("body"))
    rows = met.select("label_id", "label", "body").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["label_id"], r["label"], bytes(r["body"])))
    return train([bytes(r["body"]) for r in rows], [r["label"] for r in rows])


def score_column(spark, model: Model, text_col: Column) -> Column:
    """The score of each text (null: as empty); the model is broadcast, its size is fixed."""
    ship(spark)
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = sent.value.scorer()
        for bodies in parts:
            yield pd.Series([scorer.score(body) for body in bodies], dtype="float64")

    return score(F.coalesce(text_col, F.lit("")).cast("binary"))


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    Null and empty texts get the score of a document without features; very
    long texts and words are read whole; repeated rows get equal scores; a null
    identifier is never held out; an empty table gives no rows, and without
    labels of both kinds all scores are equal.  Other columns are never read.
    """
    model = fit(docs, labels, sample)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    scored = ids.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(docs.sparkSession, model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with all their columns, whatever these are called.

    Odd rows are scored as in quality_scores; an empty table stays empty.
    """
    model = fit(docs, labels, sample)
    return docs.filter(score_column(docs.sparkSession, model, F.col("text")) >= threshold)
