"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

A text is a sequence of tokens: runs of letters and digits, and runs of one other character. Each token enters as itself
(A-Z lower-cased) and as its shape (kind of characters and rough length; another one if it equals one of the two tokens before
it, as a repeated word does). N-grams of one and two tokens and of one to three shapes are hashed to a fixed number of
buckets; a bucket's value is the logarithm of its count plus one, and a text's vector has length one. The score is the
logistic function of a sparse dot product.

Training sees a bounded sample of labelled rows, hashed by Spark from their whole texts; every coordinate has its own
adaptive rate and an L1 threshold, so buckets without evidence keep weight zero. Examples are weighted by how many labelled
rows each sampled one stands for, which keeps the score a probability for the whole set.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.llm.common import worker_state
from pairforge.session import ensure_checkpoint_dir

BITS = 20
#: Most sampled rows of labels 0 and 1.
SAMPLE_DOCS = (3000, 3000)
MEMO = 100_000
SLICE = 64
#: Letters are ASCII letters and every byte of characters beyond ASCII; the rest are runs of one character.
TOKENS = re.compile(rb"[0-9A-Za-z\x80-\xff]+|([^0-9A-Za-z\x80-\xff\x00-\x20\x7f])\1*")


def _shape(token: bytes) -> bytes:
    if not (token[:1].isalnum() or token[0] >= 0x80):
        return token[:3]
    if token.isdigit():
        kind = b"9"
    elif len(token) > 1 and token.isupper():
        kind = b"AA"
    else:
        kind = b"Aa" if token[:1].isupper() else b"a"
    return kind + (b"1" if len(token) < 4 else b"2" if len(token) < 10 else b"3" if len(token) < 20 else b"4")


def _spread(x: np.ndarray, salt: int, bits: int) -> np.ndarray:
    """Buckets of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x >> np.uint64(64 - bits)).astype(np.int64)


class Hasher:
    """Whole texts -> (buckets in order, values). The hashes of tokens seen before are kept in a bounded table."""

    def __init__(self, bits: int = BITS):
        self.bits = bits
        self._row: dict[bytes, int] = {}
        self._hashes = np.zeros((2, 0), np.uint64)

    def _rows(self, docs: list[list[bytes]]) -> list[np.ndarray]:
        words = set().union(*docs)
        new = [t for t in words if t not in self._row]
        if len(self._row) + len(new) > MEMO and self._row:
            self._row, self._hashes, new = {}, np.zeros((2, 0), np.uint64), list(words)
        if new:
            n = len(self._row)
            self._row.update(zip(new, range(n, n + len(new)), strict=True))
            got = np.array([[zlib.crc32(t.lower()) for t in new], [zlib.crc32(_shape(t), 7) for t in new]], np.uint64)
            self._hashes = np.concatenate([self._hashes, got], axis=1)
        at = self._row.__getitem__
        return [np.fromiter(map(at, d), np.int64, len(d)) for d in docs]

    def features(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        docs = [[m.group() for m in TOKENS.finditer(t.encode("utf-8", "surrogatepass"))] if t else [] for t in texts]
        return [self._vector(r) for r in self._rows(docs)]

    def _vector(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(rows):
            return np.zeros(0, np.int64), np.zeros(0)
        word, shape = self._hashes[0][rows], self._hashes[1][rows].copy()
        for back in (1, 2):
            shape[back:][rows[back:] == rows[:-back]] += np.uint64(back)
        mul = np.uint64(0x100000001B3)
        with np.errstate(over="ignore"):
            pair = shape[:-1] * mul + shape[1:]
            grams = [(word, 1), (word[:-1] * mul + word[1:], 2), (shape, 3), (pair, 4), (pair[:-1] * mul + shape[2:], 5)]
        where, count = np.unique(np.concatenate([_spread(x, salt << 40, self.bits) for x, salt in grams]), return_counts=True)
        value = np.log1p(count)
        return where, value / np.sqrt((value * value).sum())


@dataclass
class Model:
    """Weights by bucket, and the intercept."""

    weights: np.ndarray
    bias: float

    def probability(self, where: np.ndarray, value: np.ndarray) -> float:
        return float(0.5 * (1 + np.tanh(0.5 * (self.weights[where] @ value + self.bias))))


def train(rows: list[tuple[int, float, np.ndarray, np.ndarray]], bits: int = BITS, epochs: int = 6, alpha: float = 1.0, beta: float = 1.0,
          l1: float = 0.1, l2: float = 0.1, seed: int = 0) -> Model:
    """Fit (label, weight of the row, buckets, values) rows by per-coordinate FTRL-proximal updates, one row at a time, in a
    seeded order. Rows of one label only give an intercept; no rows give probability one half."""
    ones, zeros = (sum(r[1] for r in rows if r[0] == y) for y in (1, 0))
    prior = float(np.log((ones + 1) / (zeros + 1)))
    size = 1 << bits
    if not ones or not zeros:
        return Model(np.zeros(size, np.float32), prior)
    z, n, w = np.zeros(size), np.zeros(size), np.zeros(size)
    bias, bias_n = prior, 0.0
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            y, weight, at, x = rows[i]
            zi, ni = z[at], n[at]
            wi = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
            g = weight * (0.5 * (1 + np.tanh(0.5 * (wi @ x + bias))) - y)
            gx = g * x
            root = np.sqrt(ni + gx * gx)
            z[at] = zi + gx - (root - np.sqrt(ni)) / alpha * wi
            n[at] = ni + gx * gx
            bias_n += g * g
            bias -= 0.1 * g / (1 + np.sqrt(bias_n))
    held = np.abs(z) > l1
    w[held] = -(z[held] - np.sign(z[held]) * l1) / ((beta + np.sqrt(n[held])) / alpha + l2)
    return Model(w.astype(np.float32), bias)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          sample_docs: tuple[int, int] = SAMPLE_DOCS, bits: int = BITS) -> Model:
    """Train on at most ``sample_docs`` rows of labels 0 and 1 (lowest hash of the id). Their whole texts are hashed in Spark tasks;
    at most sum(sample_docs) sparse vectors of at most 2^bits buckets reach the driver.

    An id labelled twice takes its smallest label; null ids and labels aren't learned from, a null text is empty, and an id
    that several documents share counts once (the text that sorts first). Empty tables give probability one half.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    known = (labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).dropna().groupBy("_id").agg(F.min("_y").alias("_y")))
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).dropna()
    total = {r["_y"]: r["count"] for r in known.filter(F.col("_y").isin(0, 1)).groupBy("_y").count().collect()}
    picked = [r for y in (0, 1) for r in known.filter(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(sample_docs[y]).collect()]
    local = spark.createDataFrame(picked, known.schema)
    rows = rows.join(F.broadcast(local), "_id").groupBy("_id", "_y").agg(F.min("_text").alias("_text"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(bits)
        for b in batches:
            for s in range(0, b.num_rows, SLICE):
                part = b.slice(s, SLICE)
                got = hasher.features(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([w.astype(np.int32).tobytes() for w, _ in got], pa.binary()),
                     pa.array([v.astype(np.float32).tobytes() for _, v in got], pa.binary())], names=["_id", "_y", "at", "x"])
    kind = dict(known.dtypes)["_id"]
    got = rows.mapInArrow(vectors, f"_id {kind}, _y int, at binary, x binary").collect()
    found = {y: sum(r["_y"] == y for r in got) for y in (0, 1)}
    share = {y: total.get(y, 0) / max(1, found[y]) for y in (0, 1)}
    mean = sum(total.get(y, 0) for y in (0, 1)) / max(1, len(got))
    return train([(r["_y"], share[r["_y"]] / mean, np.frombuffer(r["at"], np.int32).astype(np.int64), np.frombuffer(r["x"], np.float32).astype(float))
                  for r in sorted(got, key=lambda r: str(r["_id"]))], bits)


def score(docs: DataFrame, model: Model, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score, predicted) of every whole text: the probability of label 1, and whether it is at least ``least``.

    Null and empty texts, and texts without a token, score by the intercept alone. Every row gives one row (repeated rows,
    null ids), an empty table none; other columns are not read.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    shared, key = spark.sparkContext.broadcast(model), uuid.uuid4().hex
    bits = len(model.weights).bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = worker_state(("quality", key), lambda: Hasher(bits))
        for b in batches:
            for s in range(0, b.num_rows, SLICE):
                part = b.slice(s, SLICE)
                got = [shared.value.probability(*f) for f in hasher.features(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got, pa.float64()), pa.array([int(x >= least) for x in got], pa.int32())],
                                                 names=[id_col, "score", "predicted"])
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, score double, predicted int")
