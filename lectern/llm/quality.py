"""Quality classifier: nearest-neighbour voting over latent-semantic vectors.

A text is described by its hashed words, weighed by inverse document frequency, by the counts of trigrams of character
classes, and by a few figures of repetition, all over its whole length; a truncated singular value decomposition of the
labelled rows gives latent-semantic vectors. At most MAX_LABELLED labelled rows (those of the smallest hash of doc_id) are
kept: that bounds the broadcast. Every document's cosine with every labelled vector is computed exactly, in blocks, and the
labels of the nearest neighbours vote by similarity; ties fall the same way on every run.

Null text counts as empty and is scored like any text; no label at all gives 0.5; an empty table gives no rows; repeated
rows have the same score each, and of rows that repeat a labelled doc_id the one with the least text hash is learnt from; a
very long text is worked on in blocks; columns of any name are kept, but for the three that classify() replaces.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LABELLED, RANK, NEIGHBOURS, POWER, THRESHOLD, ITERATIONS = 4000, 24, 15, 8, 0.7, 16
BLOCK, ROWS = 1 << 20, 64  # bytes of a text and rows of a batch worked on at a time
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def _classes() -> np.ndarray:
    out = np.full(256, 14, np.uint16)  # control characters and what is not named below
    for k, chars in enumerate((b"aeiou", b"nrstlhd", b"bcfgjkmpqvwxyz", b"AEIOUBCDFGHJKLMNPQRSTVWXYZ", b"0123456789", b" \t", b"\n\r", b".,;:", b"!", b"?'\"-", b"#$%&*", b"|<>{}[]\\/=_+~^`@()")):
        out[list(chars)] = k
    out[128:192], out[192:] = 12, 13
    return out


CLASSES, SHAPES, TERMS, FIGURES = _classes(), 16**3, 1024, 6
WIDTH = SHAPES + TERMS + FIGURES
TERM_START = SHAPES + FIGURES


def word_blocks(raw: bytes):
    """The words of a text, a block at a time; a block ends at white space."""
    at = 0
    while at < len(raw):
        end = min(len(raw), at + BLOCK)
        if end < len(raw) and (cut := max(raw.rfind(b" ", at, end), raw.rfind(b"\n", at, end))) > at:
            end = cut
        elif end < len(raw):  # no space in the block: up to the next one
            end = min((k for k in (raw.find(b" ", end), raw.find(b"\n", end)) if k >= 0), default=len(raw))
        yield raw[at:end].split()
        at = end


def features(text: str) -> np.ndarray:
    """float32[WIDTH]: roots of the shares of character-class trigrams, figures of length and repetition, roots of the
    shares of hashed words. Work is done in blocks, so a long text takes a few bytes of memory per byte."""
    raw = text.encode("utf-8", "replace")
    out = np.zeros(WIDTH, np.float32)
    if len(raw) >= 3:
        counts = np.zeros(SHAPES, np.int64)
        for at in range(0, len(raw) - 2, BLOCK):
            c = CLASSES[np.frombuffer(raw, np.uint8, min(BLOCK + 2, len(raw) - at), at)]
            counts += np.bincount(c[:-2] * 256 + c[1:-1] * 16 + c[2:], minlength=SHAPES)
        out[:SHAPES] = np.sqrt(counts / (len(raw) - 2))
    n, same, last, distinct, terms = 0, 0, None, set(), np.zeros(TERMS, np.int64)
    for words in word_blocks(raw):
        if words:
            n += len(words)
            same += sum(map(bytes.__eq__, words, words[1:])) + (words[0] == last)
            last = words[-1]
            distinct.update(words)
            terms += np.bincount(np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % TERMS, minlength=TERMS)
    if n:
        lines = raw.split(b"\n")
        out[SHAPES:TERM_START] = (np.log1p(n) / 12, len(distinct) / n**0.8, 3 * np.sqrt(same / n), 1 - len(set(lines)) / len(lines), min(1, len(text) / n / 20), len(zlib.compress(raw, 1)) / len(raw))
        out[TERM_START:] = np.sqrt(terms / n)
    return out


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


class Model:
    """Trained on rows of features, which it centres in place, and their labels.

    The decomposition is a subspace iteration, so besides the rows it needs only a few columns of memory.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.weight = np.ones(WIDTH, np.float32)  # words weigh by their inverse document frequency in the labelled rows
        self.weight[TERM_START:] = np.log((1 + len(x)) / (1 + (x[:, TERM_START:] > 0).sum(axis=0)))
        x *= self.weight
        self.mean = x.mean(axis=0)
        x -= self.mean
        q = np.random.default_rng(0).standard_normal((x.shape[1], min(RANK + 8, len(x)))).astype(np.float32)
        for _ in range(ITERATIONS):
            q = np.linalg.qr(x.T @ (x @ q))[0]
        within = x @ q
        values, vectors = np.linalg.eigh(within.T @ within)
        top = np.argsort(-values)[:RANK]
        top = top[values[top] > 1e-9]
        self.axes = (q @ vectors[:, top]).astype(np.float32)
        self.labelled, self.y = unit(x @ self.axes), y.astype(np.float32)

    def project(self, x: np.ndarray) -> np.ndarray:
        return unit((x * self.weight - self.mean) @ self.axes)

    def score(self, x: np.ndarray) -> np.ndarray:
        near = self.project(x) @ self.labelled.T
        k = min(NEIGHBOURS, near.shape[1])
        at = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, at, 1), 1e-3) ** POWER
        return np.clip((weight * self.y[at]).sum(axis=1) / weight.sum(axis=1), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> Model | None:
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)

    @F.arrow_udf("binary")
    def packed(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in texts:
            yield pa.array([features(t or "").astype(np.float16).tobytes() for k in range(0, len(text), ROWS) for t in text.slice(k, ROWS).to_pylist()], pa.binary())

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id")  # at most `limit` ids
    one = texts.groupBy("doc_id", "quality").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("d"))  # repeated rows reach the driver once
    rows = one.select("doc_id", "quality", packed("d.text").alias("x")).orderBy("doc_id").toArrow()
    if not rows.num_rows:
        return None
    y, x = rows["quality"].to_numpy(), np.empty((rows.num_rows, WIDTH), np.float32)
    for i, v in enumerate(rows["x"]):
        x[i] = np.frombuffer(v.as_buffer(), np.float16)
    return Model(x, y)


def scorer(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> Callable[[str], Column]:
    """Fits on the documents with labels; gives the score column of a text column."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, limit))  # at most limit x RANK floats, and the axes

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in texts:
            out = np.full(len(text), 0.5)
            for at in range(0, len(text), ROWS):
                if shared.value is not None:
                    out[at : at + ROWS] = shared.value.score(np.stack([features(t or "") for t in text.slice(at, ROWS).to_pylist()]))
            yield pa.array(out)

    return score


def classify(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with score, predicted and held_out, which replace columns of these names."""
    out = docs.withColumn("score", scorer(docs, labels, limit)("text"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int")).withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)))
