"""Supervised subword embeddings for document quality.

Words, pairs of neighbouring words and character n-grams are hashed into buckets with learned
vectors.  A document is the average of the vectors of all its features; a softmax layer tells the
classes apart.  Both are trained by stochastic gradient descent in numpy.

A pair of equal words is one feature, whatever the word, so that stuttering text is seen as such.
As the output is linear in the average, a trained model scores with one number per bucket.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import replacing, slices, table, tidy

BUCKETS, DIMENSIONS, NGRAMS = 1 << 17, 10, (2, 3, 4)
#: At most so many labelled rows are learned from: those of the least CRC-32 of their id.
TRAIN_ROWS = 4000
EPOCHS, RATE = 6, 0.5
#: Sums of so many distinct words are remembered by a worker; then it starts anew.
MEMORY = 400_000
#: Bytes of texts scored at once.
CHUNK = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the features of words, all words at once, and the index of the word of each: the word itself, and its character n-grams with its ends marked."""
    framed = np.frombuffer(b"".join(b"<" + w + b">" for w in words), np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.repeat(np.cumsum(sizes), sizes)
    owner = np.repeat(np.arange(len(words)), sizes)
    buckets, owners = [np.fromiter((zlib.crc32(w, 7) for w in words), np.int64, len(words)) % BUCKETS], [np.arange(len(words))]
    for n in NGRAMS:
        if len(framed) < n:
            continue
        code = np.full(len(framed) - n + 1, n, np.uint64)
        for k in range(n):
            code = code << np.uint64(8) | framed[k : len(framed) - n + 1 + k]
        whole = np.flatnonzero(np.arange(len(code)) + n <= ends[: len(code)])
        buckets.append((code[whole] * _MIX >> np.uint64(40)).astype(np.int64) % BUCKETS)
        owners.append(owner[whole])
    return np.concatenate(buckets), np.concatenate(owners)


def pairs(hashes: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of neighbouring words within a text, from the words' hashes and the index of their text; and that index."""
    together = np.flatnonzero(texts[:-1] == texts[1:])
    a, b = hashes[together], hashes[together + 1]
    mixed = (a * _MIX + b) * _MIX >> np.uint64(40)
    return np.where(a == b, np.uint64(0), mixed).astype(np.int64) % BUCKETS, texts[together]


def split(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The words of texts, and the index of the text of each."""
    lists = [t.split() for t in texts]
    return [w for own in lists for w in own], np.repeat(np.arange(len(texts)), [len(own) for own in lists])


def word_hash(words: list[bytes]) -> np.ndarray:
    return np.fromiter((zlib.crc32(w, 11) for w in words), np.uint64, len(words))


def counted(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text, and how often it has each."""
    words, texts = split([text])
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    kinds = list(dict.fromkeys(words))
    place = dict(zip(kinds, range(len(kinds)), strict=True))
    uses = np.bincount([place[w] for w in words], minlength=len(kinds))
    buckets, owners = subwords(kinds)
    counts = np.bincount(buckets, uses[owners], BUCKETS) + np.bincount(pairs(word_hash(words), texts)[0], minlength=BUCKETS)
    found = np.flatnonzero(counts)
    return found.astype(np.int32), counts[found].astype(np.int32)


class Scorer:
    """Log odds of texts under a trained model.  Sums over the features of a word are remembered."""

    def __init__(self, model: tuple[np.ndarray, float]):
        self.values, self.bias = model
        self.forget()

    def forget(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.sums, self.counts, self.hashes = np.zeros(0), np.zeros(0), np.zeros(0, np.uint64)

    def odds(self, texts: list[bytes]) -> np.ndarray:
        words, owner = split(texts)
        if new := list(set(words).difference(self.numbers)):
            if len(self.numbers) + len(new) > MEMORY:
                self.forget()
                new = list(set(words))
            self.numbers.update(zip(new, range(len(self.numbers), len(self.numbers) + len(new)), strict=True))
            buckets, owners = subwords(new)
            self.sums = np.concatenate([self.sums, np.bincount(owners, self.values[buckets], len(new))])
            self.counts = np.concatenate([self.counts, np.bincount(owners, minlength=len(new))])
            self.hashes = np.concatenate([self.hashes, word_hash(new)])
        at = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        buckets, pair_owner = pairs(self.hashes[at], owner)
        n = len(texts)
        total = np.bincount(owner, self.sums[at], n) + np.bincount(pair_owner, self.values[buckets], n)
        return self.bias + total / np.maximum(1, np.bincount(owner, self.counts[at], n) + np.bincount(pair_owner, minlength=n))


def train(samples: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 7) -> tuple[np.ndarray, float]:
    """(buckets, counts, class 0 or 1) of documents -> a number per bucket and a bias: the log odds of class 1 are the mean number plus the bias."""
    rng = np.random.default_rng(seed)
    vectors = ((rng.random((BUCKETS, DIMENSIONS)) - 0.5) / DIMENSIONS).astype(np.float32)
    output, bias = np.zeros((2, DIMENSIONS), np.float32), np.zeros(2, np.float32)
    steps, step = max(1, EPOCHS * len(samples)), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(samples)):
            buckets, counts, label = samples[k]
            rate = RATE * (1 - step / steps)
            step += 1
            share = (counts / max(1, counts.sum())).astype(np.float32)
            hidden = share @ vectors[buckets]
            logits = output @ hidden + bias
            p = np.exp(logits - logits.max())
            error = p / p.sum()
            error[label] -= 1
            back = error @ output
            output -= rate * np.outer(error, hidden).astype(np.float32)
            bias -= np.float32(rate * 0.1) * error
            vectors[buckets] -= np.float32(rate) * np.outer(share * len(buckets) ** 0.5, back).astype(np.float32)
    return (vectors @ (output[1] - output[0])).astype(np.float64), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", trainable: Column | None = None, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, float]:
    """Learns ``label`` (0 or 1) of documents from at most ``rows`` labelled rows whose doc_id holds ``trainable``.

    Rows with a null id, label or text give nothing to learn; repeated ids and labels give a sample
    each, ties of the choice go by id.  Without any sample the model is constant.  The chosen sample,
    whose size ``rows`` bounds, is learned from in one task; only the model comes to the driver (1 MB).
    """
    wanted = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    if trainable is not None:
        wanted = wanted.filter(trainable)
    wanted = wanted.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y")).orderBy(F.crc32(F.col("doc_id").cast("string")), "doc_id").limit(rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text", CHUNK):
                found = [pickle.dumps(counted(x)) for x in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.binary())], names=["id", "y", "features"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted(x for b in batches for x in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(1).to_pylist(), strict=True))
        values, bias = train([(*pickle.loads(f), y) for _, f, y in found])
        yield pa.RecordBatch.from_arrays([pa.array([values.tobytes()], pa.binary()), pa.array([bias])], names=["values", "bias"])
        del found
        tidy()

    chosen = docs.select("doc_id", "text").join(F.broadcast(wanted), F.col("doc_id") == F.col("id")).select("id", "y", "text")
    samples = chosen.filter(F.col("text").isNotNull()).mapInArrow(count, "id long, y int, features binary")
    model = samples.repartition(1).mapInArrow(learn, "values binary, bias double").first()
    return (np.frombuffer(model["values"], np.float64), model["bias"]) if model else train([])


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """All columns of ``docs``, and quality_score from 0 to 1, which takes the place of a column of that name.

    Empty and null texts get the score of no features; rows are independent, so null and repeated ids,
    ties and repeated rows need no care; texts are read whole; an empty table gives an empty table.
    """
    docs = replacing(docs, "quality_score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for part, texts in slices(batch, "text", CHUNK):
                scores = 1 / (1 + np.exp(-np.clip(scorer.odds(texts), -50, 50)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores)], names=[*names, "quality_score"])
        scorer.forget()
        tidy()

    return docs.mapInArrow(run, docs.withColumn("quality_score", F.lit(0.0)).schema)


def remainder(modulus: int) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and text of ``docs`` -> doc_id, text, quality_score, learned from labels outside the held-out quarter."""
    return score(docs.select("doc_id", "text"), fit(docs, labels, trainable=remainder(4) != 2))


def op7(spark, sf_dir: str) -> DataFrame:
    """One row per document: its score, learned from labels outside the held-out quarter, and the class at 0.7."""
    scored = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (remainder(4) == 2).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.7).cast("int").alias("predicted"))
