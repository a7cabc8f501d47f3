"""A quality classifier of supervised subword embeddings.

A document is the sum of three averages of learned vectors: of its words and word pairs,
of its three- and four-byte grams, and of marks that say whether a word pair or triple
was already seen in the document.  Grams are hashed into a fixed number of buckets.  A
softmax over the document vector gives the two classes.  Vectors and weights are learned
together by stochastic gradient descent in numpy on a bounded sample of labelled rows
(SAMPLE, whole texts); every document is scored, whole.  As the last layer is linear, a
bucket's vector and the weights collapse into one number for each bucket, so scoring
needs a table of fixed size.

Defined cases: null text is empty text, which is scored by the bias alone; a null id
counts as an empty string in the split; labels without a quality are left out, of several
labels of an id the largest counts; without labels of both classes nothing is known and
all score 1; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import mix, text_of, word_hashes
from vigil.session import settle

# Labelled rows that are learned from, at most; chosen by a hash of the id.
SAMPLE = 5000
BITS = 18
DIMENSION = 8
EPOCHS = 8
RATE = 8.0
THRESHOLD = 0.7

_FIRST, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def held_out(id_column: str = "doc_id") -> Column:
    """Whether the CRC-32 of the id as text leaves 2 when divided by 4."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _seen(hashes: np.ndarray) -> np.ndarray:
    """0 where a value comes first, 1 where it was there before."""
    again = np.ones(len(hashes), np.int64)
    again[np.unique(hashes, return_index=True)[1]] = 0
    return again


def features(texts: list[bytes], bits: int = BITS) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """By group and kind: the buckets of all grams of UTF-8 texts, and where each text's begin (and the end).

    Each occurrence counts.  The texts are worked on as one array.
    """
    down, size = np.uint64(64 - bits), 1 << bits
    data = b"".join(b" " + text + b" " for text in texts)
    starts = np.concatenate([[0], np.cumsum([len(text) + 2 for text in texts])])

    words, first, _ = word_hashes(data)
    bounds = np.searchsorted(first, starts)
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))

    def follow(before: np.ndarray, n: int, factor: np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of n words in a row inside a text, their texts, and where a text's begin."""
        after = words[n - 1 :]
        inside = owner[n - 1 :] == owner[: len(after)]
        grams = mix(before[: len(after)] * factor + after)
        counts = np.maximum(np.diff(bounds) - (n - 1), 0)
        return grams, inside, np.concatenate([[0], np.cumsum(counts)])

    pairs, pair_in, pair_bounds = follow(words, 2, _FIRST)
    triples, triple_in, triple_bounds = follow(pairs, 3, _SECOND)

    def in_text(hashes: np.ndarray, inside: np.ndarray) -> np.ndarray:
        return mix(hashes[inside] + owner[: len(hashes)][inside].astype(np.uint64) * _SECOND)

    # The marks have the places behind the buckets.
    seen = [size + _seen(in_text(pairs, pair_in)), size + 2 + _seen(in_text(triples, triple_in))]
    raw = np.frombuffer(data, np.uint8).astype(np.uint64)
    three = raw[:-2] | raw[1:-1] << np.uint64(8) | raw[2:] << np.uint64(16)
    four = three[:-1] | raw[3:] << np.uint64(24)
    lengths = np.diff(starts)

    def runs(grams: np.ndarray, n: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
        # Of an empty text's two blanks nothing counts.
        counts = np.where(lengths > 2, lengths - (n - 1), 0)
        inside = np.ones(len(grams), bool)
        for k in range(1, n):
            inside[starts[1:-1] - k] = False
        for at in starts[:-1][lengths == 2]:
            inside[at : at + 2] = False
        return (((grams + np.uint64(salt)) * _FIRST) >> down).astype(np.int64)[inside], np.concatenate([[0], np.cumsum(counts)])

    to_bucket = lambda h: (h >> down).astype(np.int64)
    return [
        [(to_bucket(words), bounds), (to_bucket(pairs[pair_in]), pair_bounds)],
        [runs(three, 3, 1 << 40), runs(four, 4, 1 << 41)],
        [(seen[0], pair_bounds), (seen[1], triple_bounds)],
    ]


class Model:
    """One number for each bucket and a bias; the score is the probability of class 1."""

    def __init__(self, values: np.ndarray, bias: float, bits: int = BITS):
        self.values, self.bias, self.bits = values, bias, bits

    def score(self, texts: list[str], at_once: int = 1 << 18) -> np.ndarray:
        """Scores of the texts, worked on in blocks of about ``at_once`` bytes."""
        scores, block, size = [], [], 0
        for text in texts:
            block.append(text.encode())
            size += len(block[-1])
            if size >= at_once:
                scores.append(self._block(block))
                block, size = [], 0
        if block:
            scores.append(self._block(block))
        return np.concatenate(scores) if scores else np.zeros(0)

    def _block(self, texts: list[bytes]) -> np.ndarray:
        logits = np.full(len(texts), self.bias)
        for group in features(texts, self.bits):
            sums, counts = np.zeros(len(texts)), np.zeros(len(texts))
            for buckets, bounds in group:
                running = np.concatenate([[0.0], np.cumsum(self.values[buckets], dtype=np.float64)])
                sums += running[bounds[1:]] - running[bounds[:-1]]
                counts += np.diff(bounds)
            logits += sums / np.maximum(counts, 1)
        return 1 / (1 + np.exp(-np.clip(logits, -700, 700)))


Shares = tuple[np.ndarray, np.ndarray]


def shares_of(text: str, bits: int = BITS) -> Shares:
    """The buckets of a text and their shares of its vector."""
    places, shares = [], []
    for group in features([text.encode()], bits):
        group = np.concatenate([buckets for buckets, _ in group])
        if len(group):
            found, counts = np.unique(group, return_counts=True)
            places.append(found)
            shares.append((counts / len(group)).astype(np.float32))
    if not places:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    # Groups may share buckets, so a bucket's shares are added up.
    found, back = np.unique(np.concatenate(places), return_inverse=True)
    return found.astype(np.int32), np.bincount(back, np.concatenate(shares)).astype(np.float32)


def train(
    texts: list[str], labels: list[int], bits: int = BITS, dimension: int = DIMENSION, epochs: int = EPOCHS,
    rate: float = RATE, seed: int = 7,
) -> Model:
    """Learn bucket vectors and softmax weights by stochastic gradient descent."""
    return train_shares([shares_of(text, bits) for text in texts], labels, bits, dimension, epochs, rate, seed)


def train_shares(
    documents: list[Shares], labels: list[int], bits: int = BITS, dimension: int = DIMENSION, epochs: int = EPOCHS,
    rate: float = RATE, seed: int = 7,
) -> Model:
    """``train`` from the shares of each document."""
    size = (1 << bits) + 4
    if len(set(labels)) < 2:
        return Model(np.zeros(size, np.float32), 50.0, bits)
    random = np.random.default_rng(seed)
    vectors = random.uniform(-1 / dimension, 1 / dimension, (size, dimension)).astype(np.float32)
    weights = random.normal(0, 0.5, (dimension, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in random.permutation(len(documents)):
            places, shares = documents[i]
            vector = shares @ vectors[places]
            logits = vector @ weights + bias
            odds = np.exp(logits - logits.max())
            error = odds / odds.sum()
            error[labels[i]] -= 1
            back = weights @ error
            # The step is for averages of many vectors; the shared layer takes a smaller one.
            weights -= np.float32(step / 300) * np.outer(vector, error)
            bias -= np.float32(step / 300) * error
            vectors[places] -= np.float32(step) * np.outer(shares, back)
    values = vectors @ (weights[:, 1] - weights[:, 0])
    return Model(values.astype(np.float32), float(bias[1] - bias[0]), bits)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Train on at most ``sample`` labelled documents outside the held-out part.

    Tasks turn the texts into shares of buckets, at most 2 ** BITS numbers a document
    whatever its length; one task learns from those of the sample, and the driver gets
    the table of the model only.
    """
    spark = docs.sparkSession
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    # At most ``sample`` small rows, so they are sent to where the texts are.
    chosen = spark.createDataFrame(chosen.collect(), "doc_id long, quality int")
    text = text_of()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).join(F.broadcast(chosen), "doc_id")
    keyed = rows.select(F.xxhash64("doc_id").alias("place"), "doc_id", F.xxhash64("text").alias("tie"), "quality", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch["text"].to_pylist()):
                places, shares = shares_of(text)
                lists = [pa.array([places.tobytes()], pa.binary()), pa.array([shares.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(
                    [*(batch[c].slice(i, 1) for c in names), *lists], [*names, "places", "shares"]
                )

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents, marks = [], []
        for batch in batches:
            for quality, places, shares in zip(*(batch[c].to_pylist() for c in ("quality", "places", "shares"))):
                documents.append((np.frombuffer(places, np.int32), np.frombuffer(shares, np.float32)))
                marks.append(int(quality == 1))
        model = train_shares(documents, marks)
        yield pa.RecordBatch.from_arrays([pa.array([model.values.tobytes()], pa.binary()), pa.array([model.bias])], ["values", "bias"])

    names = ["place", "doc_id", "tie", "quality"]
    counted = settle(keyed.mapInArrow(count, "place long, doc_id long, tie long, quality int, places binary, shares binary"), "shares")
    # A bounded sample in one task and one order.
    learned = counted.orderBy("place", "doc_id", "tie").limit(sample).select("quality", "places", "shares")
    model = learned.coalesce(1).mapInArrow(fit, "values binary, bias double").first()
    return Model(np.frombuffer(model["values"], np.float32), model["bias"])


def score_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.score(batch["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(scores, pa.float64())], ["doc_id", "score"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return chosen.mapInArrow(run, "doc_id long, score double").select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` the model does not reject, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.score([text or "" for text in batch.column(place).to_pylist()])
            yield batch.filter(pa.array(scores >= threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
