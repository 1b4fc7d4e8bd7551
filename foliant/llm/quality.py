"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its words and of the
character n-grams inside them (word ends count as a character), all hashed
into one table in which a row of its own stands for any word pair that says
the same word twice; a softmax layer turns the average into class probabilities.
Table and layer are trained together by stochastic gradient descent in numpy.

The model is fitted on at most ``SAMPLE`` labelled rows, those with the
smallest hash of their doc_id; their hashed features (never texts) go to the
driver, the size of which this bound sets.  For scoring, the softmax of two
classes needs only the difference of the two class rows, so each hashed
feature is one number, and whole texts are scored in the tasks.

Rules for unusual rows: a null or empty text has no features and gets the
score of the bias alone.  A label row that is null, or a doc_id that is null,
teaches nothing; of labels that share a doc_id the mean counts (1 from one
half on), of documents that share it the one with the smallest text.  Without
labels of both classes, every score is (ones + 1) / (labels + 2).  A null
doc_id is scored and not held out.  Rows that repeat each return a row.
Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._blocks import SPACE, U64, chunks, lean, mix, prefix_sums, span_hash, word_spans
from ._tables import fresh, load

SAMPLE, THRESHOLD, FOLDS = 6000, 0.3, 5
BITS, DIM, GRAMS = 17, 8, (3, 4)
STEPS, BATCH, RATE, SEED = 1500, 32, 2.0, 7
#: Words use the first 2**BITS rows of the table, n-grams the next, repeated words the last one.
ROWS = (2 << BITS) + 1


def features(buf: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, table row) of all features, words first, then the n-grams of each length; each in order of the text."""
    start, end, doc = word_spans(buf, off)
    words = span_hash(prefix_sums(buf), start, end) >> U64(64 - BITS)
    yield doc, words.astype(np.int64)
    again = np.flatnonzero((words[1:] == words[:-1]) & (doc[1:] == doc[:-1])) if len(words) else np.zeros(0, np.int64)
    yield doc[again], np.full(len(again), ROWS - 1)
    # characters, with one space after each text, and one before all
    lead = np.r_[0, np.cumsum((buf & 0xC0) != 0x80)][off]
    points = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), np.uint32)
    points = np.insert(points, lead, 32)
    owner = np.repeat(np.arange(len(off)), np.diff(np.r_[0, lead + 1 + np.arange(len(off))])) - 1
    owner = np.maximum(owner, 0)
    blank = SPACE[np.minimum(points, 255)]
    x = np.where(blank, 32, points).astype(U64) * U64(0x9E3779B97F4A7C15)
    for n in GRAMS:
        k = len(x) - n + 1
        if k <= 0:
            continue
        h, inner = x[:k].copy(), np.zeros(k, bool)
        for i in range(1, n):
            h = h * U64(0xC2B2AE3D27D4EB4F) + x[i : i + k]
            if i < n - 1:
                inner |= blank[i : i + k]
        good = ~inner & ~(blank[:k] & blank[n - 1 :])
        # a gram belongs to the text of its middle; only word ends lie outside of it
        yield owner[1 : 1 + k][good], (mix(h[good]) >> U64(64 - BITS)).astype(np.int64) + (1 << BITS)


def _sample_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, buf, off in chunks(batches):
        found = list(features(buf, off))
        doc, row = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        both, count = np.unique(doc * ROWS + row, return_counts=True)
        doc, row = both // ROWS, (both % ROWS).astype(np.int32)
        edges = np.searchsorted(doc, np.arange(len(off)))
        cut = list(zip(edges[:-1], edges[1:]))
        yield pa.RecordBatch.from_arrays(
            [rows.column(0), rows.column(2), pa.array([row[a:b].tobytes() for a, b in cut], pa.binary()), pa.array([count[a:b].astype(np.int32).tobytes() for a, b in cut], pa.binary())], ["doc_id", "y", "row", "n"]
        )


@dataclass
class Model:
    """weight of each table row in the difference of the two classes, and the bias."""

    weight: np.ndarray
    bias: float


def train(rows: list[np.ndarray], counts: list[np.ndarray], y: np.ndarray) -> Model:
    """Fit by plain SGD with a falling rate; the same input gives the same model."""
    ones, n = int(y.sum()), len(y)
    if ones in (0, n):
        return Model(np.zeros(ROWS, np.float64), float(np.log((ones + 1) / (n - ones + 1))))
    rng = np.random.default_rng(SEED)
    table = rng.uniform(-1 / DIM, 1 / DIM, (ROWS, DIM)).astype(np.float32)
    layer = np.zeros((DIM, 2), np.float32)
    bias = np.log(np.array([n - ones, ones]) / n).astype(np.float32)
    share = [(c / max(1, c.sum())).astype(np.float32) for c in counts]
    order = np.concatenate([rng.permutation(n) for _ in range(-(-STEPS * BATCH // n))])[: STEPS * BATCH]
    for step in range(STEPS):
        pick = order[step * BATCH : (step + 1) * BATCH]
        rate = RATE * (1 - step / STEPS)
        row, part = np.concatenate([rows[i] for i in pick]), np.concatenate([share[i] for i in pick])
        mean = np.zeros((len(pick), DIM), np.float32)
        size = np.array([len(rows[i]) for i in pick])
        if len(row):
            mean[size > 0] = np.add.reduceat(table[row] * part[:, None], (np.cumsum(size) - size)[size > 0])
        z = mean @ layer + bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(pick)), y[pick]] -= 1
        p /= len(pick)
        back = p @ layer.T
        layer -= rate * (mean.T @ p)
        bias -= rate * 0.1 * p.sum(0)
        for i, pull in zip(pick, rate * len(pick) * back):
            table[rows[i]] -= share[i][:, None] * pull  # the rows of a document differ
    return Model((table @ (layer[:, 1] - layer[:, 0])).astype(np.float64), float(bias[1] - bias[0]))


def scores(model: Model, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Probability of class 1 of each text."""
    n = len(off) - 1
    total, number = np.zeros(n), np.zeros(n)
    for doc, row in features(buf, off):
        total += np.bincount(doc, model.weight[row], n)
        number += np.bincount(doc, minlength=n)
    return 1 / (1 + np.exp(-np.clip(total / np.maximum(1, number) + model.bias, -700, 700)))


def fold(doc_id: str | Column = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")), F.lit(FOLDS))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` labelled rows outside the held-out fold."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("l_id")).agg((F.avg(F.col("quality").cast("double")) >= 0.5).cast("int").alias("y"))
    known = known.where(fold("l_id") != 0).orderBy(F.xxhash64("l_id"), "l_id").limit(sample)
    one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), F.col("doc_id") == F.col("l_id")).groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y"))
    got = one.mapInArrow(lean(_sample_rows), "doc_id long, y int, row binary, n binary").toArrow().combine_chunks()
    order = np.argsort(got["doc_id"].to_numpy())
    parts = [[np.frombuffer(got[c].chunk(0)[i].as_buffer(), np.int32) for i in order] if len(order) else [] for c in ("row", "n")]
    return train(*parts, got["y"].to_numpy()[order].astype(np.int64))


def _scored(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for rows, buf, off in chunks(batches):
            yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(rows.num_columns) if rows.schema.names[i] != "text"), pa.array(scores(model, buf, off))], [*(c for c in rows.schema.names if c != "text"), "score"])

    return lean(run)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out and score of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(_scored(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, held_out boolean, score double")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs with a score of the threshold at least, as they are."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    names = docs.columns
    (own,) = fresh(docs, "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, off in chunks(batches, own):
            good = pa.array(scores(model.value, buf, off) >= threshold)
            yield rows.select(names).filter(good)

    return docs.withColumn(own, F.col("text")).mapInArrow(lean(run), docs.schema)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    found = score(docs, fit(docs, load(spark, sf_dir, "labels")))
    return found.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
