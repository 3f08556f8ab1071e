"""Toxicity from confirmed examples and unlabelled text: non-negative positive-unlabelled learning."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_fold, frugal, one_of_each_id, rows_of, slices, text_slice, utf8, word_buckets

#: Hash buckets of words (as a power of two).
BITS = 18
#: Longer words also count by so many first bytes, for languages that build on stems.
PREFIXES = (5, 7)
#: Bounds of the sample that is learned from: confirmed toxic rows, and unlabelled rows.
POSITIVES, UNLABELLED = 3000, 9000
#: Bytes of a text that are learned from: a longer one brings a part of that size at a hashed place.
SAMPLE_TEXT_BYTES = 40_000
#: A word gets a weight only if LEAST positives have it and its share among positives differs
#: from that among unlabelled rows by this many standard errors.
LEAST, ERRORS = 3, 4.0
STEPS, RATE, DECAY = 400, 0.05, 1e-5
FOLDS, HELD_OUT = 5, 0


def bucket_rows(docs: DataFrame, mark: str) -> DataFrame:
    """``mark`` and the word buckets of each row."""

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for a, b in slices(offsets):
                buckets, counts = word_buckets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], BITS, PREFIXES)
                where = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(mark).slice(a, b - a), pa.ListArray.from_arrays(pa.array(where), pa.array(buckets.astype(np.int32)))], names=[mark, "buckets"])

    return docs.select(mark, "text").mapInArrow(frugal(run), T.StructType([docs.schema[mark], T.StructField("buckets", T.ArrayType(T.IntegerType()))]))


class Sparse:
    """Rows of 0/1 features; products with a weight vector and its transpose, by numpy."""

    def __init__(self, rows: list[np.ndarray]):
        self.counts = np.array([len(r) for r in rows], np.int64)
        self.columns = np.concatenate(rows) if len(rows) else np.zeros(0, np.int64)
        self.rows = rows_of(self.counts)

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, weights[self.columns], len(self.counts))

    def back(self, values: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.columns, values[self.rows], size)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def nnpu_gradient(positive: Sparse, unlabelled: Sparse, w: np.ndarray, b: float, prior: float) -> tuple[float, np.ndarray, float]:
    """R-(U) - prior * R-(P), and the direction (weights, bias) against which :func:`fit_nnpu` steps."""
    sp, su = _sigmoid(positive.times(w) + b), _sigmoid(unlabelled.times(w) + b)
    slope_p, slope_u = sp * (1 - sp) / max(1, len(sp)), su * (1 - su) / max(1, len(su))
    # loss of label +1 is 1 - s, of label -1 is s
    excess = float(su.mean() - prior * sp.mean()) if len(su) and len(sp) else 0.0
    gp, gu = (-2 * prior * slope_p, slope_u) if excess >= 0 else (prior * slope_p, -slope_u)
    return excess, positive.back(gp, len(w)) + unlabelled.back(gu, len(w)), gp.sum() + gu.sum()


def fit_nnpu(positive: Sparse, unlabelled: Sparse, size: int, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias that lessen prior * R+(P) + max(0, R-(U) - prior * R-(P)) under the sigmoid loss.

    Where the part in max() is negative, unlabelled text has been fitted as negative beyond what
    the prior allows, and the step goes against that part instead.
    """
    w, b = np.zeros(size), 0.0
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for t in range(1, STEPS + 1):
        _, g, gb = nnpu_gradient(positive, unlabelled, w, b, prior)
        g = g + DECAY * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        b -= RATE * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    return w, b


def best_cut(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> float:
    """The logit from which the same risk, with errors counted as they are, is least.

    Among equals the cut that misses fewest positives, in the middle of the gap below it.
    """
    levels = np.unique(np.concatenate([positive, unlabelled]))
    missed = np.searchsorted(np.sort(positive), levels, side="left") / max(1, len(positive))
    marked = 1 - np.searchsorted(np.sort(unlabelled), levels, side="left") / max(1, len(unlabelled))
    risk = prior * missed + np.maximum(0, marked - prior * (1 - missed))
    at = int(np.argmin(np.round(risk, 12)))
    return float((levels[at] + levels[at - 1]) / 2 if at else levels[at] - 1)


def sample(docs: DataFrame, labels: DataFrame) -> tuple[list[np.ndarray], list[np.ndarray], float]:
    """Buckets of positives and of unlabelled rows, and the class prior of the labelled rows.

    Only labels outside the held-out fold are read. Rows come in the order of a hash of the id,
    up to POSITIVES and UNLABELLED ids, one row an id; the prior is that of all such labels.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (crc_fold(F.col("doc_id"), FOLDS) != HELD_OUT)).select("doc_id", "toxic").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = known.agg(F.count("*").alias("n"), F.sum("toxic").alias("k")).first()
    prior = min(max((total.k or 0) / total.n if total.n else 0.0, 1e-4), 0.95)
    h = F.xxhash64(F.col("doc_id").cast("string"), F.lit("toxicity"))
    positives = known.where("toxic = 1").select("doc_id", F.lit(1).alias("mark")).orderBy(h).limit(POSITIVES)
    others = docs.where("doc_id IS NOT NULL").select("doc_id", F.lit(0).alias("mark")).distinct().orderBy(h).limit(UNLABELLED)
    chosen = positives.unionByName(others)
    texts = one_of_each_id(docs.join(F.broadcast(chosen), "doc_id"), "mark", "text")
    rows = bucket_rows(texts.select("mark", text_slice(F.col("text"), F.col("h"), SAMPLE_TEXT_BYTES).alias("text")), "mark").collect()
    take = lambda k: [np.array(r.buckets, np.int64) for r in rows if r.mark == k]
    return take(1), take(0), prior


def telling_words(positives: list[np.ndarray], unlabelled: list[np.ndarray]) -> np.ndarray:
    """Buckets whose share of rows differs between the two sets beyond chance."""
    with_word = [np.bincount(np.concatenate(rows), minlength=1 << BITS) if rows else np.zeros(1 << BITS) for rows in (positives, unlabelled)]
    n, m = max(1, len(positives)), max(1, len(unlabelled))
    pooled = (with_word[0] + with_word[1] + 1) / (n + m + 2)
    error = np.sqrt(pooled * (1 - pooled) * (1 / n + 1 / m))
    return np.flatnonzero((with_word[0] >= LEAST) & (with_word[0] / n - with_word[1] / m > ERRORS * error))


class Model:
    def __init__(self, positives: list[np.ndarray], unlabelled: list[np.ndarray], prior: float):
        used = telling_words(positives, unlabelled)
        place = np.full(1 << BITS, -1, np.int64)
        place[used] = np.arange(len(used))
        pick = lambda rows: Sparse([p[p >= 0] for p in (place[r] for r in rows)])
        self.weights, self.bias = np.zeros(1 << BITS), 0.0
        if positives and len(used):
            p, u = pick(positives), pick(unlabelled)
            w, self.bias = fit_nnpu(p, u, len(used), prior)
            self.weights[used] = w
            # half the way: the cut lies where unlabelled rows begin to look as toxic as the prior allows
            self.bias -= 0.5 * best_cut(p.times(w) + self.bias, u.times(w) + self.bias, prior)
        else:
            self.bias = float(np.log(prior / (1 - prior)))

    def score(self, buckets: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return _sigmoid(np.bincount(rows_of(counts), self.weights[buckets], len(counts)) + self.bias)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``.

    The bias of the fitted classifier is moved half the way to the cut at which the same risk with
    counted errors is least (:func:`best_cut`), so that 0.5 is where the prior is met.

    The score is made of the words of the whole text alone. Null and empty texts get the score
    of a text without known words; without positive labels all get the prior. Rows with equal
    ids are scored each by itself.
    """
    docs = docs.select("doc_id", "text")
    shipped = docs.sparkSession.sparkContext.broadcast(Model(*sample(docs, labels)))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches):
        model = shipped.value
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            scores = [np.zeros(0)]
            for a, b in slices(offsets):
                scores.append(model.score(*word_buckets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], BITS, PREFIXES)))
            score = np.concatenate(scores)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=schema.names)

    return docs.select("doc_id", (crc_fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "text").mapInArrow(frugal(run), schema)
