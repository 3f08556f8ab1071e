"""Quality classification by co-training of a text view and a metadata view."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_fold, frugal, one_of_each_id, rows_of, slices, utf8
from .quality_rules import measure

#: Bounds of the sample that is learned from: labelled rows, and the pool of unlabelled ones.
LABELLED, POOL = 4000, 6000
#: Rounds, and rows of each class that a view hands to the other in each.
ROUNDS, HANDED = 4, 150
#: A pseudo-label needs this probability.
CONFIDENT = 0.9
STEPS, RATE, DECAY = 120, 0.1, 1e-3
FOLDS, HELD_OUT = 5, 0
#: Hash buckets of the metadata values.
META = 128
_TEXT = 15


def text_view(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Features of whole texts: means of line features by words, and shares of the base counts."""
    t = measure(data, offsets)
    row, n = rows_of(t.lines), np.maximum(t.n_words, 1)
    means = [np.bincount(row, t.features[:, k] * t.line_words, len(n)) / n for k in range(1, 13)]
    return np.stack([*means, t.n_repeat_words / n, t.n_dup_lines / np.maximum(t.lines, 1), np.log1p(t.n_words) / 10], axis=1)


def with_metadata(docs: DataFrame) -> DataFrame:
    """``doc_id, text, m``: buckets of what the page says of itself; nulls have buckets of their own."""
    one = lambda name, value: F.pmod(F.xxhash64(F.lit(name), F.coalesce(value.cast("string"), F.lit("\0"))), F.lit(META)).cast("int")
    size = F.floor(F.log2(F.greatest(F.col("n_chars"), F.lit(0)) + 1) * 2)
    return docs.select("doc_id", "text", F.array(one("source", F.col("source")), one("lang", F.col("lang")), one("size", size), one("both", F.concat_ws("/", "source", "lang"))).alias("m"))


def meta_matrix(buckets: list[list[int]]) -> np.ndarray:
    out = np.zeros((len(buckets), META))
    if len(buckets):
        np.put_along_axis(out, np.array(buckets, np.int64), 1, axis=1)
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Logistic:
    """Regularised logistic regression on standardised features, fitted by Adam; classes weigh the same."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = np.clip((x - self.mean) / self.scale, -5, 5)
        weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
        self.w, self.b = np.zeros(x.shape[1]), 0.0
        m, v = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
        for t in range(1, STEPS + 1):
            r = (_sigmoid(z @ self.w + self.b) - y) * weight
            g = np.append(z.T @ r + DECAY * self.w, r.sum())
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
            self.w -= step[:-1]
            self.b -= step[-1]

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -5, 5) @ self.w + self.b


class CoTrained:
    """Two views taught by each other, then calibrated and combined on labels kept aside."""

    def __init__(self, text: np.ndarray, meta: np.ndarray, y: np.ndarray, pool_text: np.ndarray, pool_meta: np.ndarray):
        aside = np.arange(len(y)) % 4 == 3
        views = [(text[~aside], pool_text), (meta[~aside], pool_meta)]
        own_x, own_y = [v[0] for v in views], [y[~aside].astype(float)] * 2
        free = np.ones(len(pool_text), bool)
        self.models = [Logistic(x, t) for x, t in zip(own_x, own_y, strict=True)]
        for _ in range(ROUNDS):
            for k in (0, 1):
                left = np.flatnonzero(free)
                p = _sigmoid(self.models[k].logit(views[k][1][left])) if len(left) else np.zeros(0)
                good, bad = left[np.argsort(-p)[:HANDED]], left[np.argsort(p)[:HANDED]]
                taken = [(i, 1.0) for i in good[np.sort(-p)[: len(good)] <= -CONFIDENT]] + [(i, 0.0) for i in bad[np.sort(p)[: len(bad)] <= 1 - CONFIDENT]]
                if taken:
                    which = np.array([i for i, _ in taken])
                    free[which] = False
                    own_x[1 - k] = np.concatenate([own_x[1 - k], views[1 - k][1][which]])
                    own_y[1 - k] = np.concatenate([own_y[1 - k], [v for _, v in taken]])
            self.models = [Logistic(x, t) for x, t in zip(own_x, own_y, strict=True)]
        both = self.logits(text[aside], meta[aside])
        truth = y[aside].astype(float)
        # Platt scaling of each view, and of both together
        self.platt = [_platt(both[:, [k]], truth) for k in (0, 1)]
        self.joint = _platt(both, truth)

    def logits(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        return np.stack([self.models[0].logit(text), self.models[1].logit(meta)], axis=1)

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        both = self.logits(text, meta)
        of = lambda x, p: _sigmoid(x @ p[:-1] + p[-1])
        return of(both[:, [0]], self.platt[0]), of(both[:, [1]], self.platt[1]), of(both, self.joint)


def _platt(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (not negative) and bias of a logistic fit of the truth, by gradient steps."""
    p = np.append(np.full(x.shape[1], 1 / x.shape[1]), 0.0)
    if not len(y) or y.min() == y.max():
        return p
    for _ in range(2000):
        r = _sigmoid(x @ p[:-1] + p[-1]) - y
        p -= 0.05 * np.append(x.T @ r / len(y), r.mean())
        p[:-1] = np.maximum(p[:-1], 0)
    return p


def learn(docs: DataFrame, labels: DataFrame) -> CoTrained | None:
    """From labels outside the held-out fold, and a pool of rows whose labels are not read."""
    h = F.xxhash64(F.col("doc_id").cast("string"), F.lit("quality"))
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (crc_fold(F.col("doc_id"), FOLDS) != HELD_OUT)).groupBy("doc_id").agg(F.min("quality").alias("y")).orderBy(h).limit(LABELLED)
    pool = docs.where("doc_id IS NOT NULL").select("doc_id").distinct().orderBy(h).limit(POOL + LABELLED).join(F.broadcast(known), "doc_id", "left_anti").orderBy(h).limit(POOL).withColumn("y", F.lit(-1))
    chosen = known.select("doc_id", F.col("y").cast("int").alias("y")).unionByName(pool)
    rows = featured(one_of_each_id(with_metadata(docs).join(F.broadcast(chosen), "doc_id"), "y", "text", "m"), "y").orderBy("h").collect()
    text = np.array([r.t for r in rows], float).reshape(-1, _TEXT)
    meta = meta_matrix([r.m for r in rows])
    y = np.array([r.y for r in rows], np.int64)
    if len(set(y[y >= 0].tolist())) < 2:
        return None
    k = y >= 0
    return CoTrained(text[k], meta[k], (y[k] > 0).astype(np.int64), text[~k], meta[~k])


def featured(rows: DataFrame, mark: str) -> DataFrame:
    """``mark, h, t, m``: both views of each row."""

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for a, b in slices(offsets):
                t = text_view(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(a, b - a) for c in (mark, "h")], pa.array(list(t), pa.list_(pa.float64())), batch.column("m").slice(a, b - a)], names=[mark, "h", "t", "m"])

    schema = T.StructType([rows.schema[mark], T.StructField("h", T.LongType()), T.StructField("t", T.ArrayType(T.DoubleType())), T.StructField("m", T.ArrayType(T.IntegerType()))])
    return rows.select(mark, "h", "text", "m").mapInArrow(frugal(run), schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score_text, score_metadata, score, predicted, kept`` of every row.

    Scores are probabilities of good quality; ``predicted`` is 1 from 0.5 on, and ``kept`` says
    the same. Null text is empty. Null metadata is a value of its own. Without labels of both
    classes every score is 0.5 and all is kept. Rows with equal ids are scored each by itself.
    """
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
    shipped = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))
    rows = with_metadata(docs).withColumn("held_out", crc_fold(F.col("doc_id"), FOLDS) == HELD_OUT)
    doubles = [T.StructField(c, T.DoubleType()) for c in ("score_text", "score_metadata", "score")]
    schema = T.StructType([docs.schema["doc_id"], T.StructField("held_out", T.BooleanType()), *doubles, T.StructField("predicted", T.IntegerType()), T.StructField("kept", T.BooleanType())])

    def run(batches):
        model = shipped.value
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for a, b in slices(offsets):
                if model is None:
                    scores = (np.full(b - a, 0.5),) * 3
                else:
                    scores = model.scores(text_view(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), meta_matrix(batch.column("m").slice(a, b - a).to_pylist()))
                good = scores[2] >= 0.5
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("held_out").slice(a, b - a), *[pa.array(s) for s in scores], pa.array(good.astype(np.int32)), pa.array(good)], names=schema.names)

    return rows.mapInArrow(frugal(run), schema)
