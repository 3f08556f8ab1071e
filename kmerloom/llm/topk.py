"""Exact top-k search by inner product with multi-resolution segment statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import frugal

#: Segments a vector is cut into, coarse to fine.
LEVELS = (1, 4, 16)
QUERIES_PER_BLOCK = 1024
VECTORS_PER_BLOCK = 1024


def scaled(vectors: DataFrame, factor: int = 256) -> DataFrame:
    """``id, v``: floor(factor * x) of each component; vectors that are null or hold null or non-finite values go."""
    x = F.col("embedding")
    good = x.isNotNull() & F.coalesce(F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))), F.lit(False))
    whole = F.transform(x, lambda e: F.floor(e.cast("double") * factor).cast("long"))
    return vectors.where(good).select(F.col("vec_id").cast("long").alias("id"), whole.alias("v"))


class Resolution:
    """Means and deviations of the segments of many vectors, for every level."""

    def __init__(self, matrix: np.ndarray):
        self.sizes, self.means, self.deviations = [], [], []
        width = matrix.shape[1]
        for level in LEVELS:
            if level > max(1, width):
                break
            edges = np.linspace(0, width, level + 1).astype(int)
            sizes = np.maximum(np.diff(edges), 1)
            parts = [matrix[:, a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
            self.sizes.append(sizes.astype(float))
            self.means.append(np.stack([p.sum(axis=1) / n for p, n in zip(parts, sizes, strict=True)], axis=1))
            self.deviations.append(np.stack([p.std(axis=1) if p.shape[1] else np.zeros(len(p)) for p in parts], axis=1))


def least_distances(level: int, one: Resolution, many: Resolution, i: int, which: np.ndarray) -> np.ndarray:
    """Lower bounds of squared distances: sum of size * ((mean - mean)^2 + (deviation - deviation)^2)."""
    means = many.means[level][which] - one.means[level][i]
    deviations = many.deviations[level][which] - one.deviations[level][i]
    return (means * means + deviations * deviations) @ one.sizes[level]


def best_of_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query the ids and scores of its k best in the block, ties to the smaller id.

    A score is (|q|^2 + |v|^2 - distance^2) / 2, so a lower bound of the distance bounds it from
    above. The exact scores of the k most promising vectors set the mark; who cannot reach it at
    one level is not looked at on the next, and only survivors of all levels are scored.
    """
    q, v = queries.astype(np.float64), vectors.astype(np.float64)
    of_q, of_v = Resolution(q), Resolution(v)
    square_q, square_v = (q * q).sum(axis=1), (v * v).sum(axis=1)
    for i in range(len(q)):
        alive = np.flatnonzero(ids != query_ids[i])
        mark = None
        for level in range(len(of_q.sizes)):
            if len(alive) <= k:
                break
            bound = (square_q[i] + square_v[alive] - least_distances(level, of_q, of_v, i, alive)) / 2
            bound += 1 + 1e-9 * (square_q[i] + square_v[alive])
            first = alive[np.argpartition(-bound, k - 1)[:k]]
            reached = np.partition(vectors[first] @ queries[i], 0)[0]
            mark = reached if mark is None else max(mark, reached)
            alive = alive[bound >= mark]
        scores = vectors[alive] @ queries[i]
        order = np.lexsort((ids[alive], -scores))[:k]
        yield i, ids[alive][order], scores[order]


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy().reshape(-1, width) if width else np.zeros((len(lists), 0), np.int64)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, factor: int = 256) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k highest inner products of each query row.

    Queries: rows whose id is divisible by ``every``; candidates: all other rows of the same
    width (a row is no candidate of a query with its own id). Vectors that are null or hold
    null or non-finite components take no part, nor do rows without an id. Fewer candidates
    than k give fewer rows. Of query rows with one id that with the least vector asks; as candidates
    of others all of them count. Equal scores go to the smaller id. Scores are exact integers.

    Both sides are packed into blocks of one width; every block of vectors meets every block of
    queries in one cell of a grid, and a pair of blocks returns k rows a query. No side is
    collected or broadcast; the grid is as many cells as there are shuffle partitions.
    """
    rows = scaled(vectors, factor).where("id IS NOT NULL").withColumn("width", F.size("v"))
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def blocks(df: DataFrame, size: int) -> DataFrame:
        def run(batches):
            held: dict[int, list] = {}
            for batch in batches:
                width = batch.column("width").to_numpy()
                for w in np.unique(width):
                    take = batch.take(pa.array(np.flatnonzero(width == w)))
                    held.setdefault(int(w), []).append((take.column("id").to_numpy(), _matrix(take.column("v"), int(w))))
                    if sum(len(x[0]) for x in held[int(w)]) >= size:
                        yield from packed(int(w), held.pop(int(w)))
            for w, found in held.items():
                yield from packed(w, found)

        def packed(w, found):
            ids, matrix = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
            for a in range(0, len(ids), size):
                yield pa.RecordBatch.from_arrays([pa.array([w], pa.int32()), pa.array([ids[a : a + size].astype("<i8").tobytes()], pa.binary()), pa.array([matrix[a : a + size].astype("<i8").tobytes()], pa.binary())], names=["width", "ids", "matrix"])

        return df.mapInArrow(frugal(run, None), "width int, ids binary, matrix binary")

    # a grid of cells: vectors are dealt out over its lines and queries over its columns
    columns = max(1, round((parts / every) ** 0.5))
    lines = -(-parts // columns)
    asked = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v")).withColumn("width", F.size("v"))
    queries = blocks(asked.repartition(max(1, parts // 8)), QUERIES_PER_BLOCK)
    queries = queries.withColumnsRenamed({"ids": "q_ids", "matrix": "q_matrix"}).withColumn("column", F.pmod(F.xxhash64("q_ids"), F.lit(columns)).cast("int")).withColumn("line", F.explode(F.sequence(F.lit(0), F.lit(lines - 1))))
    candidates = blocks(rows, VECTORS_PER_BLOCK)
    candidates = candidates.withColumnsRenamed({"ids": "c_ids", "matrix": "c_matrix"}).withColumn("line", F.pmod(F.xxhash64("c_ids"), F.lit(lines)).cast("int")).withColumn("column", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
    # sizes that Spark estimates know neither the blocks nor their copies; without the hint all copies of
    # all queries pass through the driver wherever the rows they are made of seem small
    pairs = candidates.hint("merge").join(queries.hint("merge"), ["width", "line", "column"]).drop("line", "column")

    def search(batches):
        for batch in batches:
            for row in batch.to_pylist():
                width = row["width"]
                q_ids, c_ids = np.frombuffer(row["q_ids"], "<i8"), np.frombuffer(row["c_ids"], "<i8")
                q, c = np.frombuffer(row["q_matrix"], "<i8").reshape(len(q_ids), width), np.frombuffer(row["c_matrix"], "<i8").reshape(len(c_ids), width)
                found = list(best_of_block(q_ids, q, c_ids, c, k))
                n = [len(x[1]) for x in found]
                if sum(n):
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids[[x[0] for x in found]], n)), pa.array(np.concatenate([x[1] for x in found])), pa.array(np.concatenate([x[2] for x in found]))], names=["query_id", "vec_id", "score"])

    partial = pairs.mapInArrow(frugal(search, None), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return partial.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


TOP_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank::INTEGER AS rank, vec_id, coalesce(score, 0) AS score FROM r WHERE rank <= 5
"""
