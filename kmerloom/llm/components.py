"""Connected components of links between ids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, frugal, written

#: Links that one task joins by itself.
TASK_LINKS = 1_000_000


def forest(batches):
    """``id, component`` of the links ``a, b`` of one task: the least id reachable over these links alone."""
    parts = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches if len(b)]
    if not parts:
        return
    ends = np.concatenate([x for part in parts for x in part])
    ids, at = np.unique(ends, return_inverse=True)
    cut = np.concatenate([[0], np.cumsum([2 * len(a) for a, _ in parts])])
    a = np.concatenate([at[x : x + len(p[0])] for x, p in zip(cut, parts, strict=False)])
    b = np.concatenate([at[x + len(p[0]) : x + 2 * len(p[0])] for x, p in zip(cut, parts, strict=False)])
    label = np.arange(len(ids))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        # the labels are hooked too, not only the ends, so that trees join at their roots
        for place in (a, b, label[a], label[b]):
            np.minimum.at(new, place, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ids[label], pa.int64())], names=["id", "component"])


def components(links: DataFrame) -> DataFrame:
    """``id, component``: the smallest id reachable over ``links (a, b)``.

    Links are dealt out over tasks of about TASK_LINKS each by their smaller end, and every task
    joins its own. With one task that is the result; else what the tasks found are the links
    (id to least id) of the rounds that follow. Every round takes the least label among neighbours
    and then the label of that label, so chains halve. Tables go to the shared folder; the driver
    sees only how many links there are and whether a label changed. Ids without a link are not
    in the result; null ids are dropped.
    """
    links = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b"))
    edges = written(links, "edges")
    tasks = -(-edges.count() // TASK_LINKS)
    dealt = edges.coalesce(1) if tasks <= 1 else edges.repartition(tasks, "a")
    trees = written(dealt.mapInArrow(frugal(forest), "id long, component long"), "trees")
    discard(edges)
    if tasks <= 1:
        return trees
    links = trees.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b"))
    edges = written(links.union(links.select("b", "a")).distinct(), "edges")
    labels = written(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")), "labels")
    discard(trees)
    last = labels
    while True:
        heard = edges.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("component").alias("heard"))
        step = labels.join(heard.withColumnRenamed("a", "id"), "id", "left").select("id", F.least("component", F.coalesce("heard", "component")).alias("next"), F.col("component").alias("was"))
        jump = labels.select(F.col("id").alias("next"), F.col("component").alias("beyond"))
        step = step.join(jump, "next", "left").select("id", F.least("next", F.coalesce("beyond", "next")).alias("component"), "was")
        step = written(step, "labels")
        discard(last)
        last, labels = step, step.select("id", "component")
        if step.where("component <> was").isEmpty():
            discard(edges)
            labels.written_to = step.written_to
            return labels
