"""Pointer problems of proven small size, solved in one task.

A loop of joins costs seconds a round whatever the size. Below ONE_TASK rows, which is checked,
the rows go to a single task and numpy; beyond it the callers use their distributed form.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Rows of at most a few hundred bytes that one task may hold.
ONE_TASK = 1_000_000
#: Pairs of numbers that one task may hold.
ONE_TASK_PAIRS = 8_000_000


def is_small(df: DataFrame, limit: int = ONE_TASK) -> bool:
    return df.limit(limit + 1).count() <= limit


def _table(batches, columns: list[str]) -> pa.Table | None:
    found = [b for b in batches if len(b)]
    return pa.Table.from_batches(found).select(columns).combine_chunks() if found else None


def _chains(batches):
    table = _table(batches, ["node", "ptr", "weight"])
    if table is None:
        return
    node, ptr = table.column("node").combine_chunks(), table.column("ptr").combine_chunks()
    before = pc.fill_null(pc.index_in(ptr, value_set=node, skip_nulls=True), -1).to_numpy().astype(np.int64)
    weight = pc.fill_null(table.column("weight").cast(pa.int64()), 0).to_numpy()
    n = len(before)
    order = pc.sort_indices(node).to_numpy()
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    jump, pos, low = np.where(before >= 0, before, np.arange(n)), np.where(before >= 0, weight, 0), rank
    for _ in range(n.bit_length() + 1):
        pos, low, jump = pos + pos[jump], np.minimum(low, low[jump]), jump[jump]
    yield pa.RecordBatch.from_arrays([node, node.take(pa.array(jump)), pa.array(pos), node.take(pa.array(order[low])), pa.array(before[jump] < 0)], names=["node", "head", "pos", "low", "done"])


def chains(pointers: DataFrame) -> DataFrame:
    """``node, head, pos, low, done`` of ``node, ptr, weight``, as by doubling across the cluster."""
    return pointers.select("node", "ptr", "weight").coalesce(1).mapInArrow(_chains, "node string, head string, pos long, low string, done boolean")


def _components(batches):
    table = _table(batches, ["a", "b"])
    if table is None:
        return
    a, b = table.column("a").combine_chunks(), table.column("b").combine_chunks()
    if pa.types.is_integer(a.type):
        found, place = np.unique(np.concatenate([a.to_numpy(), b.to_numpy()]), return_inverse=True)
        ids, (a, b) = pa.array(found), place.reshape(2, -1)
    else:
        ids = pc.unique(pa.concat_arrays([a, b]))
        ids = ids.take(pc.sort_indices(ids))
        a, b = (pc.index_in(x, value_set=ids).to_numpy().astype(np.int64) for x in (a, b))
    label = np.arange(len(ids))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        # hook the labels, not only the ends, so that trees join at their roots
        for at in (a, b, label[a], label[b]):
            np.minimum.at(new, at, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    yield pa.RecordBatch.from_arrays([ids, ids.take(pa.array(label))], names=["id", "component"])


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` of the ends of ``edges (a, b)``; ids are ordered as text, or numbers."""
    kind = edges.schema["a"].dataType.simpleString()
    return edges.select("a", "b").coalesce(1).mapInArrow(_components, f"id {kind}, component {kind}")


def _reached(batches):
    table = _table(batches, ["a", "b"])
    if table is None:
        return
    a, b = table.column("a").combine_chunks(), table.column("b").combine_chunks()
    edge = b.is_valid().to_numpy(zero_copy_only=False)
    a, b = a.to_numpy(), b.fill_null(0).to_numpy()
    start, a, b = a[~edge], a[edge], b[edge]
    ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = place.reshape(2, -1)
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    first = np.searchsorted(a, np.arange(len(ids) + 1))
    seen = np.zeros(len(ids), bool)
    front = ids.searchsorted(start)
    front = np.unique(front[(front < len(ids)) & (ids[np.minimum(front, len(ids) - 1)] == start)]) if len(ids) else front[:0]
    while len(front):
        size = first[front + 1] - first[front]
        to = np.unique(b[np.arange(int(size.sum())) + np.repeat(first[front] - (np.cumsum(size) - size), size)])
        front = to[~seen[to]]
        seen[front] = True
    yield pa.RecordBatch.from_arrays([pa.array(ids[seen])], names=["id"])


def reached(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """``id``: what one step or more over ``edges (a, b)`` reaches from ``starts (id)``, all of them numbers."""
    rows = edges.select("a", "b").unionByName(starts.selectExpr("id AS a", "CAST(NULL AS BIGINT) AS b"))
    return rows.coalesce(1).mapInArrow(_reached, "id long")
