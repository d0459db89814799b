"""Connected components: union-find in one task for few edges, else repeated hooking and contraction.

Each pass orients every edge from its end of higher hashed rank to the lower one, lets each node hook to
its lowest neighbour, follows the resulting forest to its roots by pointer doubling, and contracts.
No neighbourhood is gathered; tables in the shared folder cut the lineage.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize

FEW_EDGES = 200_000


def _in_one_task(edges: DataFrame) -> DataFrame:
    """The same for at most FEW_EDGES edges."""

    def run(batches):
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = find(u), find(v)
                parent[max(a, b)] = min(a, b)
        found = np.array([(x, find(x)) for x in list(parent)], np.int64).reshape(-1, 2)
        found = found[found[:, 0] != found[:, 1]]
        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["node", "root"])

    return edges.coalesce(1).mapInArrow(run, "node long, root long")


def _to_roots(parents: DataFrame) -> DataFrame:
    """(node, root) of a forest (node, root) whose roots have no row."""
    while True:
        up = parents.select(F.col("node").alias("root"), F.col("root").alias("above"))
        jumped = materialize(parents.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "parents")
        parents = jumped.select("node", "root")
        if jumped.where("moved").isEmpty():
            return parents


def relabel(frame: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """``column`` replaced by its root where ``labels`` (node, root) has one."""
    known = labels.select(F.col("node").alias(column), F.col("root").alias("_root"))
    return frame.join(known, column, "left").withColumn(column, F.coalesce("_root", column)).drop("_root")


def components(links: DataFrame, count: int) -> DataFrame:
    """(node, root) of every linked node that is not itself its component's root; nodes are longs, links ``count`` at most."""
    if count <= FEW_EDGES:
        return materialize(_in_one_task(links.select("u", "v")), "labels")
    edges = materialize(links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct(), "edges", rows=count)
    labels, turn = None, 0
    while not edges.isEmpty():
        end = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("rank"), F.col(c).alias("id"))  # noqa: B023, E731
        ends = F.array_sort(F.array(end("u"), end("v")))
        hooks = edges.select(ends.alias("e")).groupBy(F.col("e")[1]["id"].alias("node")).agg(F.min(F.col("e")[0]["rank"]).alias("rank"), F.min_by(F.col("e")[0]["id"], F.col("e")[0]["rank"]).alias("root"))
        step = _to_roots(hooks.select("node", "root"))
        labels = step if labels is None else materialize(relabel(labels, step, "root").unionByName(step), "labels")
        edges = relabel(relabel(edges, step, "u"), step, "v").where("u <> v")
        edges = materialize(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
        turn += 1
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")) if labels is None else labels
