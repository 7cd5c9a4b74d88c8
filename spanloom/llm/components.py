"""Connected components of an edge table, by smallest labels and pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace

#: Edges (16 bytes each) up to which one task joins them; more are worked on by all.
SMALL = 1_000_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for batch in batches:
        for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            low, high = sorted((find(a), find(b)))
            up[high] = low
    yield pa.RecordBatch.from_arrays([pa.array(list(up), pa.int64()), pa.array([find(x) for x in up], pa.int64())], names=["node", "label"])


def connected_components(edges: DataFrame, ws: Workspace, name: str = "components", small: int = SMALL) -> DataFrame:
    """node, label for every node of the edges (columns a, b): label is the component's smallest node.

    A number of edges that is counted first and small is joined in one task. Else each round gives a node
    the smallest label among its neighbours and then that label's own label, so chains shorten
    geometrically. Rounds end when nothing changes; nothing is gathered on the driver. An edge from a node
    to itself only names the node. Labels and edges are tables, so that a hot node's edges can be split,
    and its neighbours' labels meet first inside each task.
    """
    forth = ws.table(edges.select("a", "b").distinct(), f"{name}-distinct")
    if forth.count() <= small:
        return ws.table(forth.coalesce(1).mapInArrow(_joined, "node long, label long"), name)
    both = ws.table(forth.unionByName(forth.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = ws.table(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("label")), f"{name}-0")
    step = 0
    while True:
        step += 1
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("there")), "b").groupBy(F.col("a").alias("node")).agg(F.min("there").alias("there"))
        low = ws.table(labels.join(near, "node", "left").select("node", F.col("label").alias("was"), F.least("label", "there").alias("label")), f"{name}-low-{step}")
        up = low.select(F.col("node").alias("label"), F.col("label").alias("top"))
        new = ws.table(low.join(up, "label").select("node", "was", F.col("top").alias("label")), f"{name}-{step}")
        if new.where("was <> label").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")
