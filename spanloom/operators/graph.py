"""Connected components per recording, by rounds of joins; no recording has to fit in one task."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .intervals import sorted_join


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the session's checkpoint folder; a session on this machine alone may do without one, and gets a folder of its own."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and context.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(root or f"file://{tempfile.mkdtemp(prefix='spanloom-')}")
    return df.checkpoint()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """rec, id, component of nodes (rec, id): the smallest id that edges (rec, a, b) lead to.

    A round gives each node the smallest label of its neighbours, then that label's own label, so that chains shorten
    geometrically. Nodes without edges keep their id; nodes and edges that repeat count once, edges to unknown nodes not.
    """
    one_way = edges.select("rec", "a", "b")
    both = settled(one_way.unionByName(one_way.select("rec", F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = settled(nodes.select("rec", "id").distinct().withColumn("label", F.col("id")))
    while True:
        near = sorted_join(both, labels.select("rec", F.col("id").alias("b"), F.col("label").alias("there")), ["rec", "b"])
        near = near.groupBy("rec", F.col("a").alias("id")).agg(F.min("there").alias("there"))
        low = settled(sorted_join(labels, near, ["rec", "id"], "left").select("rec", "id", F.col("label").alias("was"), F.least("label", "there").alias("label")))
        top = low.select("rec", F.col("id").alias("label"), F.col("label").alias("top"))
        new = settled(sorted_join(low, top, ["rec", "label"]).select("rec", "id", "was", F.col("top").alias("label")))
        if new.where("was <> label").isEmpty():
            return new.select("rec", "id", F.col("label").alias("component"))
        labels = new.select("rec", "id", "label")
