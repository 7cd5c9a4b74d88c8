"""Components by joins of tables that look small by their columns and are not."""

from pyspark.sql import functions as F

from spanloom.operators import graph


def test_no_round_broadcasts_by_an_estimate(spark, monkeypatch):
    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df.localCheckpoint()

    monkeypatch.setattr(graph, "settled", seen)
    nodes = spark.range(1, 50).select(F.lit(1).cast("long").alias("rec"), "id")
    edges = spark.range(1, 49).select(F.lit(1).cast("long").alias("rec"), F.col("id").alias("a"), (F.col("id") + 1).alias("b")).where("a % 10 <> 0")
    found = {r["id"]: r["component"] for r in graph.components(nodes, edges).collect()}
    assert found == {i: (i - 1) // 10 * 10 + 1 for i in range(1, 50)}
    assert sum("SortMergeJoin" in p for p in plans) >= 2 and not any("Broadcast" in p for p in plans)
