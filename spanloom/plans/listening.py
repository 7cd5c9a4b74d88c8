"""Registered queries: proposed cuts against what listeners marked."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import listening
from .catalogue import query
from .views import WIDTH, ev, read


@query()
def listening_scores(spark, d):
    """Views as proposed cuts, clicks as deletable ranges, purchases as protected ones; a sample is a customer, by market segment."""
    samples = read(spark, d, "customer").select(F.col("c_custkey").alias("rec"), F.col("c_mktsegment").alias("category"))
    events = ev(spark, d).select("rec", "id", "kind", "s", "e")
    kind = lambda k: events.where(F.col("kind") == k).drop("kind")
    return listening.report(samples, kind("view").select("rec"), kind("click"), kind("view"), kind("purchase"), WIDTH)
