"""Document tables: upsert, compare-and-swap, eviction and protection of what is still referenced."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The table with the changed rows in place of those with their key; of changes with one key the last (column ord) counts."""
    newest = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("ord")))
    last = changes.withColumn("_n", newest).where("_n = 1").select(*table.columns)
    return table.join(last.select(key), key, "left_anti").select(*table.columns).unionByName(last)


def compare_and_swap(table: DataFrame, changes: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(the table after the changes whose ``seen`` revision is the current one, the changes that came too late)."""
    current = table.select(key, F.col("revision").alias("_now"))
    judged = changes.join(current, key, "left").withColumn("_ok", F.coalesce(F.col("seen") == F.col("_now"), F.lit(False)))
    first = F.row_number().over(Window.partitionBy(key, "_ok").orderBy("ord"))
    judged = judged.withColumn("_ok", F.col("_ok") & (first == 1))
    done = judged.where("_ok").withColumn("revision", F.col("seen") + 1)
    new = table.join(done.select(key), key, "left_anti").select(*table.columns).unionByName(done.select(*table.columns))
    return new, judged.where("NOT _ok").select(*changes.columns)


def evict(files: DataFrame, budget: int, order: str = "used") -> DataFrame:
    """The files to delete: the least recently used that are not protected, until the rest fits the budget."""
    total = files.agg(F.sum("bytes").alias("total"))
    before = Window.orderBy(order, "id").rowsBetween(Window.unboundedPreceding, -1)
    loose = files.where("NOT protected").withColumn("_before", F.coalesce(F.sum("bytes").over(before), F.lit(0)))
    return loose.crossJoin(total).where(F.col("total") - F.col("_before") > budget).select(*files.columns)  # total is one row


def deletable(files: DataFrame, references: DataFrame) -> DataFrame:
    """The files that no document refers to."""
    return files.join(references.select("path").distinct(), "path", "left_anti")
