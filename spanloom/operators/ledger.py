"""The edit ledger against the ranges that are kept now: what flips, what nobody recorded, what each cut owes to whom."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import intervals as iv

MANUAL = "ranges adjusted by hand"


@dataclass
class Refreshed:
    """items: the ledger's rows as they are now, then manual ones; regions: each cut with reasons and ids; totals: one row a clip."""

    items: DataFrame
    regions: DataFrame
    totals: DataFrame


def refresh(ledger: DataFrame, kept: DataFrame, clips: DataFrame, keys: Sequence[str], width: int, manual: bool = False) -> Refreshed:
    """Compare the ledger (keys, id, at, s, e, status, reason; ``at`` is the row's place) with the kept ranges of each clip (lo, hi).

    What the kept ranges leave of a clip is cut. A row is judged if it lies in its clip: an applied one that no
    longer meets a cut is restored. With ``manual`` a restored one that meets a cut is applied again, and pieces
    of cuts that no applied row explains become applied rows of their own, ``manual:<s>:<e>``; so each moment of
    a cut then has a row. Rows outside their clip, without times or without a clip stay as they are and explain nothing.
    A clip without kept ranges is cut whole. Pieces up to the tolerance don't count. Rows that repeat are judged
    alike; ids must be unique within a key.
    """
    keys, eps = list(keys), iv.EPSILON_MS
    cuts = iv.complement(iv.union(kept, keys, eps, eps), clips, keys, 0, eps).withColumn("region", F.col("s"))
    fits = (F.col("s") >= F.col("lo") - eps) & (F.col("e") > F.col("s")) & (F.col("e") <= F.col("hi") + eps)
    placed = ledger.join(clips.select(*keys, "lo", "hi"), keys, "left").withColumn("fits", F.coalesce(fits, F.lit(False))).drop("lo", "hi")
    met = iv.intersections(placed.where("fits").select(*keys, "id", "s", "e"), cuts, keys, width, eps)
    effective = met.groupBy(*keys, "id").agg(F.sum(F.col("e") - F.col("s")).alias("effective"))
    judged = placed.join(effective, [*keys, "id"], "left").withColumn("was", F.col("status"))
    again = F.lit(manual) & (F.col("was") == "restored") & F.col("effective").isNotNull()
    gone = (F.col("was") == "applied") & F.col("fits") & F.col("effective").isNull()
    judged = judged.withColumn("status", F.when(again, "applied").when(gone, "restored").otherwise(F.col("was")))
    judged = judged.withColumns({
        "decision": F.when(again, "manual"),
        "reason": F.when(again, F.concat_ws("; ", F.lit(MANUAL), "reason")).otherwise(F.col("reason")),
        "effective": F.when(F.col("status") == "applied", F.coalesce("effective", F.lit(0))).otherwise(F.lit(0)),
    })
    columns = [*keys, "id", "at", "s", "e", "was", "status", "decision", "reason", "effective"]
    items = judged.withColumn("id", F.col("id").cast("string")).select(*columns)
    owed = met.join(judged.where("status = 'applied'").select(*keys, "id", "at", "reason"), [*keys, "id"])
    owed = owed.select(*keys, "region", F.lit(0).alias("turn"), "at", F.col("id").cast("string").alias("id"), "reason", "s", "e")
    if manual:
        rest = iv.subtract(cuts, owed.select(*keys, "s", "e"), keys, width, eps)
        name = F.concat_ws(":", F.lit("manual"), F.col("s").cast("string"), F.col("e").cast("string"))
        made = rest.select(*keys, "region", F.lit(1).alias("turn"), F.col("s").alias("at"), name.alias("id"), F.lit(MANUAL).alias("reason"), "s", "e")
        owed = owed.unionByName(made)
        items = items.unionByName(made.select(
            *keys, "id", F.lit(None).cast(items.schema["at"].dataType).alias("at"), "s", "e", F.lit(None).cast("string").alias("was"), F.lit("applied").alias("status"), F.lit("manual").alias("decision"),
            "reason", (F.col("e") - F.col("s")).alias("effective"),
        ))
    told = owed.groupBy(*keys, "region").agg(F.sort_array(F.collect_list(F.struct("turn", "at", "id", "reason"))).alias("told"))
    reasons = F.array_join(F.array_distinct(F.transform("told", lambda x: F.coalesce(x["reason"], F.lit("")))), "; ")
    regions = cuts.join(told, [*keys, "region"], "left").select(
        *keys, "s", "e", F.coalesce(F.nullif(reasons, F.lit("")), F.lit(MANUAL)).alias("reason"), F.coalesce(F.col("told.id"), F.array().cast("array<string>")).alias("ids"))
    count = lambda x: F.count_if(F.col("status") == x).alias(x)
    counts = items.groupBy(*keys).agg(F.count(F.lit(1)).alias("suggested"), count("blocked"), count("applied"))
    removed = cuts.groupBy(*keys).agg(F.sum(F.col("e") - F.col("s")).alias("removed"))
    totals = clips.select(*keys, (F.col("hi") - F.col("lo")).alias("source")).join(removed, keys, "left").join(counts, keys, "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    totals = totals.select(*keys, "source", n("removed"), (F.col("source") - F.coalesce("removed", F.lit(0))).alias("output"), n("suggested"), n("blocked"), n("applied"))
    return Refreshed(items, regions, totals)
