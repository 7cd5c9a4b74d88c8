"""Events of one story become one: the span they grow to, refusal without a payoff, and where each original went.

Events are runs of a recording's rows: start_id to end_id, s and e being the bounds of those rows. Rows end later the
later they start. A lineage says for each event (rec, id) into which it went; null stands for one that was rejected.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import graph
from .rules import same_story

GROUP = ["rec", "component"]
EVENT = ["rec", "id", "s", "e", "start_id", "end_id", "score", "unfinished"]
PAYOFF = "payoff"


@dataclass
class Merged:
    """survivors: events and how they came to be; lineage: rec, id, into, reason of every event; evidence: rec, id, row, quote, role of survivors."""

    survivors: DataFrame
    lineage: DataFrame
    evidence: DataFrame


def _reached(pulls: DataFrame, width: int) -> DataFrame:
    """``pulls`` (GROUP, side, id, start, trigger, value) that are reached from ``start``: each one whose trigger the largest value so far is not short of.

    In the order of triggers the first that lies beyond all values before it ends the reach, whatever comes after. The
    values before are those of earlier slices of ``width``, one row each, and those before in its own slice; so a group
    with many events is spread over slices.
    """
    side = [*GROUP, "side"]
    sliced = pulls.withColumn("slice", F.floor(F.col("trigger") / width))
    tops = sliced.groupBy(*side, "slice").agg(F.max("value").alias("top"))
    earlier = F.max("top").over(Window.partitionBy(*side).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    inside = F.max("value").over(Window.partitionBy(*side, "slice").orderBy("trigger", "id").rowsBetween(Window.unboundedPreceding, -1))
    met = sliced.withColumn("inside", inside).join(tops.select(*side, "slice", earlier.alias("earlier")), [*side, "slice"])
    short = F.col("trigger") > F.greatest("start", "inside", "earlier")
    first = met.where(short).groupBy(*side).agg(F.min("trigger").alias("end"))
    return pulls.join(first, side, "left").where("end IS NULL OR trigger < end").drop("end")


def close_spans(events: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """One row for each group of events (EVENT, component): chosen, s, e, start_id, end_id, score, unfinished, members, absorbed.

    The longest telling is chosen (then the higher score, the smaller id). Its span absorbs every event of the group that
    overlaps it by half of the shorter, in time or in rows, and grows with each until none is left; rows are measured
    against the shorter of the event and the chosen telling, so that the order of absorption does not matter. No event is longer than
    the chosen one, so each extends it at one end only, and whether it is absorbed depends on that end alone: it
    has to come up to the event's middle. So a chain of any length needs one pass and no rounds.
    Without events there are no groups; ties and repeats of an event (another id) are absorbed like others.
    """
    length = F.col("e") - F.col("s")
    rank = F.struct(length.alias("length"), F.coalesce("score", F.lit(0)).alias("score"), (-F.col("id")).alias("order"), "s", "e", "start_id", "end_id")
    best = events.groupBy(*GROUP).agg(F.max(rank).alias("best"), F.count(F.lit(1)).alias("members"), F.max(F.coalesce("score", F.lit(0))).alias("score"), F.bool_or(F.coalesce("unfinished", F.lit(False))).alias("unfinished"))
    core = best.select(*GROUP, (-F.col("best.order")).alias("chosen"), *[F.col(f"best.{c}").alias(f"{c}0") for c in ("s", "e", "start_id", "end_id")], "members", "score", "unfinished")
    others = events.select(*GROUP, "id", "s", "e", "start_id", "end_id").join(core.where("members > 1").drop("members", "score", "unfinished"), GROUP).where("id <> chosen")
    # Rows of the event that the span has to hold, counted from the side it comes from.
    fewer = F.least(F.col("end_id") - F.col("start_id"), F.col("end_id0") - F.col("start_id0")) + 1
    half = F.floor((fewer + 1) / 2).cast("long")
    later = F.col("e") > F.col("e0")
    within = others.where("s >= s0 AND e <= e0")
    beyond = others.where("s < s0 OR e > e0").withColumns({"side": F.when(later, 1).otherwise(-1), "row": F.when(later, F.col("start_id") - 1 + half).otherwise(F.col("end_id") + 1 - half)})
    beyond = beyond.join(rows.select("rec", F.col("id").alias("row"), F.col("s").alias("row_s"), F.col("e").alias("row_e")), ["rec", "row"], "left")
    # In half milliseconds; the near side runs backwards, so that both reach upwards.
    pulls = beyond.select(
        *GROUP, "side", "id", "s", "e", "start_id", "end_id", F.when(later, 2 * F.col("e0")).otherwise(-2 * F.col("s0")).alias("start"),
        F.when(later, F.least(F.col("s") + F.col("e"), 2 * F.col("row_e"))).otherwise(-F.greatest(F.col("s") + F.col("e"), 2 * F.col("row_s"))).alias("trigger"),
        F.when(later, 2 * F.col("e")).otherwise(-2 * F.col("s")).alias("value"),
    )
    bounds = [*GROUP, "id", "s", "e", "start_id", "end_id"]
    absorbed = within.select(*bounds).unionByName(_reached(pulls, width).select(*bounds))
    grown = absorbed.groupBy(*GROUP).agg(F.min("s").alias("s"), F.max("e").alias("e"), F.min("start_id").alias("start_id"), F.max("end_id").alias("end_id"), F.count(F.lit(1)).alias("absorbed"))
    out = core.join(grown, GROUP, "left")
    return out.select(
        *GROUP, "chosen", F.least("s0", "s").alias("s"), F.greatest("e0", "e").alias("e"), F.least("start_id0", "start_id").alias("start_id"), F.greatest("end_id0", "end_id").alias("end_id"),
        "score", "unfinished", "members", F.coalesce("absorbed", F.lit(0)).alias("absorbed"),
    )


def merge_windows(events: DataFrame, edges: DataFrame, evidence: DataFrame, rows: DataFrame, width: int) -> Merged:
    """Each component of events (EVENT) over same-story edges (rec, a, b) becomes its grown span, under the chosen event's id.

    Evidence (rec, id, row, quote, role) counts once and only within the span. A group left with no payoff there is
    refused: its events stay as they were. So do events without an edge, with all their evidence. Null roles are no payoff.
    """
    grouped = graph.settled(events.select(*EVENT).join(graph.components(events, edges), ["rec", "id"]))
    spans = graph.settled(close_spans(grouped, rows, width))
    shown = evidence.select("rec", "id", "row", "quote", "role").join(grouped.select("rec", "id", "component"), ["rec", "id"])
    held = shown.join(spans.where("members > 1").select(*GROUP, "chosen", "start_id", "end_id"), GROUP).where("row BETWEEN start_id AND end_id")
    held = held.select(*GROUP, F.col("chosen").alias("id"), "row", "quote", "role").distinct()
    paid = held.groupBy(*GROUP).agg(F.bool_or(F.col("role") == PAYOFF).alias("paid"))
    judged = graph.settled(spans.join(paid, GROUP, "left").withColumn("merged", (F.col("members") > 1) & F.coalesce("paid", F.lit(False))))
    verdict = judged.select(*GROUP, "chosen", "merged", "members")
    method = F.when(~F.col("merged"), F.when(F.col("members") > 1, "refused")).when(F.col("absorbed") > 0, "overlapping").otherwise("near_duplicate")
    one = judged.where("merged").select("rec", F.col("chosen").alias("id"), "s", "e", "start_id", "end_id", "score", "unfinished", method.alias("method"))
    as_before = grouped.join(verdict.where("NOT merged"), GROUP).select(*EVENT, F.when(F.col("members") > 1, "refused").alias("method"))
    lineage = grouped.join(verdict, GROUP).select("rec", "id", F.when(F.col("merged"), F.col("chosen")).otherwise(F.col("id")).alias("into"), F.lit(None).cast("string").alias("reason"))
    own = shown.join(verdict.where("NOT merged").select(*GROUP), GROUP).select("rec", "id", "row", "quote", "role")
    kept = held.join(verdict.where("merged").select(*GROUP), GROUP).select("rec", "id", "row", "quote", "role")
    return Merged(one.unionByName(as_before), lineage, own.unionByName(kept))


def compose(first: DataFrame, second: DataFrame) -> DataFrame:
    """The lineage of two passes, the second over what the first left: an event goes where the one that it went into goes, a rejection's reason with it."""
    then = second.select("rec", F.col("id").alias("into"), F.col("into").alias("final"), F.col("reason").alias("later"), F.lit(True).alias("seen"))
    both = first.join(then, ["rec", "into"], "left")
    return both.select("rec", "id", F.when(F.col("seen"), F.col("final")).otherwise(F.col("into")).alias("into"), F.coalesce("reason", "later").alias("reason"))


def members(lineage: DataFrame) -> DataFrame:
    """rec, into, id of every original that a survivor stands for."""
    return lineage.where("into IS NOT NULL").select("rec", "into", "id")


def still_overlapping(events: DataFrame) -> DataFrame:
    """Events with ``component``, the smallest id of the run of events that share rows, of runs of two or more."""
    before = F.max("end_id").over(Window.partitionBy("rec").orderBy("start_id", "end_id", "id").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("start_id") <= before, 0).otherwise(1)
    run = F.sum("fresh").over(Window.partitionBy("rec").orderBy("start_id", "end_id", "id"))
    runs = events.withColumn("fresh", fresh).withColumn("run", run)
    size = runs.groupBy("rec", "run").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("component")).where("n > 1")
    return runs.join(size, ["rec", "run"]).drop("fresh", "run", "n")


def decide_by_score(runs: DataFrame, evidence: DataFrame) -> DataFrame:
    """A lineage for runs of overlapping events: those with a payoff go into the best scored of them, others are rejected; a run without any keeps its best."""
    paid = evidence.groupBy("rec", "id").agg(F.bool_or(F.col("role") == PAYOFF).alias("paid"))
    judged = runs.join(paid, ["rec", "id"], "left").withColumn("paid", F.coalesce("paid", F.lit(False)))
    rank = F.struct("paid", F.coalesce("score", F.lit(0)), F.col("e") - F.col("s"), -F.col("id"))
    best = judged.groupBy(*GROUP).agg(F.max_by("id", rank).alias("best"))
    stays = F.col("paid") | (F.col("id") == F.col("best"))
    return judged.join(best, GROUP).select("rec", "id", F.when(stays, F.col("best")).alias("into"), F.when(~stays, "no payoff of its own").alias("reason"))


def consolidate(events: DataFrame, evidence: DataFrame, rows: DataFrame, width: int, edges: Callable[[DataFrame], DataFrame] | None = None, decide: Callable[[DataFrame, DataFrame], DataFrame] = decide_by_score) -> Merged:
    """Merge same-story events, then decide on those that still share rows, over and over until none do.

    ``edges`` gives same-story pairs of events, ``decide`` a lineage for the runs that share rows (a reviewer's answers as
    a table, for instance). The lineage of all rounds says where every original went. A round that leaves as many
    events as it was given while some still overlap can't end, and is refused.
    """
    edges = edges or (lambda rows_: same_story(rows_, width))
    current, shown = graph.settled(events.select(*EVENT)), evidence.select("rec", "id", "row", "quote", "role")
    lineage = current.select("rec", "id", F.col("id").alias("into"), F.lit(None).cast("string").alias("reason"))
    while True:
        merged = merge_windows(current, edges(current), shown, rows, width)
        survivors, shown = graph.settled(merged.survivors), graph.settled(merged.evidence)
        lineage = graph.settled(compose(lineage, merged.lineage))
        runs = graph.settled(still_overlapping(survivors.select(*EVENT)))
        if runs.isEmpty():
            return Merged(survivors, lineage, shown)
        step = graph.settled(decide(runs, shown))
        lineage = graph.settled(compose(lineage, step))
        moved = step.select("rec", "id", "into", F.lit(True).alias("moved"))
        placed = survivors.select(*EVENT).join(moved, ["rec", "id"], "left").withColumn("into", F.when(F.col("moved"), F.col("into")).otherwise(F.col("id"))).where("into IS NOT NULL")
        after = graph.settled(placed.groupBy("rec", F.col("into").alias("id")).agg(
            F.min("s").alias("s"), F.max("e").alias("e"), F.min("start_id").alias("start_id"), F.max("end_id").alias("end_id"), F.max("score").alias("score"), F.bool_or("unfinished").alias("unfinished")))
        if after.count() >= survivors.count():
            raise ValueError("a round of decisions must leave fewer events while some share rows")
        shown = graph.settled(shown.join(placed.select("rec", "id", "into"), ["rec", "id"]).select("rec", F.col("into").alias("id"), "row", "quote", "role").distinct())
        current = after
