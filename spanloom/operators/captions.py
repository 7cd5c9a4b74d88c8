"""Captions, kept ranges and words: checks, re-rendering and sampling along a recording's rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import intervals as iv

#: Shortest kept range and the overlap it may have, characters of a caption line, length of a
#: part of a review, padding around a word, and the overlap of plan ranges that is split in the middle.
RANGE_MS, RANGE_OVERLAP_MS, LINE_CHARS, PART_MS, WORD_PAD_MS, PLAN_OVERLAP_MS = 40, 1, 36, 240_000, 25, 351
#: Where a part's sample frames stand, in hundredths of its length.
FRAMES = (5, 23, 41, 59, 77, 95)


def range_violations(ranges: DataFrame, clips: DataFrame) -> DataFrame:
    """rec, id, rule of ranges that are short, outside the clip, or overlap an earlier one."""
    order = Window.partitionBy("rec").orderBy("s", "e", "id").rowsBetween(Window.unboundedPreceding, -1)
    seen = ranges.withColumn("_end", F.max("e").over(order)).join(clips, "rec")
    outside = (F.col("s") < F.col("lo") - RANGE_OVERLAP_MS) | (F.col("e") > F.col("hi") + RANGE_OVERLAP_MS)
    rule = F.when(F.col("e") - F.col("s") < RANGE_MS, "short").when(outside, "outside").when(F.col("_end") - F.col("s") > RANGE_OVERLAP_MS, "overlap")
    return seen.select("rec", "id", rule.alias("rule")).where("rule IS NOT NULL")


def clean_cues(cues: DataFrame, length_ms: int) -> DataFrame:
    """rec, id, s, e, text of cues (ord instead of id) in time and with a text; ids follow the input, before any sort."""
    good = cues.where((F.col("s") >= 0) & (F.col("s") < F.col("e")) & (F.col("e") <= length_ms + 50) & (F.trim("text") != ""))
    return good.select("rec", (F.row_number().over(Window.partitionBy("rec").orderBy("ord")) - 1).cast("long").alias("id"), "s", "e", "text")


def crossing(rows: DataFrame, kept: DataFrame, keys: Sequence[str], width: int, eps: int = iv.EPSILON_MS) -> DataFrame:
    """The rows inside which a kept range begins or ends."""
    edges = kept.select(*keys, F.explode(F.array("s", "e")).alias("at")).distinct()
    edges = edges.select(*keys, (F.col("at") - eps - 1).alias("s"), (F.col("at") + eps + 1).alias("e"), "at")
    hit = iv.overlap_join(rows, edges, keys, width).where((F.col("at") > F.col("s") + eps) & (F.col("at") < F.col("e") - eps))
    return rows.join(hit.select(*keys, "id").distinct(), [*keys, "id"], "left_semi")


def two_lines(rows: DataFrame) -> DataFrame:
    """rec, id, piece, s, e, text: texts cut every 36 characters, the time shared evenly by the pieces."""
    pieces = F.greatest(F.lit(1), F.ceil(F.length("text") / LINE_CHARS)).cast("long")
    cut = rows.withColumn("_n", pieces).select("*", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("piece"))
    at = lambda k: F.col("s") + F.floor((F.col("e") - F.col("s")) * k / F.col("_n"))
    return cut.select("rec", "id", F.col("piece").cast("long").alias("piece"), at(F.col("piece")).alias("s"), at(F.col("piece") + 1).alias("e"), F.substring("text", (F.col("piece") * LINE_CHARS + 1).cast("int"), F.lit(LINE_CHARS)).alias("text"))


def quartile_rows(rows: DataFrame) -> DataFrame:
    """rec, id of the first, last and the rows at the quarters."""
    placed = rows.withColumns({"at": F.row_number().over(Window.partitionBy("rec").orderBy("id")) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy("rec"))})
    quarter = lambda k: F.floor(F.col("n") * k / 4)
    return placed.where((F.col("at") == 0) | (F.col("at") == F.col("n") - 1) | (F.col("at") == quarter(1)) | (F.col("at") == quarter(2)) | (F.col("at") == quarter(3))).select("rec", "id")


def spread_rows(rows: DataFrame, limit: int) -> DataFrame:
    """rec, id of ``limit`` rows spread evenly from the first to the last; all where there are no more."""
    placed = rows.withColumns({"at": F.row_number().over(Window.partitionBy("rec").orderBy("id")) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy("rec"))})
    near = F.round(F.col("at") * (limit - 1) / (F.col("n") - 1))
    hit = F.col("at") == F.floor(near * (F.col("n") - 1) / (limit - 1) + 0.5)
    return placed.where((F.col("n") <= limit) | hit).select("rec", "id")


def monotone(rows: DataFrame, value: str) -> DataFrame:
    """The rows whose value is not under any kept one before; the kept ones' largest is the largest so far."""
    order = Window.partitionBy("rec").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_top", F.max(value).over(order)).where(F.col("_top").isNull() | (F.col(value) >= F.col("_top"))).drop("_top")


def padded_words(words: DataFrame, pad: int = WORD_PAD_MS) -> DataFrame:
    """rec, id, s, e of words with some time around them, never into their neighbours."""
    order = Window.partitionBy("rec").orderBy("s", "id")
    before, after = F.lag("e").over(order), F.lead("s").over(order)
    return words.select("rec", "id", F.greatest(F.coalesce(before, F.col("s") - pad), F.col("s") - pad).alias("s"), F.least(F.coalesce(after, F.col("e") + pad), F.col("e") + pad).alias("e"))


def parts(clips: DataFrame, step: int = PART_MS) -> DataFrame:
    """rec, part, s, e: the clip in parts of equal length, the last one shorter."""
    count = F.greatest(F.lit(1), F.ceil((F.col("hi") - F.col("lo")) / step)).cast("long")
    cut = clips.select("rec", "lo", "hi", F.explode(F.sequence(F.lit(0), count - 1)).alias("part"))
    return cut.select("rec", F.col("part").cast("long").alias("part"), (F.col("lo") + F.col("part") * step).alias("s"), F.least(F.col("lo") + (F.col("part") + 1) * step, "hi").alias("e"))


def frames(clips: DataFrame) -> DataFrame:
    """rec, frame, at of the six sample frames of a clip."""
    cut = clips.select("rec", "lo", "hi", F.posexplode(F.array(*map(F.lit, FRAMES))).alias("frame", "hundredths"))
    return cut.select("rec", F.col("frame").cast("long").alias("frame"), (F.col("lo") + F.floor((F.col("hi") - F.col("lo")) * F.col("hundredths") / 100)).alias("at"))


def partly_hit(rows: DataFrame, regions: DataFrame, keys: Sequence[str], group: str, width: int, eps: int = iv.EPSILON_MS) -> DataFrame:
    """Groups of rows that the regions touch but do not cover."""
    whole = iv.union(regions, keys)
    hit = iv.overlap_join(rows, whole, keys, width, eps).groupBy(*keys, group).agg(F.sum(iv.overlap(F.col("s"), F.col("e"), F.col("s2"), F.col("e2"))).alias("covered"))
    total = rows.groupBy(*keys, group).agg(F.sum(F.col("e") - F.col("s")).alias("total"))
    return total.join(hit, [*keys, group]).where(F.col("total") - F.col("covered") > eps).select(*keys, group, "total", "covered")


def split_overlaps(ranges: DataFrame, most: int = PLAN_OVERLAP_MS) -> DataFrame:
    """rec, id, s, e of plan ranges in order; where neighbours overlap a little, both end in the middle."""
    order = Window.partitionBy("rec").orderBy("s", "id")
    before, after = F.lag("e").over(order) - F.col("s"), F.col("e") - F.lead("s").over(order)
    start = F.when(before.between(1, most), F.col("s") + before - F.floor(before / 2)).otherwise(F.col("s"))
    end = F.when(after.between(1, most), F.col("e") - F.floor(after / 2)).otherwise(F.col("e"))
    return ranges.select("rec", "id", start.alias("s"), end.alias("e"))


def unexplained(kept: DataFrame, applied: DataFrame, clips: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """What is neither kept nor cut by an applied candidate: deletions made by hand."""
    gone = iv.complement(kept, clips, keys, iv.EPSILON_MS, iv.EPSILON_MS)
    return iv.subtract(gone.withColumn("id", F.col("s")), applied, keys, width).drop("id")
