"""Algebra of half-open intervals kept as two columns, ``s`` and ``e``, per key.

Every operator takes and returns DataFrames. Times are whole milliseconds; tolerances are explicit
parameters, as edits, captions and scoring each use their own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The tolerance of edits and captions, in milliseconds, and the shortest piece that is kept.
EPSILON_MS = 2
MIN_PIECE_MS = 40
#: How many widths of buckets an overlap join has, and how many times as wide the next is; at the most 1,024 times the first.
LEVELS, FACTOR = 6, 4


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.least(e1, e2) - F.greatest(s1, s2)


def sorted_join(left: DataFrame, right: DataFrame, on: str | Sequence[str], how: str = "inner") -> DataFrame:
    """A join by sorting on both sides, never a broadcast: by files and columns Spark takes a table of many short rows for a small one."""
    return left.hint("merge").join(right.hint("merge"), on if isinstance(on, str) else list(on), how)


def _islands(df: DataFrame, keys: Sequence[str], eps: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("s", "e")
    before = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    flagged = df.withColumn("_new", F.when(before.isNull() | (F.col("s") > before + eps), 1).otherwise(0))
    numbered = flagged.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_island").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("_island")


def union(df: DataFrame, keys: Sequence[str], eps: int = 0, drop: int | None = None, slice_ms: int | None = None) -> DataFrame:
    """Merge intervals that overlap or lie at most ``eps`` apart; first leave out those not longer than ``drop``.

    With ``slice_ms`` the intervals that start in one slice of time are merged first, so that a key with
    many rows is spread over tasks and only its merged pieces meet in one.
    """
    rows = df.select(*keys, "s", "e")
    if drop is not None:
        rows = rows.where(F.col("e") - F.col("s") > drop)
    if slice_ms:
        rows = _islands(rows.withColumn("_slice", F.floor(F.col("s") / slice_ms)), [*keys, "_slice"], eps).drop("_slice")
    return _islands(rows, keys, eps)


def complement(df: DataFrame, clips: DataFrame, keys: Sequence[str], eps: int = 0, min_piece: int = 0) -> DataFrame:
    """What the union of the intervals leaves of each key's clip (columns lo, hi), in pieces longer than ``min_piece``."""
    inside = df.join(clips, list(keys)).where((F.col("e") > F.col("lo")) & (F.col("s") < F.col("hi")))
    inside = inside.select(*keys, F.greatest("s", "lo").alias("s"), F.least("e", "hi").alias("e"))
    edges = clips.select(*keys, F.col("lo").alias("s"), F.col("lo").alias("e")).unionByName(clips.select(*keys, F.col("hi").alias("s"), F.col("hi").alias("e")))
    merged = union(inside, keys, eps).unionByName(edges)
    order = Window.partitionBy(*keys).orderBy("s", "e")
    gaps = merged.select(*keys, F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("lo"), F.col("s").alias("hi"))
    return gaps.where(F.col("hi") - F.col("lo") > min_piece).select(*keys, F.col("lo").alias("s"), F.col("hi").alias("e"))


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[str], width: int, min_overlap: int = 0) -> DataFrame:
    """Pairs with the keys equal and more than ``min_overlap`` in common; the right side's s, e become s2, e2.

    Time is cut into buckets of ``width``, and again into ones FACTOR times as wide, on LEVELS levels. An interval's own
    level is the lowest whose buckets are as long as it is, so that it lies in two of them at most, whatever its length;
    on the levels above it is a guest. A pair meets on the level of its longer one, in the first bucket that both share;
    guests don't meet guests. The join is by equality and a hot key spreads over its buckets. It is never a broadcast:
    Spark's estimate knows nothing of the rows that dealing makes.
    """
    top = LEVELS - 1
    other = right.withColumnsRenamed({"s": "s2", "e": "e2"})
    step = lambda level: F.lit(width) * F.pow(F.lit(FACTOR), level)

    def deal(df: DataFrame, s: str, e: str, ways: Callable[[Column], Column]) -> DataFrame:
        own = reduce(lambda rest, i: F.when(F.col(e) - F.col(s) <= width * FACTOR**i, i).otherwise(rest), range(top - 1, -1, -1), F.lit(top))
        placed = df.withColumn("_own", own).withColumn("_level", F.explode(F.sequence("_own", F.lit(top))))
        placed = placed.withColumn("_way", F.explode(ways(F.col("_level") == F.col("_own"))))
        return placed.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(s) / step(F.col("_level"))), F.floor(F.col(e) / step(F.col("_level")))))).drop("_own")

    # On way 0 the left one is at home and the right one at home or a guest; on way 1 the left one is a guest of the right one.
    one, both = F.array(F.lit(0)), F.array(F.lit(0), F.lit(1))
    lefts = deal(left.where("e >= s"), "s", "e", lambda home: F.when(home, one).otherwise(F.array(F.lit(1))))
    rights = deal(other.where("e2 >= s2"), "s2", "e2", lambda home: F.when(home, both).otherwise(one))
    pairs = sorted_join(lefts, rights, [*keys, "_level", "_way", "_bucket"])
    first = F.floor(F.greatest("s", "s2") / step(F.col("_level")))
    return pairs.where((F.col("_bucket") == first) & (overlap(F.col("s"), F.col("e"), F.col("s2"), F.col("e2")) > min_overlap)).drop("_level", "_way", "_bucket")


def intersections(left: DataFrame, right: DataFrame, keys: Sequence[str], width: int, eps: int = EPSILON_MS) -> DataFrame:
    """The common pieces longer than ``eps`` of every pair, as s, e; further columns of both sides stay."""
    pairs = overlap_join(left, right, keys, width, eps)
    return pairs.withColumns({"s": F.greatest("s", "s2"), "e": F.least("e", "e2")}).drop("s2", "e2")


def subtract(regions: DataFrame, covers: DataFrame, keys: Sequence[str], width: int, eps: int = EPSILON_MS) -> DataFrame:
    """What the covers leave of each region (keys must name it), in pieces longer than ``eps``."""
    by = [c for c in regions.columns if c not in ("s", "e")]
    # A cover takes from the pieces that the covers before it left, and only where it meets them by more than
    # the tolerance; so the order counts where pieces are as short as that.
    met = overlap_join(regions, covers.select(*keys, "s", "e"), keys, width, eps).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("s2", "e2"))).alias("_covers"))
    none = F.array().cast("array<struct<s2:bigint,e2:bigint>>")
    piece = lambda s, e: F.struct(s.cast("long").alias("s"), e.cast("long").alias("e"))
    long = lambda p: p["e"] - p["s"] > eps
    rest = lambda p, c: F.filter(F.array(piece(p["s"], c["s2"]), piece(c["e2"], p["e"])), long)
    cut = lambda pieces, c: F.flatten(F.transform(pieces, lambda p: F.when(overlap(p["s"], p["e"], c["s2"], c["e2"]) > eps, rest(p, c)).otherwise(F.array(p))))
    # Null-safe, so that regions with a null in a key stay.
    left, right = regions.alias("_l"), met.alias("_r")
    joined = left.join(right, reduce(lambda a, b: a & b, [F.col(f"_l.{c}").eqNullSafe(F.col(f"_r.{c}")) for c in by]), "left")
    pieces = F.aggregate(F.coalesce(F.col("_r._covers"), none), F.array(piece(F.col("_l.s"), F.col("_l.e"))), cut)
    return joined.select(*[F.col(f"_l.{c}") for c in by], F.explode(pieces).alias("_p")).select(*by, "_p.s", "_p.e")


def semi(left: DataFrame, right: DataFrame, keys: Sequence[str], row: str, width: int, eps: int = EPSILON_MS) -> DataFrame:
    """The left rows that overlap any right one; ``row`` names a row."""
    return left.join(overlap_join(left, right.select(*keys, "s", "e"), keys, width, eps).select(row).distinct(), row, "left_semi")


def anti(left: DataFrame, right: DataFrame, keys: Sequence[str], row: str, width: int, eps: int = EPSILON_MS) -> DataFrame:
    """The left rows that overlap no right one."""
    return left.join(overlap_join(left, right.select(*keys, "s", "e"), keys, width, eps).select(row).distinct(), row, "left_anti")


def iou_join(left: DataFrame, right: DataFrame, keys: Sequence[str], width: int, percent: int = 50) -> DataFrame:
    """Pairs whose common part is at least ``percent`` of what they span together; with columns common and span."""
    pairs = overlap_join(left, right, keys, width)
    pairs = pairs.withColumn("common", overlap(F.col("s"), F.col("e"), F.col("s2"), F.col("e2"))).withColumn("span", F.greatest("e", "e2") - F.least("s", "s2"))
    return pairs.where(100 * F.col("common") >= percent * F.col("span"))


def running_offset(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows with ``offset``: the length of all rows before them, that is, where each begins on the output clock."""
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("offset", F.coalesce(F.sum(F.col("e") - F.col("s")).over(window), F.lit(0)))


def to_output(rows: DataFrame, kept: DataFrame, keys: Sequence[str], width: int, eps: int = EPSILON_MS) -> DataFrame:
    """Rows cut to the kept ranges and moved to the output clock; kept has s, e, offset."""
    pairs = overlap_join(rows, kept, keys, width, eps)
    start, end = F.greatest("s", "s2") - F.col("s2") + F.col("offset"), F.least("e", "e2") - F.col("s2") + F.col("offset")
    return pairs.withColumns({"s": start, "e": end}).drop("s2", "e2", "offset")


def to_source(cues: DataFrame, kept: DataFrame, keys: Sequence[str], width: int, eps: int = EPSILON_MS) -> DataFrame:
    """Cues of the output clock moved back to the source clock, one piece for each kept range they touch."""
    placed = kept.withColumns({"_from": F.col("s"), "s": F.col("offset"), "e": F.col("offset") + F.col("e") - F.col("s")}).drop("offset")
    pairs = overlap_join(cues, placed, keys, width, eps)
    back = lambda x: x - F.col("s2") + F.col("_from")
    return pairs.withColumns({"s": back(F.greatest("s", "s2")), "e": back(F.least("e", "e2"))}).drop("s2", "e2", "_from")


def gap_sessions(df: DataFrame, keys: Sequence[str], gap: int) -> DataFrame:
    """The rows with ``session``: a row begins a new one where it starts more than ``gap`` after all before it have ended."""
    order = Window.partitionBy(*keys).orderBy("s", "e")
    before = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("_new", F.when(before.isNull() | (F.col("s") > before + gap), 1).otherwise(0)).withColumn("session", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
