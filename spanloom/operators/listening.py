"""Proposed cuts against ranges that listeners marked: matched one to one, and counted per sample, category and in all."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import intervals as iv
from .graph import settled

#: The share of a marked range that a cut must cover, and the error of both edges up to which a match is close.
HIT_SHARE, CLOSE_MS = 0.5, 150
COUNTS = ("deletable", "proposals", "hits", "missed", "false_cuts", "protected_overlap_cuts", "matches_within_150ms")


def greedy_pairs(pairs: DataFrame) -> DataFrame:
    """Those of pairs (rec, cut, gold, ratio and any others; each pair once) that a pass from the highest ratio down would match one to one.

    Ties go to the larger cut, then the larger gold. A pair that is the best left of its cut and of its gold is matched by
    any such pass, whatever happens elsewhere; so each round matches all of these and drops what they touch. The
    rounds are those of the longest run of pairs, each better than the one before, not the number of pairs; no recording has to fit in one task.
    """
    rank = F.struct("ratio", "cut", "gold")
    rest, done = settled(pairs), [pairs.limit(0)]
    while not rest.isEmpty():
        by_cut = rest.groupBy("rec", "cut").agg(F.max(rank).alias("top_cut"))
        by_gold = rest.groupBy("rec", "gold").agg(F.max(rank).alias("top_gold"))
        best = rest.join(by_cut, ["rec", "cut"]).join(by_gold, ["rec", "gold"]).where((F.col("top_cut.gold") == F.col("gold")) & (F.col("top_gold.cut") == F.col("cut")))
        best = settled(best.select(*pairs.columns))
        done.append(best)
        rest = settled(rest.join(best.select("rec", "cut"), ["rec", "cut"], "left_anti").join(best.select("rec", "gold"), ["rec", "gold"], "left_anti"))
    return reduce(DataFrame.unionByName, done)


def matches(golds: DataFrame, cuts: DataFrame, width: int, share: float = HIT_SHARE) -> DataFrame:
    """rec, cut, gold, ratio, start_error, end_error of cuts (rec, id, s, e) matched to golds (rec, id, s, e) of which they cover ``share`` or more."""
    pairs = iv.overlap_join(cuts.select("rec", F.col("id").alias("cut"), "s", "e"), golds.select("rec", F.col("id").alias("gold"), "s", "e"), ["rec"], width)
    ratio = iv.overlap(F.col("s"), F.col("e"), F.col("s2"), F.col("e2")) / (F.col("e2") - F.col("s2"))
    pairs = pairs.withColumn("ratio", ratio).where(F.col("ratio") >= share)
    return greedy_pairs(pairs.select("rec", "cut", "gold", "ratio", F.abs(F.col("s") - F.col("s2")).alias("start_error"), F.abs(F.col("e") - F.col("e2")).alias("end_error")))


def report(samples: DataFrame, proposed: DataFrame, golds: DataFrame, cuts: DataFrame, protected: DataFrame, width: int, share: float = HIT_SHARE) -> DataFrame:
    """level (sample, category, total), rec, category, status, COUNTS, hit_rate, median_error, p95_error, max_error (milliseconds).

    samples (rec, category) are those that were listened to, proposed (rec) those with proposals, if only an empty list.
    A sample without is not_measured and counts nowhere; its figures are null. Cuts of samples that nobody listened to don't count. hit_rate is
    null without deletable ranges, errors are null without matches. Without samples the total alone is given, not_measured.
    """
    measured = settled(samples.join(proposed.select("rec").distinct(), "rec", "left_semi"))
    known = lambda df: df.join(measured, "rec")
    found = settled(matches(known(golds), known(cuts), width, share))
    touched = iv.overlap_join(known(cuts).select("rec", "id", "s", "e"), protected.select("rec", "s", "e"), ["rec"], width, iv.EPSILON_MS).select("rec", "id").distinct()
    n = lambda **of: [F.lit(of.get(c, 0)).cast("long").alias(c) for c in ("deletable", "proposals", "hits", "protected_overlap_cuts", "matches_within_150ms")]
    none = F.lit(None).cast("long").alias("error")
    close = F.when(F.greatest("start_error", "end_error") <= CLOSE_MS, 1).otherwise(0)
    facts = [
        measured.select("rec", *n(), none),
        known(golds).select("rec", *n(deletable=1), none),
        known(cuts).select("rec", *n(proposals=1), none),
        touched.select("rec", *n(protected_overlap_cuts=1), none),
        found.select("rec", *n(hits=1)[:4], close.cast("long").alias("matches_within_150ms"), F.col("start_error").alias("error")),
        found.select("rec", *n(), F.col("end_error").alias("error")),
    ]
    facts = reduce(DataFrame.unionByName, facts).join(measured, "rec")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    sums = [total(c) for c in ("deletable", "proposals", "hits", "protected_overlap_cuts", "matches_within_150ms")]
    errors = [F.median("error").alias("median_error"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY error)").cast("double").alias("p95_error"), F.max("error").alias("max_error")]
    figures = lambda by: facts.groupBy(*by).agg(*sums, *errors, F.count(F.lit(1)).alias("facts"))
    levels = {"sample": ("rec", "category"), "category": ("category",), "total": ()}
    absent = lambda by: [F.lit(None).cast(dict(samples.dtypes)[c]).alias(c) for c in ("rec", "category") if c not in by]
    every = reduce(DataFrame.unionByName, [figures(by).select("*", F.lit(level).alias("level"), *absent(by)) for level, by in levels.items()])
    status = F.when(F.col("facts") > 0, "measured").otherwise("not_measured").alias("status")
    rate = (F.col("hits") / F.nullif(F.col("deletable"), F.lit(0))).alias("hit_rate")
    every = every.withColumns({"missed": F.col("deletable") - F.col("hits"), "false_cuts": F.col("proposals") - F.col("hits")})
    every = every.select("level", "rec", "category", status, *COUNTS, rate, "median_error", "p95_error", "max_error")
    unmeasured = samples.join(proposed.select("rec").distinct(), "rec", "left_anti").select(F.lit("sample").alias("level"), "rec", "category", F.lit("not_measured").alias("status"))
    return every.unionByName(unmeasured, allowMissingColumns=True)
