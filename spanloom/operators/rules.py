"""Validators, candidate generators, the edit ledger and the metrics: relations over rows, words and intervals."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import intervals as iv

#: Gap padding and shortest gap by strength, in milliseconds; a gap keeps half a second at least.
GAP_PADDING = {"light": 800, "standard": 500, "tight": 300}
GAP_MINIMUM = {"light": 3500, "standard": 2000, "tight": 1500}
GAP_LEFT = 500
#: What a candidate's edges are moved by, and the lengths of its texts.
LEAD_IN_MS, TAIL_MS = 150, 200
TITLE, REASON, CATEGORY, EXCERPT = 80, 500, 20, 1500
#: Overlap of the shorter from which two events tell one story, and when they count as near.
STORY_OVERLAP_PERCENT, NEAR_MS, NEAR_PERCENT = 50, 20_000, 15
#: What a mixed reaction needs to stay, and the share that decides a review in segments.
MIXED_MS, MIXED_PERCENT, SEGMENT_MS, DECISIVE_PERCENT = 10_000, 20, 240_000, 75


#: Quotes that are compared with all rows at once.
QUOTE_BLOCK = 10_000


# ---- validators ----


def validate_candidates(proposals: DataFrame, rows: DataFrame, low_ms: int, high_ms: int) -> DataFrame:
    """Proposals (rec, start_id, end_id, score) whose ids exist, in order, and whose length fits; padded and clamped.

    A missing score is 60; scores are clamped to 0..100. Others drop out, none raises.
    """
    first = rows.select("rec", F.col("id").alias("start_id"), F.col("s").alias("s"))
    last = rows.select("rec", F.col("id").alias("end_id"), F.col("e").alias("e"))
    bounds = rows.groupBy("rec").agg(F.min("s").alias("lo"), F.max("e").alias("hi"))
    found = proposals.where("start_id <= end_id").join(first, ["rec", "start_id"]).join(last, ["rec", "end_id"]).join(bounds, "rec")
    found = found.where((F.col("e") - F.col("s")).between(low_ms, high_ms))
    score = F.least(F.greatest(F.coalesce("score", F.lit(60.0)), F.lit(0.0)), F.lit(100.0))
    return found.select("rec", "start_id", "end_id", F.greatest(F.col("s") - LEAD_IN_MS, "lo").alias("s"), F.least(F.col("e") + TAIL_MS, "hi").alias("e"), score.alias("score"))


def excerpts(candidates: DataFrame, rows: DataFrame, limit: int = EXCERPT) -> DataFrame:
    """The text of each candidate's rows in order, cut at ``limit``; ids are made explicit, so that the join is by equality."""
    ids = candidates.select("rec", "start_id", "end_id", F.explode(F.sequence("start_id", "end_id")).alias("id"))
    told = ids.join(rows.select("rec", "id", "text"), ["rec", "id"]).groupBy("rec", "start_id", "end_id").agg(F.sort_array(F.collect_list(F.struct("id", "text"))).alias("told"))
    return told.select("rec", "start_id", "end_id", F.substring(F.array_join(F.col("told.text"), ""), 1, limit).alias("excerpt"))


def partition_violations(wanted: DataFrame, given: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that are missing, unknown or given more than once, with the rule they break."""
    a = wanted.select(*keys).distinct().withColumn("_w", F.lit(1))
    b = given.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    rule = F.when(F.col("_n").isNull(), "missing").when(F.col("_w").isNull(), "unknown").when(F.col("_n") > 1, "repeated")
    return a.join(b, list(keys), "full_outer").select(*keys, rule.alias("rule")).where("rule IS NOT NULL")


def quote_violations(quotes: DataFrame, rows: DataFrame) -> DataFrame:
    """Quotes (quote_id, id, quote) whose row is unknown or does not hold them word for word."""
    found = quotes.join(rows.select("id", "text"), "id", "left")
    rule = F.when(F.col("text").isNull(), "unknown_row").when(~F.contains("text", "quote"), "not_in_row")
    return found.select("quote_id", "id", rule.alias("rule")).where("rule IS NOT NULL")


def holding_rows(quotes: DataFrame, rows: DataFrame) -> DataFrame:
    """Each row (text) with each quote that it holds. The quotes are a stated set: a block of them at a time goes to all rows."""
    blocks = -(-quotes.count() // QUOTE_BLOCK)
    parts = [quotes] if blocks < 2 else [quotes.where(F.pmod(F.xxhash64("quote"), F.lit(blocks)) == i) for i in range(blocks)]
    hits = [rows.join(F.broadcast(part), F.contains("text", "quote")) for part in parts]
    return reduce(DataFrame.unionByName, hits)


def rebind_quotes(quotes: DataFrame, rows: DataFrame) -> DataFrame:
    """quote_id, id where exactly one row holds the quote."""
    hits = holding_rows(quotes.select("quote_id", "quote"), rows.select("id", "text"))
    return hits.groupBy("quote_id").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).where("n = 1").select("quote_id", "id")


# ---- candidates ----


def gap_candidates(rows: DataFrame, strength: str = "standard") -> DataFrame:
    """rec, id, s, e of pauses after a row, padded on both sides; short ones and short rests drop out."""
    after = F.lead("s").over(Window.partitionBy("rec").orderBy("s", "e", "id"))
    ended = F.max("e").over(Window.partitionBy("rec").orderBy("s", "e", "id").rowsBetween(Window.unboundedPreceding, 0))
    pad = GAP_PADDING[strength]
    gaps = rows.select("rec", "id", ended.alias("lo"), after.alias("hi")).where(F.col("hi") - F.col("lo") >= GAP_MINIMUM[strength])
    return gaps.select("rec", "id", (F.col("lo") + pad).alias("s"), (F.col("hi") - pad).alias("e")).where(F.col("e") - F.col("s") >= GAP_LEFT)


def tandem_repeats(words: DataFrame, widest: int = 4) -> DataFrame:
    """rec, id, width: from each word the widest block of words that the next block repeats."""
    order = Window.partitionBy("rec").orderBy("id")
    ahead = words.select("rec", "id", F.array(*[F.lead("word", k).over(order) for k in range(2 * widest)]).alias("ahead"))
    same = lambda w: F.reduce(F.sequence(F.lit(0), F.lit(w - 1)), F.lit(True), lambda ok, i: ok & F.coalesce(F.get("ahead", i) == F.get("ahead", i + w), F.lit(False)))
    width = F.coalesce(*[F.when(same(w), w) for w in range(widest, 0, -1)])
    return ahead.select("rec", "id", width.alias("width")).where("width IS NOT NULL")


def lexical_neighbors(rows: DataFrame, near: Column, radius: int = 5, best: int = 3) -> DataFrame:
    """rec, id, other, similarity of rows at most ``radius`` places apart: the ``best`` of each. near is a function's column of a and b."""
    order = Window.partitionBy("rec").orderBy("id")
    placed = rows.select("rec", "id", "text", F.row_number().over(order).alias("at"))
    other = placed.select("rec", F.col("id").alias("other"), F.col("text").alias("b"), F.explode(F.array(*[F.col("at") + k for k in range(-radius, radius + 1) if k])).alias("at"))
    pairs = placed.withColumnRenamed("text", "a").join(other, ["rec", "at"]).withColumn("similarity", near)
    rank = F.row_number().over(Window.partitionBy("rec", "id").orderBy(F.desc("similarity"), "other"))
    return pairs.where("similarity >= 0.45").withColumn("rank", rank).where(F.col("rank") <= best).select("rec", "id", "other", "similarity", "rank")


# ---- one story ----


def same_story(events: DataFrame, width: int) -> DataFrame:
    """rec, a, b (a < b) of events that overlap by half of the shorter, in time or in rows."""
    pairs = iv.overlap_join(events, events.select("rec", F.col("id").alias("b"), "s", "e", F.col("start_id").alias("b0"), F.col("end_id").alias("b1")), ["rec"], width).where("id < b")
    shorter = F.least(F.col("e") - F.col("s"), F.col("e2") - F.col("s2"))
    rows = F.greatest(F.lit(0), F.least("end_id", "b1") - F.greatest("start_id", "b0") + 1)
    fewer = F.least(F.col("end_id") - F.col("start_id"), F.col("b1") - F.col("b0")) + 1
    same = (100 * iv.overlap(F.col("s"), F.col("e"), F.col("s2"), F.col("e2")) >= STORY_OVERLAP_PERCENT * shorter) | (100 * rows >= STORY_OVERLAP_PERCENT * fewer)
    return pairs.where(same).select("rec", F.col("id").alias("a"), "b")


# ---- ledger ----


def ledger_refresh(candidates: DataFrame, clips: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: applied, blocked and suggested counts, and source, removed and output length of the clip."""
    applied = iv.union(candidates.where("status = 'applied'"), keys, iv.EPSILON_MS, iv.EPSILON_MS)
    inside = applied.join(clips, list(keys)).select(*keys, iv.overlap(F.col("s"), F.col("e"), F.col("lo"), F.col("hi")).alias("cut")).where("cut > 0")
    removed = inside.groupBy(*keys).agg(F.sum("cut").alias("removed"))
    count = candidates.groupBy(*keys).agg(*[F.count_if(F.col("status") == x).alias(x) for x in ("applied", "blocked", "suggested")])
    out = clips.join(count, list(keys), "left").join(removed, list(keys), "left")
    source, cut = F.col("hi") - F.col("lo"), F.coalesce("removed", F.lit(0))
    return out.select(*keys, *[F.coalesce(x, F.lit(0)).alias(x) for x in ("applied", "blocked", "suggested")], source.alias("source"), cut.alias("removed"), (source - cut).alias("output"))


def ledger_restore(kept: DataFrame, restored: DataFrame, still: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """The kept ranges after a candidate is restored: its range without what other applied candidates cut, joined to the kept ones."""
    back = iv.subtract(restored, still, keys, width).select(*keys, "s", "e")
    return iv.union(kept.select(*keys, "s", "e").unionByName(back), keys, iv.EPSILON_MS, iv.EPSILON_MS)


def overlap_fixpoint(cuts: DataFrame, keep: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The cuts with ``status``: one that overlaps a kept row is blocked, and what it would have removed is kept too, until nothing changes.

    A component of overlapping cuts falls as a whole once one of them touches a kept row; so islands of
    cuts that overlap by more than the tolerance decide it in one pass.
    """
    marked = cuts.select(*keys, "id", "s", "e", F.lit(0).alias("kept")).unionByName(keep.select(*keys, F.lit(None).cast("long").alias("id"), "s", "e", F.lit(1).alias("kept")))
    island = iv.gap_sessions(marked, keys, -iv.EPSILON_MS - 1)
    hit = island.groupBy(*keys, "session").agg(F.max("kept").alias("hit"))
    return island.where("id IS NOT NULL").join(hit, [*keys, "session"]).select(*keys, "id", F.when(F.col("hit") == 1, "blocked").otherwise("applied").alias("status"))


def block_reasons(candidates: DataFrame) -> DataFrame:
    """reason, n of the blocked: the first of block_reason, reason and a default that is not blank."""
    first = F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in ("block_reason", "reason")], F.lit("unspecified"))
    return candidates.where("status = 'blocked'").groupBy(first.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


# ---- review ----


def quoted_share(quotes: DataFrame) -> DataFrame:
    """clip, quoted_ms, clip_ms: each quote counts its part of the row's length that lies in the clip."""
    inside = F.greatest(iv.overlap(F.col("s"), F.col("e"), F.col("lo"), F.col("hi")), F.lit(0))
    part = F.floor(inside * F.length("quote") / F.greatest(F.length("text"), F.lit(1))).cast("long")
    return quotes.groupBy("clip").agg(F.sum(part).alias("quoted_ms"), F.max(F.col("hi") - F.col("lo")).alias("clip_ms"))


def mixed_gate(shares: DataFrame) -> DataFrame:
    """Keep a mixed reaction of ten seconds and a fifth of the clip at least."""
    keep = (F.col("quoted_ms") >= MIXED_MS) & (100 * F.col("quoted_ms") >= MIXED_PERCENT * F.col("clip_ms"))
    return shares.withColumn("decision", F.when(keep, "keep").otherwise("exclude"))


def segmented_gate(parts: DataFrame) -> DataFrame:
    """clip, decision of parts (clip, ms, decision): three quarters decide, a part on hold never lets the clip be kept."""
    share = lambda x: F.sum(F.when(F.col("decision") == x, F.col("ms")).otherwise(0))
    sums = parts.groupBy("clip").agg(share("keep").alias("keep_ms"), share("exclude").alias("exclude_ms"), F.sum("ms").alias("ms"), F.bool_or(F.col("decision") == "hold").alias("held"))
    enough = lambda c: 100 * F.col(c) >= DECISIVE_PERCENT * F.col("ms")
    return sums.select("clip", "keep_ms", "exclude_ms", F.when(enough("keep_ms") & ~F.col("held"), "keep").when(enough("exclude_ms"), "exclude").otherwise("hold").alias("decision"))


# ---- metrics ----


def selection_metrics(truth: DataFrame, clips: DataFrame, keys: Sequence[str], width: int, percent: int = 50) -> DataFrame:
    """One row: missed truths, clips without a truth, and matches of a truth beyond its first."""
    pairs = iv.iou_join(clips.select(*keys, "s", "e", F.col("id").alias("clip")), truth.select(*keys, "s", "e", F.col("id").alias("truth")), keys, width, percent)
    matched = pairs.groupBy("truth").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("hit"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))
    used = pairs.select("clip").distinct().agg(F.count(F.lit(1)).alias("used"))
    sizes = truth.agg(F.count(F.lit(1)).alias("truths")).crossJoin(clips.agg(F.count(F.lit(1)).alias("clips")))  # one row each
    return sizes.crossJoin(matched).crossJoin(used).select((F.col("truths") - F.col("hit")).alias("missed"), (F.col("clips") - F.col("used")).alias("false_positives"), "duplicates")


def protected_loss(protected: DataFrame, kept: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """Per key of either: protected length that no kept range covers, and kept length that another kept range already has."""
    total = lambda df, name: df.groupBy(*keys).agg(F.sum(F.col("e") - F.col("s")).alias(name))
    safe, once = iv.union(protected, keys), iv.union(kept, keys)
    common = total(iv.intersections(safe, once, keys, width, 0), "common")
    out = total(safe, "safe").join(total(kept, "all"), list(keys), "full_outer").join(total(once, "once"), list(keys), "left").join(common, list(keys), "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select(*keys, (n("safe") - n("common")).alias("lost"), (n("all") - n("once")).alias("doubled"))


def caption_report(wanted: DataFrame, given: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: captions in common, missing and unexpected, and the largest error of a boundary."""
    both = wanted.join(given.withColumnsRenamed({"s": "s2", "e": "e2"}), list(keys), "full_outer")
    error = F.greatest(F.abs(F.col("s") - F.col("s2")), F.abs(F.col("e") - F.col("e2")))
    return both.agg(F.count_if(F.col("s").isNotNull() & F.col("s2").isNotNull()).alias("common"), F.count_if(F.col("s2").isNull()).alias("missing"), F.count_if(F.col("s").isNull()).alias("unexpected"), F.max(error).alias("max_error"))
