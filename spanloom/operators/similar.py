"""Pairs of texts that tell the same: bounds first, in the JVM, the exact comparison only for what is left.

The characters that two texts match in order are at most those they have in common in any order, so that twice
their number over both lengths bounds the similarity. Lengths alone give a weaker bound that needs no counts.
"""

from __future__ import annotations

import difflib
from bisect import bisect_left
from collections import Counter
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType

from ..functions.text import MIN_COMPARED, REPEAT_SIMILARITY, STORY_SIMILARITY
from . import intervals as iv
from .rules import NEAR_MS, NEAR_PERCENT, same_story


def ratio(a: str, b: str) -> float:
    """``difflib.SequenceMatcher(None, a, b).ratio()``.

    From 200 characters of b on, difflib begins no match at a character that makes up more than a hundredth of b.
    Hardly any places of a are left then, so only those are looked at here.
    """
    if len(b) < 200:
        return difflib.SequenceMatcher(None, a, b).ratio()
    often = len(b) // 100 + 1
    rare = {c for c, n in Counter(b).items() if n <= often}
    places: dict[str, list[int]] = {c: [] for c in rare}
    for j, c in enumerate(b):
        if c in rare:
            places[c].append(j)
    seeds = [i for i, c in enumerate(a) if c in rare]
    total, todo = 0, [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        at, to, size, before, last = a0, b0, 0, {}, -2
        for i in seeds[bisect_left(seeds, a0) : bisect_left(seeds, a1)]:
            here = {}
            for j in places[a[i]]:
                if b0 <= j < b1:
                    here[j] = k = before.get(j - 1, 0) + 1 if i == last + 1 else 1
                    if k > size:
                        at, to, size = i - k + 1, j - k + 1, k
            before, last = here, i
        while at > a0 and to > b0 and a[at - 1] == b[to - 1]:
            at, to, size = at - 1, to - 1, size + 1
        while at + size < a1 and to + size < b1 and a[at + size] == b[to + size]:
            size += 1
        if size:
            total += size
            todo += [x for x in ((a0, at, b0, to), (at + size, a1, to + size, b1)) if x[0] < x[1] and x[2] < x[3]]
    return 2.0 * total / (len(a) + len(b))


@F.pandas_udf(DoubleType())
def matched_share(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the characters matched in order over both lengths; two empty texts are alike."""
    return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def alike(least: float):
    """A function of columns a, b: whether their matched share is ``least`` or more, by their common characters first; a null is like nothing."""

    @F.pandas_udf(BooleanType())
    def judged(a: pd.Series, b: pd.Series) -> pd.Series:
        counts = lru_cache(64)(Counter)  # a text is compared with a few others in turn
        near = lambda x, y: x is not None and y is not None and 2 * (counts(x) & counts(y)).total() >= least * (len(x) + len(y)) and ratio(x, y) >= least
        return pd.Series([near(x, y) for x, y in zip(a, b, strict=True)], dtype="bool")

    return judged


def char_counts(text: Column) -> Column:
    """A map from each character of a text to its number; null for null."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.map_from_entries(F.transform(F.array_distinct(chars), lambda c: F.struct(c, F.size(F.filter(chars, lambda x: x == c)))))


def with_counts(rows: DataFrame, text: str, counts: str) -> DataFrame:
    """``rows`` with the counts of a text's characters, made once a row and not once a pair."""
    return rows.withColumn(counts, char_counts(F.col(text)))


def possible(a: Column, b: Column, a_counts: Column, b_counts: Column, least: float) -> Column:
    """Whether lengths and common characters leave room for a similarity of ``least``."""
    both = F.length(a) + F.length(b)
    shared = F.aggregate(F.map_keys(a_counts), F.lit(0), lambda n, k: n + F.least(F.try_element_at(a_counts, k), F.coalesce(F.try_element_at(b_counts, k), F.lit(0))))
    return (2 * F.least(F.length(a), F.length(b)) >= least * both) & (2 * shared >= least * both)


def similar_pairs(pairs: DataFrame, least: float) -> DataFrame:
    """``pairs`` (a, b and their counts a_counts, b_counts) with ``ratio``, where it is ``least`` or more; null texts are like nothing."""
    return pairs.where(possible(F.col("a"), F.col("b"), F.col("a_counts"), F.col("b_counts"), least)).withColumn("ratio", matched_share("a", "b")).where(F.col("ratio") >= least)


def near_retellings(events: DataFrame, width: int, least: float = STORY_SIMILARITY) -> DataFrame:
    """rec, a, b (a < b), ratio of events (rec, id, s, e, told) that are near in time and tell almost the same.

    Near: they overlap, or the gap is at most NEAR_MS or NEAR_PERCENT of the shorter. told is a text of letters and
    digits; under MIN_COMPARED characters it is like nothing, and a text that holds the other is like it. Events that
    repeat give a pair each; null or empty texts give none.
    """
    events = with_counts(events.where(F.length("told") >= MIN_COMPARED), "told", "counts")
    slack = F.greatest(F.lit(NEAR_MS), F.ceil((F.col("e") - F.col("s")) * NEAR_PERCENT / 100)).cast("long")
    left = events.select("rec", "id", F.col("s").alias("own_s"), F.col("e").alias("own_e"), (F.col("s") - slack - 1).alias("s"), (F.col("e") + slack + 1).alias("e"), "told", "counts")
    right = events.select("rec", F.col("id").alias("other"), "s", "e", F.col("told").alias("other_told"), F.col("counts").alias("other_counts"))
    pairs = iv.overlap_join(left, right, ["rec"], width, -1).where("id < other")
    gap = F.greatest("own_s", "s2") - F.least("own_e", "e2")
    shorter = F.greatest(F.least(F.col("own_e") - F.col("own_s"), F.col("e2") - F.col("s2")), F.lit(0))
    pairs = pairs.where((gap <= 0) | (gap <= NEAR_MS) | (100 * gap <= NEAR_PERCENT * shorter))
    # The shorter text is compared with the longer.
    swap = F.length("told") > F.length("other_told")
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    pairs = pairs.select("rec", F.col("id").alias("left"), "other", pick("told", "other_told").alias("a"), pick("other_told", "told").alias("b"), pick("counts", "other_counts").alias("a_counts"), pick("other_counts", "counts").alias("b_counts"))
    held = pairs.where(F.contains("b", "a")).select("rec", F.col("left").alias("a"), F.col("other").alias("b"), F.lit(1.0).alias("ratio"))
    return held.unionByName(similar_pairs(pairs.where(~F.contains("b", "a")), least).select("rec", F.col("left").alias("a"), F.col("other").alias("b"), "ratio"))


def story_pairs(events: DataFrame, width: int) -> DataFrame:
    """rec, a, b (a < b) of events (rec, id, s, e, start_id, end_id, told) that tell one story.

    They overlap by half of the shorter, in time or in rows, or are near in time and tell almost the same. Each pair once.
    """
    near = near_retellings(events.select("rec", "id", "s", "e", "told"), width).select("rec", "a", "b")
    return same_story(events.select("rec", "id", "s", "e", "start_id", "end_id"), width).unionByName(near).distinct()


def repeat_references(decisions: DataFrame, rows: DataFrame, least: float = REPEAT_SIMILARITY) -> DataFrame:
    """rec, id, violation of decisions (rec, id, quote, own, reference_ids) to cut a telling because another says the same.

    unknown_reference: an id that no row of the recording has. no_other_telling: no reference but the proposal's own rows
    (``own``) tells nearly the quote. Null where a decision holds; without references none does. quote and the rows' plain
    are in normal form.
    """
    asked = decisions.select("rec", "id", "quote", "own", F.explode_outer("reference_ids").alias("reference"))
    known = rows.select("rec", F.col("id").alias("reference"), F.col("plain").alias("b"), F.lit(True).alias("known"))
    met = asked.join(known, ["rec", "reference"], "left")
    both = F.length("quote") + F.length("b")
    other = F.col("known") & ~F.array_contains("own", F.col("reference")) & (2 * F.least(F.length("quote"), F.length("b")) >= least * both)
    pair = lambda c: F.when(other, F.col(c))
    met = met.select("rec", "id", (F.col("reference").isNotNull() & F.col("known").isNull()).alias("unknown"), pair("quote").alias("a"), pair("b").alias("b"))
    told = met.select("rec", "id", "unknown", alike(least)("a", "b").alias("alike"))
    rule = F.when(F.bool_or("unknown"), "unknown_reference").when(~F.bool_or("alike"), "no_other_telling")
    return told.groupBy("rec", "id").agg(rule.alias("violation"))
