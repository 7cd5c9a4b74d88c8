"""Retellings and repeats against all pairs, compared one by one."""

import difflib
import random

from pyspark.sql import functions as F

from spanloom.operators import similar


def all_pairs(events):
    out = set()
    for i, (rec, a, s, e, x) in enumerate(events):
        for rec2, b, s2, e2, y in events[i + 1 :]:
            gap = max(s, s2) - min(e, e2)
            if rec != rec2 or (gap > 0 and gap > max(20_000, 0.15 * max(0, min(e - s, e2 - s2)))) or min(len(x or ""), len(y or "")) < 8:
                continue
            short, long = sorted((x, y), key=len)
            ratio = 1.0 if short in long else difflib.SequenceMatcher(None, short, long).ratio()
            if ratio >= 0.92:
                out.add((rec, min(a, b), max(a, b), round(ratio, 9)))
    return out


def test_near_retellings_are_those_of_all_pairs(spark):
    rng = random.Random(4)
    stems = ["".join(rng.choice("abcdefgh é日") for _ in range(n)) for n in (7, 8, 30, 60, 150, 260)]
    events = []
    for i in range(160):
        told = rng.choice(stems)
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(told))
            told = told[:at] + rng.choice(["", "z", told[at]]) + told[at + 1 :]
        start = rng.randrange(0, 600_000)
        events.append((i % 2, i, start, start + rng.choice([0, 1000, 30_000, 400_000]), rng.choice([told, told, told, None, ""]) if i % 9 == 0 else told))
    df = spark.createDataFrame(events, "rec long, id long, s long, e long, told string")
    found = {(r["rec"], r["a"], r["b"], round(r["ratio"], 9)) for r in similar.near_retellings(df, 60_000).collect()}
    assert found == all_pairs(events) and len(found) > 50
    assert similar.near_retellings(df.limit(0), 60_000).count() == 0


def test_story_pairs_are_those_of_all_pairs(spark):
    rng = random.Random(6)
    events = []
    for i in range(120):
        start, row = rng.randrange(0, 900_000), rng.randrange(50)
        events.append((i % 3, i, start, start + rng.choice([500, 20_000, 90_000]), rng.choice(["wewenthomeagain", "wewenthomeagainx", "somethingelse", "short", None]), row, row + rng.randrange(4)))
    wanted = {(r, a, b) for r, a, b, _ in all_pairs([x[:5] for x in events])}
    for i, (rec, a, s, e, _, r0, r1) in enumerate(events):
        for rec2, b, s2, e2, _, q0, q1 in events[i + 1 :]:
            both = min(e, e2) - max(s, s2)
            rows = max(0, min(r1, q1) - max(r0, q0) + 1)
            if rec == rec2 and both > 0 and (2 * both >= min(e - s, e2 - s2) or 2 * rows >= min(r1 - r0, q1 - q0) + 1):
                wanted.add((rec, a, b))
    df = spark.createDataFrame(events, "rec long, id long, s long, e long, told string, start_id long, end_id long")
    assert sorted(map(tuple, similar.story_pairs(df, 60_000).select("rec", "a", "b").collect())) == sorted(wanted)


def test_bounds_leave_few_pairs_and_lose_none(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choices("abcdefghijklmnop", weights=range(1, 17), k=rng.randrange(20, 120))) for _ in range(60)]
    texts += [t[:-3] + "xyz" for t in texts[:20]]
    pairs = [(x, y) for i, x in enumerate(texts) for y in texts[i + 1 :]]
    df = spark.createDataFrame(pairs, "a string, b string")
    df = similar.with_counts(similar.with_counts(df, "a", "a_counts"), "b", "b_counts")
    left = {(r["a"], r["b"]) for r in df.where(similar.possible(F.col("a"), F.col("b"), F.col("a_counts"), F.col("b_counts"), 0.92)).collect()}
    alike = {(x, y) for x, y in pairs if difflib.SequenceMatcher(None, x, y).ratio() >= 0.92}
    assert alike <= left and len(left) < len(pairs) / 4 and alike
    assert {(r["a"], r["b"]) for r in similar.similar_pairs(df, 0.92).collect()} == alike


def test_repeat_references(spark):
    rows = spark.createDataFrame([(1, 1, "wewenthome"), (1, 2, "wewenthomenow"), (1, 3, "other"), (2, 1, "wewenthome"), (1, 4, None), (1, 5, "")], "rec long, id long, plain string")
    decisions = [
        (1, 10, "wewenthome", [1], [2]), (1, 11, "wewenthome", [1], [1]), (1, 12, "wewenthome", [1], [3]), (1, 13, "wewenthome", [1], [2, 99]), (1, 14, "wewenthome", [1], []),
        (1, 15, "wewenthome", [1], None), (2, 16, "wewenthome", [1], [2]), (1, 17, "wewenthome", [1], [4, 3, 2]), (1, 18, None, [1], [2]), (1, 19, "", [1], [5]),
    ]
    df = spark.createDataFrame(decisions, "rec long, id long, quote string, own array<long>, reference_ids array<long>")
    found = {r["id"]: r["violation"] for r in similar.repeat_references(df, rows).collect()}
    none, unknown = "no_other_telling", "unknown_reference"
    assert found == {10: None, 11: none, 12: none, 13: unknown, 14: none, 15: none, 16: unknown, 17: None, 18: none, 19: None}
