"""The listening report, against a loop over all samples in one process."""

import math
import random
import statistics

from spanloom.operators import listening

SPAN = "rec long, id long, s long, e long"
KEYS = ("deletable", "proposals", "hits", "missed", "false_cuts", "protected_overlap_cuts", "matches_within_150ms")


def score(golds, cuts, safe):
    ranking = sorted(((max(0, min(c[3], g[3]) - max(c[2], g[2])) / (g[3] - g[2]), c[1], g[1]) for c in cuts for g in golds), reverse=True)
    left, right = {c[1]: c for c in cuts}, {g[1]: g for g in golds}
    errors, hits, close = [], 0, 0
    for ratio, c, g in ranking:
        if ratio >= 0.5 and c in left and g in right:
            x, y = left.pop(c), right.pop(g)
            two = [abs(x[2] - y[2]), abs(x[3] - y[3])]
            errors, hits, close = errors + two, hits + 1, close + (max(two) <= 150)
    bad = sum(any(min(c[3], p[3]) - max(c[2], p[2]) > 2 for p in safe) for c in cuts)
    return (len(golds), len(cuts), hits, len(golds) - hits, len(cuts) - hits, bad, close), errors


def packed(counts, errors):
    rank = sorted(errors)
    return (*counts, counts[2] / counts[0] if counts[0] else None, *((statistics.median(rank), rank[math.ceil(0.95 * len(rank)) - 1], rank[-1]) if rank else (None,) * 3))


def test_report_by_loop(spark):
    rnd = random.Random(5)
    samples = [(rec, "abc"[rec % 3]) for rec in range(30)] + [(30, "quiet"), (31, "a")]
    proposed = [(rec,) for rec in range(31) if rec % 7] * 2 + [(99,)]

    def some(most):
        # Ids repeat from sample to sample; edges repeat, so that ratios tie.
        return [(rec, i, s, s + 100 * rnd.randrange(1, 9)) for rec in [*range(30), 99] for i in range(rnd.randrange(most)) for s in [100 * rnd.randrange(20)]]

    golds, cuts, safe = some(9), some(12), some(3)
    wanted, totals = {}, {}
    for rec, category in samples:
        if (rec,) not in proposed:
            wanted["sample", rec, category] = ("not_measured",) + (None,) * 11
            continue
        own = [[x for x in rows if x[0] == rec] for rows in (golds, cuts, safe)]
        counts, errors = score(*own)
        wanted["sample", rec, category] = ("measured", *packed(counts, errors))
        for key in (("category", None, category), ("total", None, None)):
            was, seen = totals.get(key, ((0,) * 7, []))
            totals[key] = tuple(map(sum, zip(was, counts))), seen + errors
    wanted.update({k: ("measured", *packed(*v)) for k, v in totals.items()})
    frame = lambda rows: spark.createDataFrame(rows, SPAN)
    found = listening.report(spark.createDataFrame(samples, "rec long, category string"), spark.createDataFrame(proposed, "rec long"), frame(golds), frame(cuts), frame(safe), 500).collect()
    got = {(r["level"], r["rec"], r["category"]): (r["status"], *(r[k] for k in KEYS), r["hit_rate"], r["median_error"], r["p95_error"], r["max_error"]) for r in found}
    assert len(found) == len(got) and got == wanted
    assert got["category", None, "quiet"][1:9] == (0,) * 7 + (None,)


def test_a_hot_cut_and_a_chain(spark):
    """One cut meets thousands of golds and is matched once; in a chain where each pair beats the one before, every other is matched."""
    hot = [(1, 0, g, 0.5 + (g % 97) / 200) for g in range(4000)]
    chain = [(2, (i + 1) // 2, i // 2, 0.5 + i / 1000) for i in range(41)]
    found = listening.greedy_pairs(spark.createDataFrame(hot + chain, "rec long, cut long, gold long, ratio double")).collect()
    assert [(r["cut"], r["gold"]) for r in found if r["rec"] == 1] == [(0, max(g for g in range(4000) if g % 97 == 96))]
    assert sorted(r["gold"] for r in found if r["rec"] == 2) == list(range(21))


def test_report_of_nothing(spark):
    none = spark.createDataFrame([], SPAN)
    (r,) = listening.report(spark.createDataFrame([], "rec long, category string"), none.select("rec"), none, none, none, 500).collect()
    assert (r["level"], r["status"], r["deletable"], r["hit_rate"], r["max_error"]) == ("total", "not_measured", 0, None, None)
