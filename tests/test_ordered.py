"""Ordered passes make no frame for each recording."""

from spanloom.operators import sequential


def test_captions_of_many_recordings(spark):
    words = [(rec, i, i * 300, i * 300 + 250, "word" * (i % 3 + 1)) for rec in range(300) for i in range(12)]
    found = sequential.cue_groups(spark.createDataFrame(words, "rec long, id long, s long, e long, text string"))
    assert "Pandas" not in found._jdf.queryExecution().optimizedPlan().toString()
    rows = [tuple(r) for r in found.orderBy("rec", "cue").collect()]
    own = [w for w in words if w[0] == 0]
    cues = sequential.cue_numbers([len(w[4]) for w in own], [w[2] for w in own], [w[3] for w in own])
    held = {c: [w for w, k in zip(own, cues, strict=True) if k == c] for c in cues}
    want = [(c, x[0][2], x[-1][3], " ".join(w[4] for w in x)) for c, x in held.items()]
    assert rows == [(rec, *x) for rec in range(300) for x in want]


def test_matches_of_many_recordings(spark):
    pairs = [(rec, r, c, g) for rec in range(300) for r, c, g in [(0.9, 1, 1), (0.9, 2, 1), (0.8, 1, 2), (0.4, 3, 3), (float("nan"), 4, 4)]]
    found = sequential.greedy_match(spark.createDataFrame(pairs, "rec long, ratio double, cut long, gold long"))
    assert "Pandas" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, found.collect())) == sorted((rec, c, g) for rec in range(300) for c, g in [(2, 1), (1, 2)])
