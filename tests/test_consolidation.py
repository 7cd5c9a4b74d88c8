"""Span closure and lineage, against a sequential fold."""

import random

import pytest

from spanloom.operators import consolidation, graph

EVENT = "rec long, id long, s long, e long, start_id long, end_id long, score long, unfinished boolean"
SAID = "rec long, id long, row long, quote string, role string"
ROWS = "rec long, id long, s long, e long"


def half(lo, hi, a, b, shorter):
    return shorter > 0 and 2 * max(0, min(hi, b) - max(lo, a)) >= shorter


def grow(group):
    """The loop over events by length and score, each measured against the span as it is then."""
    order = sorted(group, key=lambda x: (x[3] - x[2], x[6] or 0, -x[1]), reverse=True)
    first, (s, e, i, j) = order[0], order[0][2:6]
    widest = max(x[5] - x[4] for x in order) > first[5] - first[4]
    while True:
        was = s, e, i, j
        for x in order[1:]:
            # Only where an event has more rows than the chosen one does it matter which rows count as the shorter's.
            fewer = min(x[5] - x[4], first[5] - first[4] if widest else j - i) + 1
            if half(s, e, x[2], x[3], min(x[3] - x[2], e - s)) or half(i, j + 1, x[4], x[5] + 1, fewer):
                s, e, i, j = min(s, x[2]), max(e, x[3]), min(i, x[4]), max(j, x[5])
        if (s, e, i, j) == was:
            return first[1], s, e, i, j


def recordings(rnd, n):
    rows, events = [], []
    for rec in range(n):
        at, own = 0, []
        for i in range(rnd.randrange(6, 40)):
            at += rnd.choice((0, 5, 50))
            own.append((rec, i, at, at := at + rnd.choice((10, 20, 200, 500))))
        rows += own
        for k in range(rnd.randrange(1, 14)):
            i = rnd.randrange(len(own))
            j = min(len(own) - 1, i + rnd.randrange(9))
            events.append((rec, k, own[i][2], own[j][3], i, j, rnd.choice((80, 90, None)), rnd.random() < 0.2))
    return rows, events


@pytest.mark.parametrize("width", [7, 300, 100_000])
def test_spans_by_fold(spark, width):
    rows, events = recordings(random.Random(width), 60)
    groups = {}
    for x in events:
        groups.setdefault((x[0], x[1] % 2), []).append(x)
    grouped = spark.createDataFrame([(*x, x[1] % 2) for x in events], EVENT + ", component long")
    found = consolidation.close_spans(grouped, spark.createDataFrame(rows, ROWS), width).collect()
    assert {(r["rec"], r["component"]): (r["chosen"], r["s"], r["e"], r["start_id"], r["end_id"]) for r in found} == {k: grow(g) for k, g in groups.items()}
    for r in found:
        assert r["members"] == len(groups[r["rec"], r["component"]]) and r["absorbed"] < r["members"]
    assert any(0 < r["absorbed"] < r["members"] - 1 for r in found)


def test_a_long_chain_is_one_pass(spark):
    """Each event reaches only the next; a thousand links end as one span, and a gap ends the reach for all after it."""
    rows = [(1, i, 10 * i, 10 * i + 10) for i in range(3100)]
    chain = [(1, k, 30 * k, 30 * k + 60, 3 * k, 3 * k + 5, 80, False) for k in range(1000) if k != 700]
    chain[0] = (1, 0, 0, 70, 0, 6, 80, False)
    grouped = spark.createDataFrame([(*x, 0) for x in chain], EVENT + ", component long")
    (r,) = consolidation.close_spans(grouped, spark.createDataFrame(rows, ROWS), 500).collect()
    assert (r["chosen"], r["s"], r["e"], r["end_id"]) == (0, 0, 30 * 699 + 60, 3 * 699 + 5) and r["absorbed"] == 699


def test_components_of_chains_and_loose_ends(spark):
    edges = [(1, i, i + 1) for i in range(0, 60)] + [(1, 5, 5), (2, 9, 3), (2, 9, 3), (2, 3, 77), (3, 1, None)]
    nodes = [(1, i) for i in range(62)] + [(2, 3), (2, 9), (2, 9), (3, 1)]
    found = graph.components(spark.createDataFrame(nodes, "rec long, id long"), spark.createDataFrame(edges, "rec long, a long, b long")).collect()
    assert {(r["rec"], r["id"]): r["component"] for r in found} == {**{(1, i): 0 for i in range(61)}, (1, 61): 61, (2, 3): 3, (2, 9): 3, (3, 1): 1}
    assert len(found) == 65


def test_refusal_evidence_and_singles(spark):
    rows = spark.createDataFrame([(rec, i, 10 * i, 10 * i + 10) for rec in (1, 2) for i in range(20)], ROWS)
    events = [(1, 1, 0, 60, 0, 5, 80, False), (1, 2, 20, 60, 2, 5, 95, True), (1, 3, 150, 160, 15, 15, None, None), (2, 1, 0, 60, 0, 5, 80, False), (2, 2, 20, 60, 2, 5, 95, True)]
    said = [(1, 1, 2, "q", "setup"), (1, 2, 2, "q", "setup"), (1, 2, 5, "z", "payoff"), (1, 1, 19, "far", "payoff"), (1, 3, 19, "own", None), (2, 1, 19, "far", "payoff"), (2, 2, 3, None, None)]
    found = consolidation.merge_windows(spark.createDataFrame(events, EVENT), spark.createDataFrame([(1, 1, 2), (2, 1, 2)], "rec long, a long, b long"), spark.createDataFrame(said, SAID), rows, 50)
    assert sorted(tuple(r) for r in found.survivors.select("rec", "id", "score", "unfinished", "method").collect() if r["rec"] == 1) == [(1, 1, 95, True, "overlapping"), (1, 3, None, None, None)]
    assert sorted((r["id"], r["method"]) for r in found.survivors.collect() if r["rec"] == 2) == [(1, "refused"), (2, "refused")]
    assert sorted(map(str, map(tuple, found.evidence.collect()))) == sorted(map(str, [(1, 1, 2, "q", "setup"), (1, 1, 5, "z", "payoff"), (1, 3, 19, "own", None), (2, 1, 19, "far", "payoff"), (2, 2, 3, None, None)]))
    assert sorted((r["rec"], r["id"], r["into"]) for r in found.lineage.collect()) == [(1, 1, 1), (1, 2, 1), (1, 3, 3), (2, 1, 1), (2, 2, 2)]


def test_lineage_of_many_rounds(spark):
    """Every original is accounted for once, survivors share no rows, and their members are those whose spans they hold."""
    rows, events = recordings(random.Random(3), 40)
    rnd = random.Random(4)
    said = [(rec, k, i, "q", rnd.choice(("payoff", "setup", "setup"))) for rec, k, _, _, i, *_ in events]
    found = consolidation.consolidate(spark.createDataFrame(events, EVENT), spark.createDataFrame(said, SAID), spark.createDataFrame(rows, ROWS), 300)
    left, lineage = found.survivors.collect(), found.lineage.collect()
    assert sorted((r["rec"], r["id"]) for r in lineage) == sorted(x[:2] for x in events)
    assert {(r["rec"], r["into"]) for r in lineage if r["into"] is not None} == {(r["rec"], r["id"]) for r in left} and len(left) == len({(r["rec"], r["id"]) for r in left})
    assert all((r["into"] is None) == (r["reason"] is not None) for r in lineage)
    assert any(r["into"] is None for r in lineage) and len(left) < len(events)
    for rec in {r["rec"] for r in left}:
        own = sorted((r["start_id"], r["end_id"]) for r in left if r["rec"] == rec)
        assert all(a[1] < b[0] for a, b in zip(own, own[1:]))


def test_rounds_compose_and_must_shrink(spark):
    first = spark.createDataFrame([(1, 1, 1, None), (1, 2, 1, None), (1, 3, 3, None), (1, 4, None, "early")], "rec long, id long, into long, reason string")
    second = spark.createDataFrame([(1, 1, 3, None), (1, 3, 3, None)], first.schema)
    third = spark.createDataFrame([(1, 3, None, "late")], first.schema)
    two = consolidation.compose(first, second)
    assert sorted((r["id"], r["into"], r["reason"]) for r in two.where("into IS NOT NULL").collect()) == [(1, 3, None), (2, 3, None), (3, 3, None)]
    assert sorted((r["id"], r["reason"]) for r in consolidation.compose(two, third).collect()) == [(1, "late"), (2, "late"), (3, "late"), (4, "early")]
    rows = spark.createDataFrame([(1, i, 10 * i, 10 * i + 10) for i in range(9)], ROWS)
    events = spark.createDataFrame([(1, 1, 0, 50, 0, 4, 80, False), (1, 2, 40, 90, 4, 8, 80, False)], EVENT)
    with pytest.raises(ValueError, match="fewer"):
        consolidation.consolidate(events, spark.createDataFrame([], SAID), rows, 50, decide=lambda runs, _: runs.selectExpr("rec", "id", "id AS into", "CAST(NULL AS string) AS reason"))


def test_of_nothing(spark):
    none = spark.createDataFrame([], EVENT)
    found = consolidation.consolidate(none, spark.createDataFrame([], SAID), spark.createDataFrame([], ROWS), 50)
    assert found.survivors.isEmpty() and found.lineage.isEmpty() and found.evidence.isEmpty()
