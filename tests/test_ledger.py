"""The ledger after manual edits, against a sequential fold."""

import random

import pytest

from spanloom.operators import ledger

EPS = 2
ITEM = "rec long, id long, at long, s long, e long, status string, reason string"


def merged(ranges):
    out = []
    for s, e in sorted((s, e) for s, e in ranges if e - s > EPS):
        if out and s <= out[-1][1] + EPS:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def minus(region, covers):
    pieces = [region]
    for s, e in covers:
        pieces = [q for a, b in pieces for q in ([(a, b)] if min(b, e) - max(a, s) <= EPS else [(x, y) for x, y in ((a, s), (e, b)) if y - x > EPS])]
    return pieces


def fold(items, kept, lo, hi, manual):
    cuts, at = [], lo
    for s, e in merged(kept):
        if s - at > EPS:
            cuts.append((at, s))
        at = max(at, e)
    if hi - at > EPS:
        cuts.append((at, hi))
    rows, explained = [], []
    for i, s, e, status, reason in items:
        fits = s is not None and lo - EPS <= s < e <= hi + EPS
        pieces = [(max(s, a), min(e, b)) for a, b in cuts if min(e, b) - max(s, a) > EPS] if fits else []
        if manual and status == "restored" and pieces:
            status, reason = "applied", f"{ledger.MANUAL}; {reason}"
        elif status == "applied" and fits and not pieces:
            status = "restored"
        use = pieces if status == "applied" else []
        explained += use
        rows.append((str(i), s, e, status, reason, sum(b - a for a, b in use), use))
    if manual:
        rows += [(f"manual:{a}:{b}", a, b, "applied", ledger.MANUAL, b - a, [(a, b)]) for c in cuts for a, b in minus(c, explained)]
    regions = []
    for a, b in cuts:
        by = [r for r in rows if any(min(b, y) - max(a, x) > EPS for x, y in r[6])]
        regions.append((a, b, "; ".join(dict.fromkeys(r[4] for r in by)) or ledger.MANUAL, [r[0] for r in by]))
    return sorted(map(str, (r[:6] for r in rows))), regions


@pytest.mark.parametrize("manual", [False, True])
def test_refresh_by_fold(spark, manual):
    rnd = random.Random(8)
    wanted, items, kept, clips = {}, [], [], []
    for rec in range(25):
        lo, hi = 100, 100 + 10 * rnd.randrange(20, 200)
        span = lambda: (lambda a, n: (a, a + n))(10 * rnd.randrange(10, hi // 10), 10 * rnd.randrange(1, 40))  # noqa: B023, E731
        own = [(i, *span(), rnd.choice(("applied", "restored", "blocked")), rnd.choice("abc")) for i in range(rnd.randrange(12))]
        own += [(90, None, None, "applied", "a"), (91, 0, 5_000_000, "applied", "b")]
        ranges = [(a, min(b, hi)) for a, b in (span() for _ in range(rnd.randrange(6))) if a < hi]
        items += [(rec, i, i, *rest) for i, *rest in own]
        kept += [(rec, *r) for r in ranges]
        clips.append((rec, lo, hi))
        wanted[rec] = fold(own, ranges, lo, hi, manual)
    found = ledger.refresh(spark.createDataFrame(items, ITEM), spark.createDataFrame(kept, "rec long, s long, e long"), spark.createDataFrame(clips, "rec long, lo long, hi long"), ["rec"], 500, manual)
    rows, regions = found.items.collect(), found.regions.collect()
    for rec, (some, cuts) in wanted.items():
        assert sorted(str((r["id"], r["s"], r["e"], r["status"], r["reason"], r["effective"])) for r in rows if r["rec"] == rec) == some
        assert sorted((r["s"], r["e"], r["reason"], list(r["ids"])) for r in regions if r["rec"] == rec) == cuts
    for r in found.totals.collect():
        assert r["removed"] + r["output"] == r["source"] and r["removed"] == sum(b - a for a, b, *_ in wanted[r["rec"]][1])
    if manual:
        assert any(r["decision"] == "manual" and r["was"] == "restored" for r in rows) and any(r["was"] is None for r in rows)


def test_refresh_of_nothing(spark):
    none = spark.createDataFrame([], ITEM)
    clips = spark.createDataFrame([(1, 0, 50)], "rec long, lo long, hi long")
    found = ledger.refresh(none, none.select("rec", "s", "e"), clips, ["rec"], 500, True)
    assert [(r["id"], r["effective"]) for r in found.items.collect()] == [("manual:0:50", 50)]
    assert found.totals.first()["output"] == 0
