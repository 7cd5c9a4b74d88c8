"""The share of matching characters is difflib's, without its work on characters that begin no match."""

import difflib
import random

from spanloom.operators import similar


def test_ratio_is_difflibs():
    rng = random.Random(3)
    for n in (0, 1, 60, 199, 200, 201, 450, 1200):
        for letters in ("ab", "abcdefghijklmnopqrstuvwxyzäöü", "".join(map(chr, range(0x4E00, 0x4F00)))):
            b = "".join(rng.choices(letters, k=n))
            cut = rng.randrange(n + 1)
            for a in ("", b, b[cut:] + b[:cut], b[:cut] + "x" + b[cut:], "".join(rng.choices(letters, k=n // 2 + 3))):
                assert similar.ratio(a, b) == difflib.SequenceMatcher(None, a, b).ratio(), (n, letters[0])


def test_references_are_judged_in_one_pass(spark):
    """Character counts of both texts of every pair were made in the JVM, each character by each distinct one."""
    rows = spark.createDataFrame([(1, 0, "a telling of the story at some length"), (1, 1, "a telling of the story at same length"), (1, 2, "0123456789"), (1, 3, None)], "rec long, id long, plain string")
    asked = rows.selectExpr("rec", "id", "plain AS quote", "array(id) AS own", "CASE id WHEN 0 THEN array(0L, 1L) WHEN 1 THEN array(2L) WHEN 2 THEN array(9L) ELSE array(0L) END AS reference_ids")
    found = similar.repeat_references(asked, rows)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "map_from_entries" not in plan and plan.count("alike") > 0
    assert {r["id"]: r["violation"] for r in found.collect()} == {0: None, 1: "no_other_telling", 2: "unknown_reference", 3: "no_other_telling"}
