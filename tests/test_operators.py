"""Small hand-written cases and properties of the operators."""

import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanloom.functions import text as tx
from spanloom.operators import intervals as iv
from spanloom.operators import rules, sequential, storage
from spanloom.sources import timed_text
from spanloom.streaming import state


def spans(df, *more):
    return sorted(tuple(r) for r in df.select(*more, "s", "e").collect())


def frame(spark, rows, schema="rec long, s long, e long"):
    return spark.createDataFrame(rows, schema)


def test_union_complement_and_subtract(spark):
    cuts = frame(spark, [(1, 2000, 4000), (1, 3000, 5000), (1, 8000, 9000)])
    assert spans(iv.union(cuts, ["rec"])) == [(2000, 5000), (8000, 9000)]
    assert spans(iv.union(cuts, ["rec"], slice_ms=1000)) == [(2000, 5000), (8000, 9000)]
    clip = spark.createDataFrame([(1, 0, 12000)], "rec long, lo long, hi long")
    assert spans(iv.complement(cuts, clip, ["rec"])) == [(0, 2000), (5000, 8000), (9000, 12000)]
    region = spark.createDataFrame([(1, 7, 0, 10000)], "rec long, id long, s long, e long")
    assert spans(iv.subtract(region, cuts, ["rec"], 1000)) == [(0, 2000), (5000, 8000), (9000, 10000)]


def test_epsilon_merges_and_drops(spark):
    rows = frame(spark, [(1, 0, 100), (1, 102, 200), (1, 300, 302)])
    assert spans(iv.union(rows, ["rec"], iv.EPSILON_MS, iv.EPSILON_MS)) == [(0, 200)]
    assert spans(iv.union(rows, ["rec"])) == [(0, 100), (102, 200), (300, 302)]


@pytest.mark.parametrize("width", [7, 50, 1000])
def test_overlap_join_is_the_theta_join(spark, width):
    rnd = random.Random(width)
    make = lambda: [(rnd.randrange(3), i, s, s + rnd.randrange(1, 90)) for i, s in enumerate(rnd.randrange(500) for _ in range(80))]
    a, b = make(), make()
    left = spark.createDataFrame(a, "rec long, a long, s long, e long")
    right = spark.createDataFrame(b, "rec long, b long, s long, e long")
    found = sorted((r["a"], r["b"]) for r in iv.overlap_join(left, right, ["rec"], width).collect())
    assert found == sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and min(x[3], y[3]) > max(x[2], y[2]))


def test_clock_there_and_back(spark):
    kept = iv.running_offset(frame(spark, [(1, 0, 1000), (1, 5000, 7000)]), ["rec"], ["s"])
    rows = frame(spark, [(1, 500, 6000)])
    out = iv.to_output(rows, kept, ["rec"], 1000)
    assert spans(out) == [(500, 1000), (1000, 2000)]
    assert spans(iv.to_source(out, kept, ["rec"], 1000)) == [(500, 1000), (5000, 6000)]


def test_ledger_restore(spark):
    kept, back, still = frame(spark, [(1, 0, 2000), (1, 5000, 10000)]), spark.createDataFrame([(1, 1, 2000, 4000)], "rec long, id long, s long, e long"), frame(spark, [(1, 3000, 5000)])
    assert spans(rules.ledger_restore(kept, back, still, ["rec"], 1000)) == [(0, 3000), (5000, 10000)]


def test_selection_and_loss(spark):
    ids = "rec long, id long, s long, e long"
    truth = spark.createDataFrame([(1, 1, 0, 10), (1, 2, 30, 40)], ids)
    clips = spark.createDataFrame([(1, 1, 0, 10), (1, 2, 0, 10), (1, 3, 50, 60)], ids)
    assert tuple(rules.selection_metrics(truth, clips, ["rec"], 10).first()) == (1, 1, 1)
    loss = rules.protected_loss(frame(spark, [(1, 1, 4)]), frame(spark, [(1, 0, 2), (1, 0, 2)]), ["rec"], 10).first()
    assert (loss["lost"], loss["doubled"]) == (2, 2)


def test_candidates_keep_one_of_five(spark):
    rows = spark.createDataFrame([(1, i, i * 10000, i * 10000 + 9000, "x") for i in range(10)], "rec long, id long, s long, e long, text string")
    asked = spark.createDataFrame([(1, 0, 4, 90.0), (1, 99999, 4, 1.0), (1, 8, 0, 1.0), (1, 0, 1, 1.0), (1, 2, None, 1.0)], "rec long, start_id long, end_id long, score double")
    found = rules.validate_candidates(asked, rows, 30_000, 60_000).collect()
    assert [(r["start_id"], r["end_id"], r["s"], r["e"]) for r in found] == [(0, 4, 0, 49200)]


def test_partition_and_quotes(spark):
    ids = lambda x: spark.createDataFrame([(i,) for i in x], "id long")
    assert sorted(map(tuple, rules.partition_violations(ids([1, 2, 3]), ids([2, 2, 9]), ["id"]).collect())) == [(1, "missing"), (2, "repeated"), (3, "missing"), (9, "unknown")]
    rows = spark.createDataFrame([(1, "abc"), (2, "abd")], "id long, text string")
    quotes = spark.createDataFrame([(10, 1, "bc"), (11, 1, "x"), (12, 5, "a"), (13, 1, "ab")], "quote_id long, id long, quote string")
    assert sorted(map(tuple, rules.quote_violations(quotes, rows).collect())) == [(11, 1, "not_in_row"), (12, 5, "unknown_row")]
    assert sorted(map(tuple, rules.rebind_quotes(quotes, rows).collect())) == [(10, 1)]


def test_reviews(spark):
    shares = spark.createDataFrame([(1, 12000, 40000), (2, 9000, 10000), (3, 12000, 100000)], "clip long, quoted_ms long, clip_ms long")
    assert [r["decision"] for r in rules.mixed_gate(shares).orderBy("clip").collect()] == ["keep", "exclude", "exclude"]
    parts = spark.createDataFrame([(1, 80, "keep"), (1, 20, "exclude"), (2, 80, "keep"), (2, 20, "hold"), (3, 80, "exclude"), (3, 20, "hold")], "clip long, ms long, decision string")
    assert [r["decision"] for r in rules.segmented_gate(parts).orderBy("clip").collect()] == ["keep", "hold", "exclude"]


@given(st.lists(st.tuples(st.integers(0, 3000), st.integers(1, 200_000)), min_size=1, max_size=80))
def test_windows_cover_all_rows(rows):
    starts, at = [], 0
    for _, n in rows:
        starts.append(at)
        at += n
    ends = [s + n for s, (_, n) in zip(starts, rows, strict=True)]
    found = sequential.window_bounds([c for c, _ in rows], starts, ends)
    assert {i for a, b in found for i in range(a, b)} == set(range(len(rows)))
    assert all(x[0] < y[0] for x, y in zip(found, found[1:], strict=False))


def test_greedy_operators():
    assert sequential.suppress([(0, 100, 50.0), (10, 100, 90.0), (200, 300, 10.0)]) == [1, 2]
    assert sequential.match_pairs([(0.9, 1, 1), (0.9, 2, 1), (0.8, 2, 2), (0.4, 3, 3)]) == [(2, 1)]
    assert sequential.batch_bounds([2000, 900, 100], 24, 2800) == [0, 1, 1]
    assert sequential.cue_numbers([20, 20, 5], [0, 100, 3000], [90, 200, 3100]) == [0, 1, 2]


def test_text_functions(spark):
    assert tx.normalize_text("Ｈello, Wörld! ") == "hellowörld"
    assert tx.similarity_of("short", "short") == 0.0 and tx.similarity_of("abcdefgh", "xxabcdefghxx") == 1.0
    rows = spark.createDataFrame([("01:02:03,004",), ("02:03.5",), ("00:99:12",), ("-1:00:00",), ("00:00:nan",)], "t string")
    assert [r[0] for r in rows.select(tx.parse_time(F.col("t"))).collect()] == [3723004, 123500, None, None, None]
    assert spark.range(1).select(tx.srt_time(F.lit(3723004)), tx.safe_name(F.lit(' a<b>. ')), tx.safe_name(F.lit("  "))).first()[:] == ("01:02:03,004", "a_b_", "untitled")


def test_subtitles_round_trip(spark):
    text = "WEBVTT\n\n00:00:01.250 --> 00:00:03.000\n<b>Hello</b>\nthere\n\n00:00:04.000 --> 00:00:06.000\nBye\n\n00:00:09.000 --> 00:00:10.000\nlate\n"
    rows = timed_text.parse_subtitles(spark.createDataFrame([(1, text)], "rec long, text string"), F.lit(5000))
    assert [tuple(r) for r in rows.orderBy("id").collect()] == [(1, 0, 1250, 3000, "Hello there"), (1, 1, 4000, 5000, "Bye")]
    assert timed_text.render_srt(rows).first()["srt"].startswith("1\n00:00:01,250 --> 00:00:03,000\nHello there\n\n2\n")


def test_chat_readers(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<i><d p="5,1,25">hi</d><d p="999,1">no</d></i>')
    assert [tuple(r) for r in timed_text.read_chat_xml(spark, f"{tmp_path}/a.xml", 100_000, 2_000).collect()] == [(7000, "hi")]
    files = spark.createDataFrame([('[{"progress":5000,"content":"a"},{"time":null,"start":5,"text":"b"},{"start":4,"text":"c"}]',)], "text string")
    assert sorted(map(tuple, timed_text.parse_chat_json(files, 100_000, -2_000).collect())) == [(2000, "c"), (3000, "a")]


def test_utf8_and_rows(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t/good.txt").write_bytes(b"\xef\xbb\xbfok")
    (tmp_path / "t/bad.txt").write_bytes(b"\xff\xfe")
    found = {r["path"].rsplit("/", 1)[1]: (r["text"], r["problem"]) for r in timed_text.read_utf8(spark, f"{tmp_path}/t").collect()}
    assert found == {"good.txt": ("ok", None), "bad.txt": (None, "not_utf8")}
    (tmp_path / "r.jsonl").write_text('{"id":1,"start":0.5,"end":9.0,"text":"x"}\n\nnot json\n')
    assert [tuple(r) for r in timed_text.read_rows(spark, f"{tmp_path}/r.jsonl", 5000).collect()] == [(1, 500, 5000, "x")]


def test_report_refuses_nan(spark, tmp_path):
    timed_text.write_report(spark.createDataFrame([(1.5,)], "x double"), f"{tmp_path}/ok")
    with pytest.raises(Exception, match="not finite"):
        timed_text.write_report(spark.createDataFrame([(float("nan"),)], "x double"), f"{tmp_path}/bad")


def test_tables(spark):
    table = spark.createDataFrame([(1, 5, "a"), (2, 5, "b")], "id long, revision int, payload string")
    changes = spark.createDataFrame([(1, 5, 1, "A"), (1, 5, 2, "late"), (2, 4, 3, "old")], "id long, seen int, ord long, payload string")
    new, late = storage.compare_and_swap(table, changes, "id")
    assert sorted(map(tuple, new.collect())) == [(1, 6, "A"), (2, 5, "b")] and late.count() == 2
    files = spark.createDataFrame([(1, 40, 1, True), (2, 40, 2, False), (3, 40, 3, False)], "id long, bytes long, used long, protected boolean")
    assert [r["id"] for r in storage.evict(files, 100).collect()] == [2]


def test_folds():
    assert state.fold_open([("a", 1, 5, False), ("b", 1, 7, False), ("a", 1, 6, True), ("a", 1, 9, False)], {}) == {"a": [1, 6, True]}
    assert state.step_states(["running", "done", "running"]) == ("done", 1)
    assert state.thread_counts([100, 100, 10, 10, 10, 10, 10]) == [4, 2, 2, 2, 3, 3, 3]


def test_streams(spark, tmp_path):
    spark.createDataFrame([("2026-01-01 00:00:01",), ("2026-01-01 00:00:14",), ("2026-01-01 00:01:00",)], "t string").select(F.to_timestamp("t").alias("ts")).write.parquet(f"{tmp_path}/chat")
    stream = spark.readStream.schema("ts timestamp").parquet(f"{tmp_path}/chat")
    run = state.chat_activity_stream(stream).writeStream.format("memory").queryName("bins").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted(r["n"] for r in spark.table("bins").collect()) == [1, 2]
    spark.createDataFrame([(1, "running"), (1, "done"), (1, "done")], "rec long, state string").coalesce(1).write.parquet(f"{tmp_path}/steps")
    steps = spark.readStream.schema("rec long, state string").parquet(f"{tmp_path}/steps")
    run = state.step_machine_stream(steps).writeStream.format("memory").queryName("steps").outputMode("update").trigger(availableNow=True).start()
    run.awaitTermination()
    assert [tuple(r) for r in spark.table("steps").collect()] == [(1, "done", 1)]


def test_subtract_is_a_fold_on_a_fine_clock(spark):
    import random

    rnd = random.Random(4)
    regions = [(i, i % 5, s, s + rnd.randrange(1, 60)) for i in range(150) for s in [rnd.randrange(200)]]
    covers = [(rnd.randrange(5), s, s + rnd.randrange(1, 12)) for _ in range(90) for s in [rnd.randrange(220)]]
    wanted = []
    for i, rec, s, e in regions:
        left = [(s, e)]
        for _, a, b in sorted(c for c in covers if c[0] == rec):
            left = [q for p in left for q in ([p] if min(p[1], b) - max(p[0], a) <= 2 else [x for x in ((p[0], a), (b, p[1])) if x[1] - x[0] > 2])]
        wanted += [(i, rec, *p) for p in left]
    found = iv.subtract(spark.createDataFrame(regions, "id long, rec long, s long, e long"), spark.createDataFrame(covers, "rec long, s long, e long"), ["rec"], 50)
    assert sorted((r["id"], r["rec"], r["s"], r["e"]) for r in found.collect()) == sorted(wanted)


def test_window_overlap_is_under_the_limit():
    # Rows of a second: the next window begins at the first row that starts less than 45 seconds before the end.
    n = 700
    found = sequential.window_bounds([10] * n, [1000 * i for i in range(n)], [1000 * i + 1000 for i in range(n)])
    for (_, end), (first, _) in zip(found, found[1:], strict=False):
        assert 1000 * end - 1000 * first < 45_000 <= 1000 * end - 1000 * (first - 1)
    assert sequential.window_bounds([], [], []) == [] and sequential.window_bounds([20_000, 5], [0, 10], [10, 20]) == [(0, 1), (1, 2)]


def test_captions_count_joining_spaces():
    assert sequential.cue_numbers([17, 18, 1], [0, 100, 200], [90, 190, 290]) == [0, 0, 1]
