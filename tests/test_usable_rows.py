"""Rows that can be used: a row's words stay in the row."""

from spanloom.plans import ledgers


def test_usable_rows(spark, tmp_path):
    texts = ["only", "a  b ", "two words", "", None, " ", "x y", "miss last", "a b"]
    spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = ledgers.usable_rows(spark, str(tmp_path))
    assert {r["row"]: r["usable"] for r in found.collect()} == {1: True, 2: True, 6: True, 7: False, 8: True}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "collect_list" not in plan
    words = {(r["row"], r["at"], r["word"], r["s"], r["e"]) for r in ledgers.aligned(spark, str(tmp_path)).where("row IN (1, 7)").collect()}
    assert {x[:3] for x in words} == {(1, 0, "a"), (1, 2, "b"), (7, 0, "miss")}
