"""The pipeline stage by stage on a small table, against brute force."""

import pytest

import corpus_pipeline
from spanloom.llm import quality_rules
from spanloom.llm.workspace import Workspace

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, ws, out = spark.read.parquet(f"{DATA}/documents.parquet"), Workspace(spark, "t"), []
    for name, stage in corpus_pipeline.STAGES:
        new = ws.table(stage(spark, docs, DATA), name)
        out.append((docs, new))
        docs = new
    return out


def test_columns_and_order(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_jaccard_join", "source_mixing", "sentencepiece"]
    for before, after in steps[:-1]:
        assert after.columns == ["doc_id", "text", "lang", "source", "n_chars"] == before.columns


def test_quality_stage(spark, steps):
    before, after = steps[0]
    kept = quality_rules.quality_rules(before, Workspace(spark, "t")).where("kept")
    assert sorted(r[0] for r in kept.select("doc_id").collect()) == sorted(r[0] for r in after.select("doc_id").collect())


def test_line_and_near_duplicate_stages(steps):
    before, after = steps[1]
    assert before.count() == after.count() and after.where("n_chars <> char_length(text)").count() == 0
    lines = {r["doc_id"]: r["text"].split("\n") for r in before.collect()}
    for r in after.collect():
        rest = iter(lines[r["doc_id"]])
        assert r["text"] == "" or all(x in rest for x in r["text"].split("\n"))
    before, after = steps[2]
    from tests.llm.test_llm_operators import near

    docs = [(r["doc_id"], r["text"]) for r in before.collect()]
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(d for d, _, c in near(docs) if d == c)


def test_mixing_and_tokens(spark, steps):
    before, after = steps[3]
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    clean = before.join(labels.where("quality = 1 AND toxic = 0"), "doc_id", "left_semi").select("doc_id")
    assert clean.join(after, "doc_id", "left_anti").count() == 0
    before, after = steps[4]
    assert before.count() == after.count() and after.where("n_tokens <> size(ids)").count() == 0


def test_near_duplicates_on_five_words(spark):
    from tests.llm.test_llm_operators import words

    own = lambda tag, n: [f"{tag}{i}" for i in range(n)]
    spaced = own("s", 240)
    for i in range(47, 240, 48):
        spaced[i] = f"new{i}"
    # A copy with 45 words appended, one with a word changed every 48, and one that is too far.
    texts = [own("a", 200), own("a", 200) + own("b", 45), own("s", 240), spaced, own("c", 200), own("c", 200) + own("d", 60)]
    docs = [(i, " ".join(w), "en", "src1", len(" ".join(w))) for i, w in enumerate(texts)]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (words(text) for _, text, *_ in docs)]
    wanted = [j for j in range(len(docs)) if not any(10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]) for i in range(j))]
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates_stage(spark, table, DATA)
    assert sorted(r["doc_id"] for r in kept.collect()) == wanted == [0, 2, 4, 5]
