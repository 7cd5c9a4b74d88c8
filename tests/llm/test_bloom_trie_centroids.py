"""Language model, prefix trie and centroid clusters against brute force, with nulls, ties, empty tables and clashing columns."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.llm import bloom_lm, centroids, prefix_trie
from spanloom.llm.prefix_sums import running_sums
from spanloom.llm.workspace import Workspace

DATA = "/root/testdata/sf0.001"


def clashing(df):
    return df.withColumns({x: F.lit(0) for x in ("part", "seq", "lead", "tie", "one", "h1", "rank", "chunk", "bucket", "n")})


# ---- running sums ----


def test_running_sums_with_segments_over_many_tasks(spark):
    rng = random.Random(3)
    # One segment holds most rows, so that it spans all tasks; sums wrap.
    rows = [(rng.choice([5, 5, 5, 5, 1, 9, 10]), i, rng.choice([1, -4, 2**62, -(2**63)])) for i in range(3000)]
    df = spark.createDataFrame(rows, "s long, k long, v long")
    found = running_sums(clashing(df), Workspace(spark, "t"), "sums", ["k"], ["v"], "s").select("s", "k", "before_v", "upto_v").collect()
    so_far, wanted, wrap = Counter(), [], lambda x: (x + 2**63) % 2**64 - 2**63
    for s, k, v in sorted(rows):
        wanted.append((s, k, wrap(so_far[s]), wrap(so_far[s] + v)))
        so_far[s] += v
    assert sorted(map(tuple, found)) == wanted
    whole = running_sums(df, Workspace(spark, "t"), "sums", ["s", "k"], ["v"]).orderBy("s", "k").select("upto_v").collect()
    assert whole[-1][0] == wrap(sum(v for _, _, v in rows))
    assert running_sums(df.limit(0), Workspace(spark, "t"), "sums", ["k"], ["v"], "s").count() == 0


def test_running_sums_split_rows_that_repeat(spark):
    df = spark.range(5000).select(F.lit(7).cast("long").alias("s"), F.lit(1).cast("long").alias("one"))
    found = running_sums(df, Workspace(spark, "t"), "sums", [], ["one"], "s")
    assert sorted(r[0] for r in found.select("upto_one").collect()) == list(range(1, 5001))


# ---- prefix trie ----


def trie(rows):
    """The contract, conversation by conversation."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = [*own.get(c - int(math.fmod(c, 20)), [])[:h], *turns[h:]]
    members, ends = defaultdict(list), defaultdict(list)
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
        ends[tuple(seq)].append(c)
    words = lambda node: len(node[-1][1].encode().split()) if node else 0
    children = Counter(n[:-1] for n in members if n)
    leaves, saved = Counter(), Counter()
    for n, m in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += n not in children
            saved[n[:d]] += (len(m) - 1) * words(n)
    return sorted(
        (min(m), len(n), min(members[n[:-1]]) if n else -1, len(m), children[n], leaves[n], saved[n], hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest())
        for n, m in members.items()
    )


CONTRACT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def found_trie(spark, rows, **more):
    df = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    nodes = prefix_trie.prefix_trie(df, Workspace(spark, "t"), **more).collect()
    return nodes, sorted(tuple(-1 if r[c] is None else r[c] for c in CONTRACT) for r in nodes)


def some_conversations(seed, n=120):
    rng = random.Random(seed)
    texts = ["hello there", "", None, "a b  c\td", "é\x0bü x", "long " * 500]
    rows = [(rng.randrange(-30, n), rng.choice([None, 0, 1, 2, 2, 3]), rng.choice(["user", "assistant", None, ""]), rng.choice(texts)) for _ in range(n * 4)]
    rows += [(20 * i, t, "system", "the common first turn") for i in range(6) for t in (None, None)]
    rows += [(200 + i, t, "user", f"turn {t}") for i in range(40) for t in range(5)]  # copies
    return [*rows, (None, 1, "user", "no conversation")]


@pytest.mark.parametrize("block", [2, 3, 64])
def test_trie_is_that_of_all_prefixes(spark, block):
    rows = some_conversations(block)
    # Long conversations that part late, one of them a prefix of another.
    rows += [(c, t, "user", f"t{t}" if t < 70 or c == 500 else f"u{t}") for c, n in ((500, 90), (520, 75), (540, 70), (560, 90)) for t in range(n)]
    nodes, found = found_trie(spark, rows, block=block)
    assert found == trie(rows)
    # Preorder: a subtree is an interval, inside its parent's.
    assert sorted(r["preorder"] for r in nodes) == list(range(len(nodes)))
    by_place = sorted(nodes, key=lambda r: r["preorder"])
    for r in by_place:
        inside = by_place[r["preorder"] + 1 : r["subtree_end"]]
        assert all(x["depth"] > r["depth"] and x["subtree_end"] <= r["subtree_end"] for x in inside)
        assert sum(x["depth"] == r["depth"] + 1 for x in inside) == r["n_children"]
        assert sum(x["n_children"] == 0 for x in [r, *inside]) == r["n_leaves"]


def test_trie_of_little(spark):
    assert found_trie(spark, [(None, 1, "user", "x")])[0] == []
    # crc32("0") % 4 is 1: conversation 0 keeps its turn; conversation 21 loses its only turn, and there is no base.
    for rows in ([(0, None, None, None)], [(21, 0, "user", "x")], [(c, 0, "user", "x y") for c in range(40)]):
        assert found_trie(spark, rows)[1] == trie(rows)


def test_packed_ids_of_one_node_over_many_rows(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PACK", 7)
    ids = list(range(100))
    batch = pa.RecordBatch.from_arrays([pa.array([1] * 100), pa.array([2] * 100), pa.array([0] * 100), pa.array(ids)], names=["h1", "h2", "depth", "conv_id"])
    packs = [b for b in prefix_trie._packed(iter([batch.slice(0, 40), batch.slice(40)])) if b.num_rows]
    assert sum(b.num_rows for b in packs) == 15
    hashed = [b.select(["h1", "h2", "depth", "ids"]) for b in packs]
    out = [r for b in prefix_trie._hashed(iter(hashed)) for r in b.to_pylist()]
    assert [r["ends_sha256"] for r in out] == [hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()]


# ---- language model ----

LONG = " ".join(f"word{i % 977}" for i in range(30_000))
TEXTS = [
    "The quick brown fox jumps over the lazy dog", "the quick brown cat", "THE QUICK brown fox", "the quick brown fox", "", None, "  \n\t\x0b ", LONG, "Ünder é \x1c\x85 x y\x00z   ok",
    "fox dog cat the the the the", "a" * 50_000, "dog",
]


def brute_model(rows, order, prior, quantise=True):
    """rows: (doc_id, text, in training); per row (n_tokens, n_known, base, score) and the number of training tokens."""
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    tokens = [[*(text or "").encode().translate(lower).split(), b""] for _, text, _ in rows]
    grams = [Counter() for _ in range(order + 1)]
    at = lambda seq, i, k: tuple([b""] * max(0, k - 1 - i) + seq[max(0, i - k + 1) : i + 1])
    for seq, (_, _, train) in zip(tokens, rows, strict=True):
        for i in range(len(seq) if train else 0):
            for k in range(1, order + 1):
                grams[k][at(seq, i, k)] += 1
    n, v = sum(grams[1].values()), len(grams[1])
    seen = lambda k, g: grams[k][g] if k == 1 or not quantise or not grams[k][g] else (3 * 2 ** (grams[k][g].bit_length() - 1) - 1) / 2
    out = []
    for seq in tokens:
        base = score = 0.0
        counts = []  # of the n-grams that end at each token, bounded by their parts
        for i in range(len(seq)):
            count = seen(1, at(seq, i, 1))
            p = (count + 0.1) / (n + 0.1 * (v + 1))
            base += math.log10(p)
            here = [count]
            for k in range(2, order + 1):
                context = grams[1][(b"",)] if i == 0 else counts[-1][k - 2]
                count = min(seen(k, at(seq, i, k)), context, count)
                p = (count + prior * p) / (context + prior)
                here.append(count)
            counts.append(here)
            score += math.log10(p)
        out.append((len(seq), sum(grams[1][(w,)] > 0 for w in seq), base, score))
    return out, n


def scored(spark, rows, **more):
    df = clashing(spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string"))
    train = F.array_contains(F.lit([i for i, _, t in rows if t and i is not None] or [-1]), F.col("doc_id"))
    found = bloom_lm.language_model(df, Workspace(spark, "t"), train, **more).collect()
    return {r["doc_id"]: r for r in found}, found


@pytest.mark.parametrize("order", [1, 2, 3])
@pytest.mark.parametrize("small", [False, True])
def test_model_is_that_of_exact_counts(spark, order, small):
    rows = [(i, t, i % 4 != 1) for i, t in enumerate(TEXTS * 2)]
    # So many hash functions that the filter makes no mistakes; small chunks, buckets and segments, or one of each.
    sizes = {"chunk_bytes": 60, "bucket": 5000, "segment": 3} if small else {}
    found, _ = scored(spark, rows, order=order, hashes=30, prior=5.0, **sizes)
    wanted, n = brute_model(rows, order, 5.0)
    for (i, _, train), (size, known, base, score) in zip(rows, wanted, strict=True):
        r = found[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (size, known, n, not train)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["score"] == pytest.approx(score, rel=1e-9)


def test_model_of_nothing_and_null_ids(spark):
    rows = [(None, "a b", False), (3, "a b", False), (3, "a b", False)]
    _, found = scored(spark, rows)
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"], r["base_score"], r["score"]) for r in found] == [(3, 0, 0, True, 0.0, 0.0)] * 3
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bloom_lm.language_model(empty, Workspace(spark, "t"), F.lit(True)).count() == 0


def test_filter_holds_all_and_little_else():
    rng = np.random.default_rng(5)
    prints = np.unique(rng.integers(0, 2**32, 40_000, dtype=np.uint32))
    counts = np.minimum(rng.zipf(1.7, len(prints)), 10**9).astype(np.int64)
    bits, content = bloom_lm.build_filter(prints, counts)
    levels = np.frexp(counts.astype(float))[1]
    found = bloom_lm.probe(prints, bits, content)
    assert (found >= levels).all() and (found > levels).mean() < 0.003  # errors are one-sided and rare
    others = np.setdiff1d(rng.integers(0, 2**32, 40_000, dtype=np.uint32), prints)
    assert (bloom_lm.probe(others, bits, content) > 0).mean() < 0.003
    assert bits <= 8 + levels.sum() * bloom_lm.HASHES / math.log(2) + 8
    assert not bloom_lm.probe(prints, *bloom_lm.build_filter(prints[:0], counts[:0])).any()


def test_query_beats_words_alone_on_held_out_documents(spark):
    import duckdb

    found = bloom_lm.query(spark, DATA.replace("0.001", "0.01")).toPandas()
    docs = duckdb.connect().execute(f"SELECT doc_id, text FROM '{DATA.replace('0.001', '0.01')}/documents.parquet' ORDER BY doc_id").fetchall()
    rows = [(i, t, zlib.crc32(str(i).encode()) % 10 != 0) for i, t in docs]
    wanted, n = brute_model(rows, 2, bloom_lm.PRIOR)
    found = found.sort_values("doc_id")
    assert found["doc_id"].tolist() == [i for i, _, _ in rows]
    assert found["held_out"].tolist() == [not t for _, _, t in rows]
    assert found["n_known"].tolist() == [w[1] for w in wanted] and set(found["train_tokens"]) == {n}
    assert np.allclose(found["base_score"], [w[2] for w in wanted], rtol=1e-9)
    # The filter's few mistakes give unseen pairs of words a count of one.
    exact = np.array([w[3] for w in wanted])
    assert np.isclose(found["score"], exact, rtol=0.01, atol=0.5).mean() > 0.95
    assert found["score"].sum() == pytest.approx(exact.sum(), rel=0.005)
    held = found[found["held_out"]]
    assert held["score"].sum() > held["base_score"].sum()


# ---- centroid clusters ----


def brute_clusters(rows, k, rounds):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    at = [v for _, _, v in sorted((hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest(), v, v) for i, v in kept)][:k]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(at))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[near(v)[1]].append(v)
        at = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if j in groups else c for j, c in enumerate(at)]
    out, sums = [], Counter()
    for i, v in kept:
        d, j = near(v)
        sums[j] += d
        out.append((i, j, d))
    most = lambda x: min(x, 2**63 - 1)
    return [(i, j, most(d), most(sums[j]), most(sum(sums.values())), hashlib.sha256(",".join(map(str, at[j])).encode()).hexdigest()) for i, j, d in out]


def clusters(spark, rows, k=40, rounds=5):
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    found = centroids.centroid_clusters(df, Workspace(spark, "t"), k, rounds)
    return sorted(map(tuple, found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)


def test_clusters_are_those_of_exact_arithmetic(spark):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(0, 0.2, 64).astype(np.float32).tolist()) for i in range(150)]
    # Many exact ties: coarse vectors, copies, and vectors midway between others.
    rows += [(200 + i, rng.integers(-1, 2, 64).astype(np.float32).tolist()) for i in range(60)] + [(300 + i, rows[i % 3][1]) for i in range(60)]
    rows += [(None, rows[5][1]), (300, rows[9][1]), (400, None), (401, [0.5] * 63), (402, [0.5] * 65), (403, [None, *[0.5] * 63]), (404, [float("nan"), *[0.5] * 63]), (405, [float("inf"), *[0.5] * 63]), (406, [])]
    assert clusters(spark, rows) == sorted(brute_clusters(rows, 40, 5), key=str)


def test_clusters_of_huge_and_few_vectors(spark):
    rng = np.random.default_rng(8)
    huge = [(i, (rng.normal(0, 1, 64) * 10.0 ** rng.integers(-3, 38)).astype(np.float32).tolist()) for i in range(60)]
    assert clusters(spark, huge, 8, 3) == sorted(brute_clusters(huge, 8, 3), key=str)
    few = [(i, [float(i)] * 64) for i in range(3)]
    assert clusters(spark, few) == sorted(brute_clusters(few, 40, 5), key=str)
    assert clusters(spark, [(1, None)]) == [] and clusters(spark, []) == []


def test_screening_intervals_hold(spark):
    rng = np.random.default_rng(9)
    for spread in (1, 50, 10**4, 10**7):
        at = [[int(v) for v in rng.integers(-spread, spread, 64)] for _ in range(12)]
        screen, x = centroids.Screen(at), rng.integers(-spread, spread, (200, 64)).astype(np.float64)
        low, high = screen.intervals(x)
        for r in range(len(x)):
            for k, c in enumerate(at):
                true = sum(v * v for v in c) - 2 * sum(int(a) * b for a, b in zip(x[r], c, strict=True))
                assert low[r, k] <= true <= high[r, k]
        assert (low > high.min(axis=1, keepdims=True)).any()  # it does rule centroids out


def test_sums_in_pieces_are_whole():
    for values in ([0, 0], [1, -1], [2**40, -(2**39)], [2**137 + 5, -(2**90) - 3]):
        assert [sum(p[i] << (centroids.PIECE * k) for k, p in centroids.pieces(values).items()) for i in range(2)] == values
