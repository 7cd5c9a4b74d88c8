"""A language model in a log-frequency Bloom filter.

Documents are gathered in chunks, a row each: its distinct words by hash and its texts as numbers of them. What
is counted leaves a chunk already added up, dealt by hash into buckets, so no word or n-gram is hot.

- Words (and the end of a text) are counted exactly; every chunk gets back the totals of its own words.
- Counts of longer n-grams are quantised to powers of two. An n-gram seen c times enters its bucket's filter as
  the pairs (n-gram, 1) ... (n-gram, 1 + floor(log2 c)); reading it back probes 1, 2, ... until one is missing.
  A filter has as many bits as its pairs need, so its error is the same at every size of the corpus.
- Buckets are broadcast a segment at a time, and each segment meets only the n-grams that are dealt to it:
  memory has a bound whatever the corpus holds, and each n-gram is probed once a chunk.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import Workspace, documents

QUERY = "op12_bloom_lm"

#: Words of an n-gram at most.
ORDER = 2
#: Hash functions of the filter: a pair that was never added is found with chance 2 ** -HASHES.
HASHES = 10
#: Added to every word's count.
ADDED = 0.1
#: How many sightings the shorter context's opinion is worth.
PRIOR = 100.0
#: UTF-8 bytes of texts in a chunk; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 23
#: N-grams, or words, that a bucket has on average at most.
BUCKET = 1 << 19
#: Buckets in a broadcast segment. A bucket of 2 ** 19 sightings has at most as many pairs, so a segment has 31 MB at HASHES = 10.
SEGMENT = 32

#: Rows of chunks that a Python worker gets at once.
ROWS = 1

_CHUNKS = "chunk string, doc_ids array<long>, held_out array<boolean>, sizes array<long>, tokens binary, words binary, word_counts binary, n_tokens long, n_words long"
_END = np.uint64(xxhash.xxh3_64_intdigest(b""))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tokenised(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers of all texts, each ended by the number of the end; numbers per text; the sorted hashes that the numbers index.

    A-Z are lower-cased, words are parted by [\\x20\\x09-\\x0D]; the end's hash is that of the empty word. Null counts as empty.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    flat = lists.flatten()
    real = pc.greater(pc.binary_length(flat), 0)
    offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    sizes = np.diff(np.concatenate(([0], np.cumsum(real.to_numpy(zero_copy_only=False))))[offsets])
    coded = flat.filter(real).dictionary_encode()
    hashes = np.array([_END, *(xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.cast(pa.large_binary()).to_pylist())], np.uint64)
    words, number = np.unique(hashes, return_inverse=True)
    ids = np.full(int(sizes.sum()) + len(sizes), number[0], np.int32)
    inside = np.ones(len(ids), bool)
    inside[np.cumsum(sizes + 1) - 1] = False
    ids[inside] = number[1:][coded.indices.to_numpy()]
    return ids, sizes + 1, words


def contexts(ids: np.ndarray, end: int, order: int) -> list[np.ndarray]:
    """For each token the one before, the one before that, and so on; before a text's first token there are only ends."""
    found, here = [], ids
    for _ in range(order - 1):
        before = np.concatenate(([end], here[:-1])).astype(ids.dtype)
        here = before if not found else np.where(found[-1] == end, end, before)
        found.append(here)
    return found


def gram_hashes(ids: np.ndarray, words: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the n-grams of 2, 3, ... ``order`` tokens that end at each token."""
    end = int(np.searchsorted(words, _END))
    before = contexts(ids, end, order)
    out = []
    with np.errstate(over="ignore"):
        for k in range(2, order + 1):
            x = np.full(len(ids), k, np.uint64)
            for place in reversed(before[: k - 1]):
                x = mixed(x) + words[place]
            out.append(mixed(mixed(x) + words[ids]))
    return out


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each hash; it never falls as hashes grow."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def bit_places(prints: np.ndarray, level: int, bits: int, hashes: int) -> Iterator[np.ndarray]:
    """The bits of the pairs (32-bit print, level) in a filter of so many bits, one array a hash function."""
    with np.errstate(over="ignore"):
        x = mixed(prints.astype(np.uint64) + (np.uint64(level) << np.uint64(32)))
        low, step = x & np.uint64(0xFFFFFFFF), (x >> np.uint64(32)) | np.uint64(1)
        for i in range(hashes):
            # The fixed term keeps the places apart where the step is next to nothing.
            yield (((low + np.uint64(i) * step + np.uint64(i * i * 0x9E3779B1)) & np.uint64(0xFFFFFFFF)) * np.uint64(bits)) >> np.uint64(32)


def build_filter(prints: np.ndarray, counts: np.ndarray, hashes: int = HASHES) -> tuple[int, bytes]:
    """Bits and content of the filter that holds these prints with these counts (1 or more)."""
    levels = np.frexp(counts.astype(np.float64))[1]
    bits = max(8, 8 * math.ceil(int(levels.sum()) * hashes / math.log(2) / 8))
    flags = np.zeros(bits, bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        for places in bit_places(prints[levels >= level], level, bits, hashes):
            flags[places] = True
    return bits, np.packbits(flags, bitorder="little").tobytes()


def probe(prints: np.ndarray, bits: int, content: bytes, hashes: int = HASHES) -> np.ndarray:
    """The level of each print: how many of the pairs 1, 2, ... are found before the first that is not."""
    data = np.frombuffer(content, np.uint8)
    levels, alive, level = np.zeros(len(prints), np.uint8), np.arange(len(prints)), 0
    while len(alive) and level < 64:
        level += 1
        there = np.ones(len(alive), bool)
        for places in bit_places(prints[alive], level, bits, hashes):
            there &= (data[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8)) & 1 != 0
        alive = alive[there]
        levels[alive] = level
    return levels


def expected_count(levels: np.ndarray) -> np.ndarray:
    """The middle of the counts that have this level: 0, 1, 2.5, 5.5, ..."""
    return np.where(levels > 0, (3 * np.exp2(levels.astype(np.float64) - 1) - 1) / 2, 0.0)


def _read(column: pa.Array, i: int, kind: type) -> np.ndarray:
    """Numbers of a binary cell, not copied."""
    return np.frombuffer(column[i].as_buffer(), kind)


def packed(counts: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs, after one byte that tells how many."""
    kind = np.min_scalar_type(int(counts.max(initial=0)))
    return bytes([kind.itemsize]) + counts.astype(kind).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"u{data[0]}", offset=1).astype(np.int64)


def packed_ids(ids: np.ndarray, distinct: int) -> bytes:
    """Word numbers in three bytes each where that is enough, else in four; one byte tells which."""
    width = 3 if distinct < 1 << 24 else 4
    return bytes([width]) + ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].tobytes()


def unpacked_ids(column: pa.Array, i: int) -> np.ndarray:
    data = _read(column, i, np.uint8)
    out = np.zeros((len(data) // int(data[0]), 4), np.uint8)
    out[:, : data[0]] = data[1:].reshape(-1, int(data[0]))
    return out.reshape(-1).view("<i4")


@contextmanager
def rows_at_once(spark: SparkSession, n: int) -> Iterator[None]:
    """Within it, Python workers get at most ``n`` rows at a time, so that rows of megabytes don't meet in one batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, n)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def chunked(docs: DataFrame, ws: Workspace, train: Column, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The documents in chunks, a row each; written once, so that all later steps see the same chunks."""

    def row(parts: list[tuple[pa.Array, pa.Array, pa.Array]]) -> pa.RecordBatch:
        ids, texts, held = (pa.concat_arrays([p[i] for p in parts]) for i in range(3))
        tokens, sizes, words = tokenised(texts)
        counted = np.repeat(~held.to_numpy(zero_copy_only=False), sizes)
        counts = np.bincount(tokens[counted], minlength=len(words))
        values = [uuid.uuid4().hex, ids.to_pylist(), held.to_pylist(), sizes.tolist(), packed_ids(tokens, len(words)), words.tobytes(), packed(counts), len(tokens), len(words)]
        types = [pa.string(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), *[pa.binary()] * 3, pa.int64(), pa.int64()]
        names = ["chunk", "doc_ids", "held_out", "sizes", "tokens", "words", "word_counts", "n_tokens", "n_words"]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                # Up to the first row with which the chunk is full.
                to = min(batch.num_rows, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + chunk_bytes - size)) + 1)
                parts.append(tuple(c.slice(at, to - at) for c in batch.columns))
                size += int(sizes[to - 1] - (sizes[at - 1] if at else 0))
                at = to
                if size >= chunk_bytes:
                    yield row(parts)
                    parts, size = [], 0
        if parts:
            yield row(parts)

    rows = docs.select(F.col("doc_id").cast("long"), "text", (~F.coalesce(train, F.lit(False))).alias("held_out"))
    return ws.table(rows.mapInArrow(run, _CHUNKS), "chunks")


def _slices(hashes: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """The buckets that occur, with their part of the sorted hashes."""
    of = bucket_of(hashes, buckets)
    starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(of)), bool), of[1:] != of[:-1])))
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(of)], strict=True):
        yield int(of[a]), slice(a, b)


def word_totals(chunks: DataFrame, ws: Workspace, buckets: int) -> DataFrame:
    """chunk, bucket, totals (of the chunk's words, in their order), and a row a bucket without chunk: its distinct words and tokens."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, chunk in enumerate(batch.column(0).to_pylist()):
                words, counts = _read(batch.column(1), i, np.uint64), unpacked(batch.column(2)[i].as_py())
                rows = [(b, chunk, words[s].tobytes(), packed(counts[s])) for b, s in _slices(words, buckets)]
                columns = zip(zip(*rows, strict=True), (pa.int32(), pa.string(), pa.binary(), pa.binary()), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names=["bucket", "chunk", "words", "counts"])

    def add_up(table: pa.Table) -> pa.Table:
        chunk, words = table.column("chunk").to_pylist(), [np.frombuffer(x, np.uint64) for x in table.column("words").to_pylist()]
        counts = np.concatenate([unpacked(x) for x in table.column("counts").to_pylist()])
        known, at = np.unique(np.concatenate(words), return_inverse=True)
        total = np.zeros(len(known), np.int64)
        np.add.at(total, at, counts)
        parts = np.split(total[at], np.cumsum([len(x) for x in words])[:-1])
        n, bucket = len(chunk) + 1, table.column("bucket")[0].as_py()
        return pa.table({
            "chunk": pa.array([*chunk, None], pa.string()), "bucket": pa.array([bucket] * n, pa.int32()), "totals": pa.array([*(packed(x) for x in parts), None], pa.binary()),
            "distinct": pa.array([*[0] * (n - 1), int((total > 0).sum())], pa.int64()), "tokens": pa.array([*[0] * (n - 1), int(total.sum())], pa.int64()),
        })

    dealt = chunks.select("chunk", "words", "word_counts").mapInArrow(deal, "bucket int, chunk string, words binary, counts binary")
    with rows_at_once(chunks.sparkSession, ROWS):
        return ws.table(dealt.groupBy("bucket").applyInArrow(add_up, "chunk string, bucket int, totals binary, distinct long, tokens long"), "totals")


def gram_levels(chunks: DataFrame, ws: Workspace, buckets: int, order: int, hashes: int, segment: int = SEGMENT) -> DataFrame:
    """chunk, bucket, levels: what the filters hold of each distinct n-gram of a chunk, in the order of hashes."""
    spark = chunks.sparkSession

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (chunk, held, sizes) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True)):
                found = np.concatenate(gram_hashes(unpacked_ids(batch.column(3), i), _read(batch.column(4), i, np.uint64), order))
                counted = np.tile(np.repeat(~np.array(held, bool), sizes), order - 1)
                place = np.argsort(found, kind="stable")
                found, counted = found[place], counted[place]
                starts = np.flatnonzero(np.concatenate((np.ones(1, bool), found[1:] != found[:-1])))
                grams, counts = found[starts], np.add.reduceat(counted, starts, dtype=np.uint32)
                del found, counted, place
                prints = (grams & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                rows = [(chunk, b, prints[s].tobytes(), packed(counts[s]), b // segment) for b, s in _slices(grams, buckets)]
                columns = zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.int32()), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names=["chunk", "bucket", "prints", "counts", "segment"])

    def build(table: pa.Table) -> pa.Table:
        prints = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("prints").to_pylist()])
        counts = np.concatenate([unpacked(x) for x in table.column("counts").to_pylist()])
        order_of = np.argsort(prints[counts > 0])
        prints, counts = prints[counts > 0][order_of], counts[counts > 0][order_of]
        starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(prints)), bool), prints[1:] != prints[:-1])))
        bits, content = build_filter(prints[starts], np.add.reduceat(counts, starts) if len(starts) else counts, hashes)
        bucket = table.column("bucket")[0].as_py()
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "bits": pa.array([bits], pa.int64()), "content": pa.array([content], pa.binary()), "segment": pa.array([bucket // segment], pa.int32())})

    grams, filters, levels = ws.path("grams"), ws.path("filters"), ws.path("levels")
    schema = "chunk string, bucket int, prints binary, counts binary, segment int"
    with rows_at_once(spark, ROWS):
        chunks.select("chunk", "held_out", "sizes", "tokens", "words").mapInArrow(deal, schema).write.partitionBy("segment").parquet(grams)
    dealt = spark.read.schema(schema).parquet(grams)
    made = dealt.select("bucket", "prints", "counts").groupBy("bucket").applyInArrow(build, "bucket int, bits long, content binary, segment int")
    made.write.partitionBy("segment").parquet(filters)
    for s in range(-(-buckets // segment)):
        # At most ``segment`` rows of a bounded size.
        held = spark.read.schema("bucket int, bits long, content binary, segment int").parquet(filters).where(F.col("segment") == s)
        sent = spark.sparkContext.broadcast({r["bucket"]: (r["bits"], bytes(r["content"])) for r in held.collect()})

        def look_up(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            known = sent.value
            for batch in batches:
                prints = [np.frombuffer(x, np.uint32) for x in batch.column(2).to_pylist()]
                found = [probe(p, *known[b], hashes).tobytes() for b, p in zip(batch.column(1).to_pylist(), prints, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["chunk", "bucket", "levels"])

        mine = dealt.where(F.col("segment") == s).select("chunk", "bucket", "prints")
        mine.mapInArrow(look_up, "chunk string, bucket int, levels binary").write.mode("append").parquet(levels)
        sent.destroy()
    return spark.read.schema("chunk string, bucket int, levels binary").parquet(levels)


def log_scores(tokens: np.ndarray, words: np.ndarray, totals: np.ndarray, levels: np.ndarray, n: int, v: int, order: int, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """log10 of each token's probability by words alone and by the model.

    The model of k words gives (c(context, token) + prior * p of k - 1 words) / (c(context) + prior). A count read
    from the filters is never taken to be over those of its context or of its own ending, so probabilities stay in (0, 1].
    """
    end = int(np.searchsorted(words, _END))
    count = totals[tokens].astype(np.float64)
    p = (count + ADDED) / (n + ADDED * (v + 1))
    base = np.log10(p)
    if order > 1:
        before = contexts(tokens, end, 2)[0]
        _, at = np.unique(np.concatenate(gram_hashes(tokens, words, order)), return_inverse=True)
        ended = before == end
        context = totals[before].astype(np.float64)
        for k in range(order - 1):
            count = np.minimum(np.minimum(expected_count(levels[at[k * len(tokens) : (k + 1) * len(tokens)]]), context), count)
            p = (count + prior * p) / (context + prior)
            context = np.where(ended, float(totals[end]), np.concatenate(([0.0], count[:-1])))
    return base, np.log10(p)


def language_model(docs: DataFrame, ws: Workspace, train: Column, order: int = ORDER, prior: float = PRIOR, hashes: int = HASHES, chunk_bytes: int = CHUNK_BYTES, bucket: int = BUCKET, segment: int = SEGMENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``.

    The model learns from the rows where ``train`` is true (null: not). A null or empty text has one token, the
    end. Repeated rows and ids count and are scored each; null ids are kept. Nothing to learn from gives every
    token the same probability. An empty table gives no rows; other columns are ignored.
    Words are told apart by 64-bit hashes, longer n-grams by their bucket and 32 bits.
    """
    chunks = chunked(docs, ws, train, chunk_bytes)
    size = chunks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("words")).first()
    totals = word_totals(chunks, ws, max(1, -(-size["words"] // bucket)))
    known = totals.where("chunk is null").agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    n, v = int(known[0]), int(known[1])

    def gathered(df: DataFrame, column: str) -> DataFrame:
        # As many entries as the chunk has buckets.
        return df.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("bucket", column))).alias(column))

    full = chunks.join(gathered(totals.where("chunk is not null"), "totals"), "chunk").select("chunk", "doc_ids", "held_out", "sizes", "tokens", "words", F.col("totals.totals").alias("totals"))
    if order > 1:
        levels = gram_levels(chunks, ws, max(1, -(-size["tokens"] * (order - 1) // bucket)), order, hashes, segment)
        full = full.join(gathered(levels, "levels"), "chunk").withColumn("levels", F.col("levels.levels"))
    else:
        full = full.withColumn("levels", F.array().cast("array<binary>"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        for batch in batches:
            for i, (ids, held, sizes) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True)):
                tokens, words = unpacked_ids(batch.column(3), i), _read(batch.column(4), i, np.uint64)
                total = np.concatenate([unpacked(x) for x in batch.column(5)[i].as_py()])
                level = np.frombuffer(b"".join(batch.column(6)[i].as_py()), np.uint8)
                base, model = log_scores(tokens, words, total, level, n, v, order, prior)
                starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
                sums = [np.add.reduceat(x, starts) for x in ((total[tokens] > 0).astype(np.int64), base, model)]
                columns = [pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(sizes, pa.int64()), pa.array(sums[0]), pa.array([n] * len(ids), pa.int64()), *map(pa.array, sums[1:])]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    with rows_at_once(chunks.sparkSession, ROWS):
        return ws.table(full.select("doc_ids", "held_out", "sizes", "tokens", "words", "totals", "levels").mapInArrow(score, schema), "scores")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    in_training = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 != 0
    return language_model(documents(spark, sf_dir), Workspace(spark, "bloom-lm"), in_training)


#: Words alone could be counted by SQL; the filter and what it answers could not.
ORACLE_SQL = None
