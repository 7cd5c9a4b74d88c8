"""Near-duplicate groups by an exact Jaccard join on word n-grams, with rare-first prefix filtering.

Texts with equal n-gram sets are one entity. Two sets can only reach the threshold if they share an n-gram
among their rarest ones, so each entity brings that prefix of its set alone. Within the entities of one
prefix n-gram, pairs are pruned by length, by position and by a suffix filter (how what follows the common n-gram
in both sets spreads over ranges of hashes), and what remains is verified on the whole sets, once a pair.

Groups of one n-gram are never expanded into all pairs. The first round compares a group's first
entity with the others, each later one about twice as many as the one before; entities that are linked by then need
no comparison. Those that led leave the group, and rounds go on until every group is one component or, where
few are left in it, their pairs across components are compared at once, pruned inside the join. So no link that
could join two components is lost, and rounds are as many as a group's size has bits, at most.

N-grams are compared by 64-bit hashes: two sets are misjudged only if different n-grams of the two share one,
with a chance under n * m / 2 ** 64 for n and m n-grams.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .kept import only
from .workspace import Workspace, documents

QUERY = "op10_ngram_join"

WORDS = 4
PERCENT = 85
#: Counters of the frequency sketch. Its size does not depend on the corpus; n-grams that share a counter
#: only blur the order, which may be any, as long as it is the same for all.
SKETCH_BITS = 22
_SLABS = 256
#: Ranges of hashes for the suffix bound.
RANGES = 16
#: Groups of at most so many remaining entities compare all their pairs across components at once.
FEW = 256
#: About so many entities of a larger group are compared with all others in the second round, twice as many in each later one.
LEADERS = 16
#: Sets wanted for verification are picked by broadcast up to this number (16 bytes each), else by shuffle.
BROADCAST_SETS = 500_000

#: Bits of an entity's first number.
_LOW = 53
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: An odd number, so that it has an inverse modulo 2 ** 64.
_BASE = 0x9E3779B97F4A7C15
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9FB21C651E98DF25)]
_BLOCK = 1 << 20
_powers: list[np.ndarray] = [np.ones(1, np.uint64)] * 2


def _power_tables(size: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, up to a size; kept, and grown when a longer text comes."""
    if len(_powers[0]) < size:
        size = max(size, _BLOCK + (1 << 16))
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            table = np.full(size, np.uint64(base))
            table[0] = 1
            _powers[i] = np.multiply.accumulate(table)
    return _powers


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in order, and each word's text."""
    raw = np.frombuffer(b"\n".join([b"", *texts, b""]).translate(_LOWER), np.uint8)
    space = _IS_SPACE[raw]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    words = np.empty(len(starts), np.uint64)
    at, word = 0, 0
    while at < len(raw):  # in blocks that end at white space, so that the running sums stay small
        end = at + _BLOCK
        end = end + int(np.argmax(space[end:])) + 1 if end < len(raw) else len(raw)
        n = int(np.searchsorted(starts, end))
        power, inverse = _power_tables(end - at + 1)
        sums = np.zeros(end - at + 1, np.uint64)
        np.cumsum((raw[at:end].astype(np.uint64) + np.uint64(1)) * power[: end - at], out=sums[1:])
        words[word:n] = (sums[ends[word:n] - at] - sums[starts[word:n] - at]) * inverse[starts[word:n] - at]
        at, word = end, n
    words ^= words >> np.uint64(32)
    words *= _MIX[7]
    words ^= words >> np.uint64(29)
    first = np.cumsum([1, *(len(x) + 1 for x in texts)])
    return words, np.searchsorted(first, starts, "right") - 1


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """Of each text the distinct n-grams as sorted 64-bit hashes; fewer words than n make one n-gram, none make none.

    Words are hashed over the whole batch at once, from running sums of bytes times powers.
    """
    h, of = _words([(x or "").encode("utf-8", "surrogatepass") for x in texts])
    cuts = np.searchsorted(of, np.arange(len(texts) + 1)).tolist()
    grams = _mix([h[k : max(0, len(h) - words + 1) + k] for k in range(words)])
    out = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b - a >= words:
            out.append(np.unique(grams[a : b - words + 1]))
        else:
            out.append(_mix([h[k : k + 1] for k in range(a, b)]) if b > a else np.empty(0, np.uint64))
    return out


def _mix(columns: list[np.ndarray]) -> np.ndarray:
    out = np.full(len(columns[0]), np.uint64(len(columns)))
    for k, x in enumerate(columns):
        out = (out ^ ((x ^ (x >> np.uint64(31))) * _MIX[k])) * _MIX[5]
        out ^= out >> np.uint64(29)
    out *= _MIX[6]
    out ^= out >> np.uint64(32)
    return out


def signature(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def _buckets(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _texts(batches: Iterator[pa.RecordBatch], column: int, words: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    only(QUERY)
    for batch in batches:
        for part in (batch.slice(i, 128) for i in range(0, batch.num_rows, 128)):
            yield part, shingle_sets(part.column(column).to_pylist(), words)


def _survey(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """doc_id, n, sig and further columns of each row; then, at the task's end, the task's counts by n-gram hash in compressed slabs."""
    counts = np.zeros(1 << SKETCH_BITS, np.uint32)
    names = ["doc_id", "n", "sig", "slab", "counts"]
    waiting: list[np.ndarray] = []
    for part, sets in _texts(batches, 1, words):
        rows, further = part.num_rows, part.columns[2:]
        kinds = [x.type for x in further]
        yield pa.RecordBatch.from_arrays(
            [part.column(0).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([signature(s) if len(s) else None for s in sets], pa.binary()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary()), *further],
            names=[*names, *part.schema.names[2:]],
        )
        waiting.append(_buckets(np.concatenate(sets)))
        if sum(map(len, waiting)) >= 1 << 20:
            counts += np.bincount(np.concatenate(waiting), minlength=1 << SKETCH_BITS).astype(np.uint32)
            waiting = []
    if waiting:
        counts += np.bincount(np.concatenate(waiting), minlength=1 << SKETCH_BITS).astype(np.uint32)
    if counts.any():
        press = zstandard.ZstdCompressor(level=1)
        slabs = [press.compress(_by_byte(x)) for x in counts.reshape(_SLABS, -1)]
        yield pa.RecordBatch.from_arrays([pa.nulls(_SLABS, pa.int64()), pa.nulls(_SLABS, pa.int64()), pa.nulls(_SLABS, pa.binary()), pa.array(range(_SLABS), pa.int32()), pa.array(slabs, pa.binary()), *[pa.nulls(_SLABS, x) for x in kinds]], names=[*names, *part.schema.names[2:]])


def _by_byte(counts: np.ndarray) -> bytes:
    """Low bytes of all counters, then the next ones: most of the latter are zero and vanish when compressed."""
    return counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _add_slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum the tasks' counts slab by slab; frequencies become classes of a quarter of a doubling, one byte each."""
    total: dict[int, np.ndarray] = {}
    plain = zstandard.ZstdDecompressor()
    for batch in batches:
        for slab, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts = np.frombuffer(plain.decompress(raw), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()
            total[slab] = total.get(slab, 0) + counts.astype(np.uint64)
    for slab, counts in total.items():
        classes = np.minimum(np.floor(4 * np.log2(counts + 1.0)), 255).astype(np.uint8)
        yield pa.RecordBatch.from_pydict({"slab": pa.array([slab], pa.int32()), "classes": pa.array([classes.tobytes()], pa.binary())})


def _ranges(grams: np.ndarray) -> list[int]:
    # By the low bits, which the order does not use first.
    return np.bincount((grams & np.uint64(RANGES - 1)).astype(np.int64), minlength=RANGES).tolist()


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n + (-percent * n // 100) + 1 if n else 0


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def _prefixes(docs: DataFrame, order, words: int, percent: int) -> DataFrame:
    """sig, key, n, spread, prefix of every text with an n-gram; the prefix in the common order, rarest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = np.frombuffer(order.value, np.uint8)
        for part, found in _texts(batches, 0, words):
            sets = [s for s in found if len(s)]
            keys = [k for k, s in zip(part.column(1).to_pylist(), found, strict=True) if len(s)]
            # Ties of frequency are in the order of the hashes: the sets are sorted, and so is the sort stable.
            prefixes = [s[np.argsort(classes[_buckets(s)], kind="stable")[: prefix_length(len(s), percent)]].view(np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array([signature(s) for s in sets], pa.binary()), pa.array(keys, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([_ranges(s) for s in sets], pa.list_(pa.int32())), pa.array(prefixes, pa.list_(pa.int64()))],
                names=["sig", "key", "n", "spread", "prefix"],
            )

    return docs.select("text", text_key(F.col("text")).alias("key")).mapInArrow(run, "sig binary, key binary, n long, spread array<int>, prefix array<long>")


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """a, b, n, m, grams: the set of each text that a pair asks for; rows of one text stand side by side, so that its set is made once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, grams = None, None
        for batch in batches:
            for part in (batch.slice(i, 64) for i in range(0, batch.num_rows, 64)):
                eids, texts, found = part.column(0).to_pylist(), part.column(1), []
                for i, eid in enumerate(eids):
                    if eid != last:
                        last, grams = eid, shingle_sets([texts[i].as_py()], words)[0].view(np.int64)
                    found.append(grams)
                yield pa.RecordBatch.from_arrays([*part.columns[2:], pa.array(found, pa.list_(pa.int64()))], names=[*part.schema.names[2:], "grams"])

    return texts.select("eid", "text", "a", "b", "n", "m").mapInArrow(run, "a long, b long, n int, m int, grams array<long>")


def _agree(percent: int):
    """Of rows sorted by pair, two a pair: the pairs whose sets share enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            out = []
            for i, (a, b, n, m) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True)):
                grams = batch.column(4)[i].values.to_numpy()
                if held is not None and held[0] == (a, b):
                    if (100 + percent) * len(np.intersect1d(held[1].view(np.uint64), grams.view(np.uint64), assume_unique=True)) >= percent * (n + m):
                        out.append((a, b))
                    held = None
                else:
                    held = ((a, b), grams)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(2)], names=["a", "b"])

    return run


def _enough(overlap: Column, n: Column, m: Column, percent: int) -> Column:
    """Whether that overlap of sets of n and m gives the Jaccard similarity asked for, in whole numbers."""
    return (100 + percent) * overlap >= percent * (n + m)


def _passes(percent: int) -> Column:
    """Length and position: of the entities n, pos and m, at that share an n-gram, could it be the first of enough?"""
    n, m, i, j = F.col("n"), F.col("m"), F.col("pos"), F.col("at")
    length = 100 * F.least(n, m) >= percent * F.greatest(n, m)
    return length & _enough(F.least(n - i, m - j), n, m, percent)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows, sorted by token, whose token another row has too; the last row of a batch waits for the next one."""
    held, passes = None, False
    for batch in batches:
        table = pa.Table.from_batches([batch] if held is None else [held, batch])
        token = table["token"].to_numpy()
        keep = np.zeros(len(token), bool)
        keep[1:] = token[1:] == token[:-1]
        keep[:-1] |= keep[1:]
        if len(token):
            keep[0] |= passes
            yield from table.slice(0, len(token) - 1).filter(pa.array(keep[:-1])).to_batches()
            held, passes = table.slice(len(token) - 1).combine_chunks().to_batches()[0], bool(keep[-1])
    if passes:
        yield held


def link_entities(docs: DataFrame, entities: DataFrame, ws: Workspace, percent: int = PERCENT, few: int = FEW, broadcast_sets: int = BROADCAST_SETS, words: int = WORDS) -> DataFrame:
    """eid, label of the entities with a link; entities: eid, sig, key, n, spread, prefix."""
    tokens = entities.select("eid", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("pos", "token")).select("token", "eid", "n", "pos")
    # An n-gram of one entity links nothing. One shuffle finds the others; a hot one's rows stream through their task.
    hits = ws.table(tokens.repartition("token").sortWithinPartitions("token").mapInArrow(_shared, "token long, eid long, n int, pos int"), "hits")
    # New numbers, by how many prefix n-grams an entity has for itself: the least altered copies come first
    # and lead, as most others are near to them. The low bits stay the old number.
    own = ws.table(hits.groupBy("eid").agg(F.count(F.lit(1)).alias("hits")), "own")
    small = own.count() <= broadcast_sets
    number = F.shiftleft(F.least(F.size("prefix") - F.col("hits"), F.lit(1023)).cast("long"), _LOW).bitwiseOR(F.col("eid"))
    numbered = entities.select("eid", "key", "prefix").join(F.broadcast(own) if small else own, "eid")
    numbered = ws.table(numbered.select(F.col("eid").alias("was"), number.alias("eid"), "key"), "numbered")
    names = numbered.select("was", "eid")
    groups = ws.table(hits.withColumnRenamed("eid", "was").join(F.broadcast(names) if small else names, "was").select("token", "eid", "n", "pos"), "grouped")
    ws.drop("hits", "own")
    leads = groups.groupBy("token").agg(F.min("eid").alias("lead"))
    groups = ws.table(groups.join(leads, "token").select("token", "lead", "eid", "n", "pos"), "groups")
    ws.drop("grouped")
    labels = entities.sparkSession.createDataFrame([], "node long, label long")
    groups = groups.withColumns({"small": F.lit(False), "leads": F.col("eid") == F.col("lead"), "label": F.col("eid")})
    links = compared = None
    step = 0
    while True:
        other = [F.col("eid").alias("a"), F.col("n").alias("m"), F.col("pos").alias("at"), F.col("label").alias("other")]
        across = (F.col("label") != F.col("other")) & _passes(percent)
        within = groups.where("small").join(groups.where("small").select("token", *other), "token").where((F.col("a") < F.col("eid")) & across)
        stars = groups.where("NOT small").join(groups.where("NOT small AND leads").select("token", *other), "token").where((~F.col("leads") | (F.col("a") < F.col("eid"))) & across)
        pairs = stars.unionByName(within) if step else stars
        # Where a pair meets several times, the first of its common n-grams leaves most to follow.
        turned = F.col("a") > F.col("eid")
        places = F.struct(F.when(turned, F.col("pos")).otherwise(F.col("at")).alias("i"), F.when(turned, F.col("at")).otherwise(F.col("pos")).alias("j"))
        pairs = pairs.groupBy(F.least("a", "eid").alias("a"), F.greatest("a", "eid").alias("b")).agg(F.min(places).alias("places"))
        if compared is not None:
            pairs = pairs.join(compared, ["a", "b"], "left_anti")
        pairs = ws.table(_likely(entities, ws.table(pairs, "matched"), ws, percent, broadcast_sets), f"pairs-{step}")
        found = _verified(docs, numbered, pairs, ws, step, percent, broadcast_sets, words)
        ws.drop("matched", "ids", "brief", "wanted")
        compared = pairs.select("a", "b") if compared is None else compared.unionByName(pairs.select("a", "b"))
        if found is not None:
            links = found if links is None else links.unionByName(found)
            labels = connected_components(links, ws, f"components-{step}")
        # What is left: groups without those that led, where they still hold several components.
        left = groups.where("NOT small AND NOT leads").select("token", "eid", "n", "pos")
        left = left.join(labels.withColumnRenamed("node", "eid"), "eid", "left").withColumn("label", F.coalesce("label", "eid"))
        left = ws.table(left, "left")
        ws.drop("groups")
        parts = left.groupBy("token", "label").agg(F.count(F.lit(1)).alias("n"), F.min("eid").alias("lead"))
        sums = [F.min("lead").alias("lead"), F.sum("n").alias("rows"), F.max(F.struct("n", "label")).alias("most"), F.count(F.lit(1)).alias("labels")]
        mixed = parts.groupBy("token").agg(*sums).where("labels > 1")
        mixed = ws.table(mixed.select("token", "lead", "rows", F.col("most.label").alias("major"), (F.col("rows") - F.col("most.n")).alias("others")), "mixed")
        if mixed.isEmpty():
            ws.drop("left", "mixed")
            return labels.select(F.col("node").bitwiseAND(F.lit((1 << _LOW) - 1)).alias("eid"), "label")
        # Those that lead next: all outside the group's largest component where they are few, so that the
        # group is done; else the first entity, and more by a hash that changes with the round, twice as many each time.
        more = LEADERS << step
        step += 1
        drawn = (F.col("eid") == F.col("lead")) | (F.pmod(F.xxhash64("eid", F.lit(step)), F.greatest(F.col("rows") / more, F.lit(1)).cast("long")) == 0)
        leads = F.when(F.col("others") <= 2 * more, F.col("label") != F.col("major")).otherwise(drawn)
        groups = left.join(mixed, "token").select("token", "eid", "n", "pos", "label", (F.col("rows") <= few).alias("small"), leads.alias("leads"))
        groups = ws.table(groups, "groups")
        ws.drop("left", "mixed")


def _ids(pairs: DataFrame, ws: Workspace, broadcast_sets: int) -> DataFrame:
    """eid of all entities of the pairs; broadcast where they are few."""
    ids = ws.table(pairs.select(F.col("a").alias("eid")).unionByName(pairs.select(F.col("b").alias("eid"))).distinct(), "ids")
    return F.broadcast(ids) if ids.count() <= broadcast_sets else ids


def _likely(entities: DataFrame, pairs: DataFrame, ws: Workspace, percent: int, broadcast_sets: int) -> DataFrame:
    """a, b, n, m of the pairs that pass the suffix filter: if the n-gram they met by is the first that they share, can enough follow?

    What follows it in a set is the set without its prefix up to there; ranges of hashes bound what two of them share.
    A pair whose first common n-gram is another one passes or falls where it meets by that one.
    """
    ids = _ids(pairs, ws, broadcast_sets)
    few = entities.select(F.col("eid").alias("was"), F.col("n").cast("int").alias("n"), "spread", "prefix")
    brief = ws.table(few.join(ids, F.col("was") == F.col("eid").bitwiseAND(F.lit((1 << _LOW) - 1))).drop("was"), "brief")
    rest = lambda pos: F.aggregate(F.slice("prefix", F.lit(1), pos + 1), F.col("spread"), lambda acc, t: F.transform(acc, lambda v, r: v - (r == F.pmod(t, F.lit(RANGES))).cast("int")))
    left = pairs.join(brief.withColumnRenamed("eid", "a"), "a").select("a", "b", "places", "n", rest(F.col("places.i")).alias("after"))
    both = left.join(brief.select(F.col("eid").alias("b"), F.col("n").alias("m"), "spread", "prefix"), "b")
    both = both.select("a", "b", "n", "m", "after", rest(F.col("places.j")).alias("other"))
    bound = F.aggregate(F.zip_with("after", "other", lambda x, y: F.least(x, y)), F.lit(1), lambda acc, x: acc + x)
    return both.where(_enough(bound, F.col("n"), F.col("m"), percent)).select("a", "b", "n", "m")


def _verified(docs: DataFrame, numbered: DataFrame, pairs: DataFrame, ws: Workspace, step: int, percent: int, broadcast_sets: int, words: int) -> DataFrame | None:
    """The pairs a, b whose whole sets reach the threshold; None where there are none."""
    if pairs.isEmpty():
        return None
    wanted = ws.table(numbered.select("eid", "key").join(_ids(pairs, ws, broadcast_sets), "eid"), "wanted")
    pick = F.broadcast(wanted) if wanted.count() <= broadcast_sets else wanted
    # Only texts that are wanted leave their tasks, each once; copies fold inside each task.
    texts = docs.select("text", text_key(F.col("text")).alias("key")).join(pick, "key").groupBy("eid").agg(F.first("text").alias("text"))
    sides = pairs.select(F.col("a").alias("eid"), "a", "b", "n", "m").unionByName(pairs.select(F.col("b").alias("eid"), "a", "b", "n", "m"))
    sets = _sets(texts.join(sides.hint("shuffle_merge"), "eid"), words).repartition("a", "b").sortWithinPartitions("a", "b")
    found = ws.table(sets.mapInArrow(_agree(percent), "a long, b long"), f"links-{step}")
    return None if found.isEmpty() else found


def ngram_join(docs: DataFrame, ws: Workspace, percent: int = PERCENT, few: int = FEW, words: int = WORDS, keyed: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id; with ``keyed`` also k, the text's key, and the component's label.

    Words are runs of anything but ASCII white space, with A-Z lower-cased. Null and empty texts have no
    n-gram and are linked with nothing. Equal texts are linked whatever their ids; null ids are never a
    component's id unless it has no other. An empty table gives an empty result; columns other than doc_id
    and text are ignored.
    """
    docs, key = docs.select("doc_id", "text"), ["k"] if keyed else []
    read = docs.select("*", *[text_key(F.col("text")).alias(x) for x in key])
    survey = ws.table(read.mapInArrow(lambda batches: _survey(batches, words), ", ".join(["doc_id long, n long, sig binary, slab int, counts binary", *[f"{x} binary" for x in key]])), "survey")
    slabs = survey.where("slab IS NOT NULL").select("slab", "counts").repartition("slab").mapInArrow(_add_slabs, "slab int, classes binary")
    # Fixed in size: one byte a counter.
    classes = np.zeros((_SLABS, (1 << SKETCH_BITS) // _SLABS), np.uint8)
    for row in slabs.toLocalIterator():
        classes[row["slab"]] = np.frombuffer(row["classes"], np.uint8)
    order = docs.sparkSession.sparkContext.broadcast(classes.tobytes())
    rows = survey.where("slab IS NULL").select("doc_id", "n", "sig", *key)
    entities = _prefixes(docs, order, words, percent).groupBy("sig").agg(F.first("key").alias("key"), F.first("n").alias("n"), F.first("spread").alias("spread"), F.first("prefix").alias("prefix"))
    entities = ws.table(entities.withColumn("eid", F.monotonically_increasing_id()), "entities")
    labels = link_entities(docs, entities, ws, percent, few, words=words)
    named = entities.select("sig", "eid").join(labels, "eid", "left").select("sig", F.coalesce("label", -F.col("eid") - 1).alias("label"))  # alone: a number of its own
    # Both sides come straight from tables, so that adaptive execution may split a hot set or component.
    placed = ws.table(rows.join(ws.table(named, "named"), "sig", "left"), "placed")
    lowest = ws.table(placed.where("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("low")), "lowest")
    return placed.join(lowest, "label", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("low")).alias("component_id"), *key, *["label"] * keyed)


def keep_one(docs: DataFrame, ws: Workspace, broadcast_docs: int = BROADCAST_SETS, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the smallest doc_id stays, of rows repeated in full one.

    Where an id repeats with different texts, each text is judged by itself: it goes with its own component,
    and of near copies under one id that with the smallest key stays. Rows with a null id can't be named and stay.
    """
    found = ws.table(ngram_join(docs, ws, percent, words=words, keyed=True), "found")
    repeated = ws.table(found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    twice = found.where("doc_id = component_id AND label IS NOT NULL").join(repeated, "doc_id", "left_semi").select("doc_id", "label", "k").distinct()
    stays = twice.groupBy("label").agg(F.min("k").alias("stays"))
    within = twice.join(stays, "label").where("k <> stays").select("doc_id", "k")
    gone = found.where("doc_id <> component_id").select("doc_id", "k").unionByName(within).distinct()
    gone = ws.table(gone.select(F.col("doc_id").alias("gone_id"), F.col("k").alias("gone_k")), "gone")
    if gone.count() <= broadcast_docs:
        gone = F.broadcast(gone)
    rows = docs.join(gone, (docs["doc_id"] == gone["gone_id"]) & (text_key(docs["text"]) == gone["gone_k"]), "left_anti")
    if repeated.isEmpty():
        return rows
    once = rows.join(repeated, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return rows.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(once)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(documents(spark, sf_dir), Workspace(spark, "ngram-join"))


ORACLE_SQL = None
