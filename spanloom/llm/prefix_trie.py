"""The trie of conversation prefixes as intervals of a preorder.

A node is named by the sum of hashes of (place, turn) along its path, two 64-bit sums, so names come from
running sums and no task ever holds a whole conversation. Equal conversations are counted once. Distinct
conversations are ranked lexicographically: turns are joined to blocks, blocks get order-keeping names, and
blocks of names are joined again until one name is left. The members of a node are then neighbours, a node
is placed by its first member and its depth, and its subtree ends with the nodes that its last member brings.
What a subtree holds is a difference of two running sums over the preorder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .prefix_sums import running_sums
from .workspace import Workspace

QUERY = "op11_prefix_trie"

#: Conversations of one family share the first turns of the conversation whose id is divisible by this.
FAMILY = 20
#: A conversation takes over at most one turn less than this.
SHARED = 4
#: Turns, or names of blocks, that are joined to one block.
BLOCK = 64
#: Ids that are packed in one row before they are hashed.
PACK = 65_536

_WORDS = r"[\x20\x09-\x0D]+"


def numbered_turns(conversations: DataFrame, ws: Workspace) -> DataFrame:
    """conv_id, i (1, 2, ...), digest and words of every turn, in the order of turn (nulls first), role, text.

    A null role or text counts as empty; rows without conv_id belong to no conversation and are left out.
    """
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.lit(1).cast("long").alias("one"),
    )
    placed = running_sums(rows, ws, "turns", ["turn", "role", "text"], ["one"], "conv_id")
    words = F.size(F.filter(F.split("text", _WORDS), lambda x: x != "")).cast("long")
    digest = F.md5(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"))
    return ws.table(placed.select("conv_id", F.col("upto_one").alias("i"), digest.alias("digest"), words.alias("words")), "numbered")


def rebuilt_turns(turns: DataFrame, ws: Workspace) -> DataFrame:
    """conv_id, depth, size, digest, words of every turn of every rebuilt conversation, and a row of depth 0 for each.

    Conversation c starts with the first h turns of c - c % FAMILY (none where that is absent; % keeps the sign of
    c), then goes on with its own turns after its first h; h is the unsigned crc32 of c in decimals, mod SHARED.
    """
    sizes = ws.table(turns.groupBy("conv_id").agg(F.max("i").alias("n")), "sizes")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED
    convs = sizes.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"))
    taken = F.least("h", F.coalesce("base_n", F.lit(0)))
    convs = convs.join(sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n")), "base", "left")
    convs = ws.table(convs.select("conv_id", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size")), "convs")
    first = turns.where(F.col("i") < SHARED).withColumnRenamed("conv_id", "base")
    shared = convs.join(first, "base").where("i <= taken").select("conv_id", F.col("i").alias("depth"), "size", "digest", "words")
    own = turns.join(convs, "conv_id").where("i > h").select("conv_id", (F.col("taken") + F.col("i") - F.col("h")).alias("depth"), "size", "digest", "words")
    root = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), "size", F.lit("").alias("digest"), F.lit(0).cast("long").alias("words"))
    return own.unionByName(shared).unionByName(root)


def ranked(keys: DataFrame, ws: Workspace, name: str, key: str = "key") -> DataFrame:
    """``keys`` with ``rank``, a long that grows with the key; ranks leave gaps."""
    return ws.table(keys.repartitionByRange(key).sortWithinPartitions(key).withColumn("rank", F.monotonically_increasing_id()), name)


def rank_sequences(items: DataFrame, ws: Workspace, block: int = BLOCK) -> DataFrame:
    """conv_id, rank: the lexicographic order of the sequences of equally long ``name`` by ``at`` (0, 1, ...); prefixes come first.

    Each round joins up to ``block`` names, so that it needs as many rounds as the longest sequence has digits to
    that base, and no row ever holds more than ``block`` names.
    """

    def joined(df: DataFrame) -> DataFrame:
        near = F.array_sort(F.collect_list(F.struct("at", "name")))
        blocks = df.groupBy("conv_id", F.expr(f"at div {block}").alias("to")).agg(near.alias("near"))
        return blocks.select("conv_id", F.col("to").alias("at"), F.array_join(F.transform("near", lambda x: x["name"]), "").alias("key"))

    step, blocks = 0, ws.table(joined(items), "blocks-0")
    while (blocks.agg(F.max("at")).first()[0] or 0) > 0:
        step += 1
        names = ranked(blocks.select("key").distinct(), ws, f"names-{step}")
        named = blocks.join(names, "key").select("conv_id", "at", F.lpad(F.hex("rank"), 16, "0").alias("name"))
        blocks = ws.table(joined(named), f"blocks-{step}")
    return ranked(blocks.select("conv_id", "key"), ws, "ranks").select("conv_id", "rank")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (h1, h2, depth, conv_id) to rows of up to PACK ids of one node, written out in decimals."""

    node, ids, out, held = None, [], [], 0
    for batch in batches:
        for *here, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if ids and (here != node or len(ids) >= PACK):
                out.append((*node, ids[0], ",".join(map(str, ids))))
                held += len(ids)
                ids = []
                if held >= PACK:
                    yield _packs(out)
                    out, held = [], 0
            node = here
            ids.append(conv)
    if ids:
        out.append((*node, ids[0], ",".join(map(str, ids))))
    yield _packs(out)


def _packs(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (*[pa.int64()] * 4, pa.string()), strict=True)], names=["h1", "h2", "depth", "first", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of packed ids, sorted by node and first id, to one digest a node; only the digest so far is held."""
    node, digest, out = None, None, []
    for batch in batches:
        for *here, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if here != node:
                if node is not None:
                    out.append((*node, digest.hexdigest()))
                node, digest = here, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if len(out) >= 10_000:
            yield _digests(out)
            out = []
    if node is not None:
        out.append((*node, digest.hexdigest()))
    yield _digests(out)


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (*[pa.int64()] * 3, pa.string()), strict=True)], names=["h1", "h2", "depth", "ends_sha256"])


def prefix_trie(conversations: DataFrame, ws: Workspace, block: int = BLOCK) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, preorder, subtree_end.

    Nodes are the distinct sequences of first turns (role, text) of the rebuilt conversations. ``preorder`` numbers
    them from 0 so that a subtree is the range up to, without, ``subtree_end``. Conversations without a turn of
    their own after rebuilding end at the root. Repeated rows are turns of their own, in any number; rows without
    conv_id are left out; an empty table has no nodes; other columns are ignored.

    The names of nodes are 128 bits: two sums of 64-bit hashes of a turn's place and its 128-bit digest.
    """
    node = ["h1", "h2", "depth"]
    rows = rebuilt_turns(numbered_turns(conversations, ws), ws)
    f = lambda *x: F.when(F.col("depth") > 0, F.xxhash64(*x)).otherwise(F.lit(0).cast("long"))
    rows = rows.withColumns({"f1": f("depth", "digest"), "f2": f("digest", F.lit("|"), "depth")})
    rows = running_sums(rows, ws, "paths", ["depth"], ["f1", "f2"], "conv_id").select(
        "conv_id", "depth", "size", "digest", "words", F.col("upto_f1").alias("h1"), F.col("upto_f2").alias("h2"), F.col("before_f1").alias("p1"), F.col("before_f2").alias("p2"),
    )
    ends = ws.table(rows.where("depth = size").select(*node, "conv_id"), "ends")
    # Equal conversations: the smallest stands for all, so that copies in any number go no further.
    seqs = ws.table(ends.groupBy(*node).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("members")).select("conv_id", "members"), "sequences")
    rows = ws.table(rows.join(seqs, "conv_id"), "members")
    ranks = rank_sequences(rows.where("depth > 0").select("conv_id", (F.col("depth") - 1).alias("at"), F.col("digest").alias("name")), ws, block)
    # The empty sequence comes before all others.
    rank = F.coalesce("rank", F.lit(-1).cast("long"))
    nodes = ws.table(
        rows.join(ranks, "conv_id", "left").groupBy(*node).agg(
            F.min("conv_id").alias("conv_id"), F.sum("members").alias("n_convs"), F.min(rank).alias("first"), F.max(rank).alias("last"),
            F.min("words").alias("words"), F.min("p1").alias("p1"), F.min("p2").alias("p2"),
        ), "nodes")
    up = [F.col("p1").alias("h1"), F.col("p2").alias("h2"), (F.col("depth") - 1).alias("depth")]
    children = ws.table(nodes.where("depth > 0").select(*up).groupBy(*node).agg(F.count("*").alias("n_children")), "children")
    full = nodes.join(children, node, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    one = F.lit(1).cast("long")
    full = full.withColumns({"one": one, "leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("words")})
    placed = running_sums(full, ws, "preorder", ["first", "depth"], ["one", "leaf", "saved"])
    # Where the nodes that a conversation brings end, and what has been summed there.
    closing = placed.groupBy(F.col("first").alias("last")).agg(*[F.max(f"upto_{c}").alias(f"end_{c}") for c in ("one", "leaf", "saved")])
    packed = ends.repartitionByRange(*node, "conv_id").sortWithinPartitions(*node, "conv_id").select(*node, "conv_id").mapInArrow(_packed, "h1 long, h2 long, depth long, first long, ids string")
    packed = ws.table(packed, "packed-ends")
    hashed = packed.repartition(*node).sortWithinPartitions(*node, "first").select(*node, "ids").mapInArrow(_hashed, "h1 long, h2 long, depth long, ends_sha256 string")
    parents = nodes.select(F.col("h1").alias("p1"), F.col("h2").alias("p2"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    return (
        placed.join(ws.table(closing, "closing"), "last").join(parents, ["p1", "p2", "depth"], "left").join(ws.table(hashed, "hashed-ends"), node, "left")
        .select(
            "conv_id", "depth", F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id"), "n_convs", "n_children",
            (F.col("end_leaf") - F.col("before_leaf")).alias("n_leaves"), (F.col("end_saved") - F.col("before_saved")).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"), F.col("before_one").alias("preorder"), F.col("end_one").alias("subtree_end"),
        )
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"), Workspace(spark, "prefix-trie")).drop("preorder", "subtree_end")


_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
  lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda v, k: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295)"""

ORACLE_SQL = f"""
WITH turns AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, own, {_CRC32} % {SHARED} AS h FROM (SELECT c, list({{'role': role, 'text': text}} ORDER BY i) AS own FROM turns GROUP BY c)),
rebuilt AS (SELECT a.c, list_concat(CASE WHEN b.c IS NULL OR a.h = 0 THEN [] ELSE list_slice(b.own, 1, a.h) END, list_slice(a.own, a.h + 1, len(a.own))) AS seq
    FROM convs a LEFT JOIN convs b ON b.c = a.c - a.c % {FAMILY}),
prefixes AS (SELECT c, len(seq) AS size, d, CASE WHEN d = 0 THEN [] ELSE list_slice(seq, 1, d) END AS p FROM (SELECT c, seq, unnest(range(0, len(seq) + 1)) AS d FROM rebuilt)),
nodes AS (SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE size = d), '') AS ends,
    CASE WHEN d = 0 THEN 0 ELSE len(list_filter(regexp_split_to_array(p[d].text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) END AS words FROM prefixes GROUP BY p, d),
counted AS (SELECT n.*, (SELECT count(*) FROM nodes k WHERE k.d = n.d + 1 AND list_slice(k.p, 1, n.d) = n.p) AS n_children FROM nodes n),
below AS (SELECT n.p, n.d, sum(CASE WHEN k.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((k.n_convs - 1) * k.words) AS saved_tokens
    FROM nodes n JOIN counted k ON k.d >= n.d AND CASE WHEN n.d = 0 THEN true ELSE list_slice(k.p, 1, n.d) = n.p END GROUP BY n.p, n.d)
SELECT n.conv_id, n.d::BIGINT AS depth, up.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, n.n_children::BIGINT AS n_children, b.n_leaves::BIGINT AS n_leaves,
    b.saved_tokens::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM counted n JOIN below b ON b.p = n.p AND b.d = n.d LEFT JOIN nodes up ON n.d > 0 AND up.d = n.d - 1 AND up.p = CASE WHEN n.d = 1 THEN [] ELSE list_slice(n.p, 1, n.d - 1) END
"""
