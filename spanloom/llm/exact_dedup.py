"""Exact duplicates by 128-bit content hash, with bytes compared inside groups.

Only built-in DataFrame functions run here. One scan hashes each normalised text; from there on rows of
a few dozen bytes are shuffled. The texts themselves move only for hashes held by two rows or more, and
copies meet first inside each task, so that a group of any size costs one text per task. Should two
different texts share a hash, the rows of that hash are grouped by the text itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import Workspace, documents

QUERY = "op4_exact_dedup"

#: Characters that do not count when texts are compared.
IGNORED = r"[\x20\x09-\x0D]+"
#: Hashes that two rows or more hold are broadcast up to this number (16 bytes each), else joined by shuffle.
BROADCAST_HASHES = 500_000


def md5_128(text: Column) -> Column:
    """The MD5 of a text in UTF-8, 16 bytes."""
    return F.unhex(F.md5(text))


def _rows(docs: DataFrame, content_hash: Callable[[Column], Column]) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    norm = F.regexp_replace(text, IGNORED, "")
    return docs.select("doc_id", F.char_length(text).alias("cps"), norm.alias("norm")).select(
        "doc_id", "cps", "norm", content_hash(F.col("norm")).alias("h")
    )


def _keepers(base: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key with two rows or more: how many, and the row that stays.

    The largest struct is the row with most code points, then the smallest doc_id (~ reverses the order
    without overflow; a null id comes last), then the first row as written.
    """
    best = F.max(F.struct("cps", F.bitwise_not("doc_id").alias("id"), F.bitwise_not("rid").alias("rid")))
    return (
        base.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"), best.alias("best"))
        .where("n > 1")
        .select(*keys, "n", F.bitwise_not("best.id").alias("keep_id"), F.bitwise_not("best.rid").alias("keep_rid"))
    )


def exact_dedup(docs: DataFrame, ws: Workspace, content_hash: Callable[[Column], Column] = md5_128, broadcast_hashes: int = BROADCAST_HASHES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without the characters of ``IGNORED``; a null text counts as empty, and
    all empty texts form one group. The row with the most code points in its original text stays, then the
    smallest doc_id. Rows repeated with the same id are one group, of which one row stays; a null doc_id
    loses to every other. An empty table gives an empty result; columns other than doc_id and text are
    ignored whatever their names.
    """
    docs = docs.select("doc_id", "text")
    base = ws.table(
        _rows(docs, content_hash).select("doc_id", "cps", "h", F.unhex(F.sha2("norm", 256)).alias("sha"), F.monotonically_increasing_id().alias("rid")),
        "base",
    )
    keepers = ws.table(_keepers(base, ["h"]), "keepers")
    shared = keepers.select("h")
    if keepers.count() <= broadcast_hashes:
        shared = F.broadcast(shared)
    # Bytes are compared by grouping on the text itself: copies fold inside each task before the shuffle.
    texts = _rows(docs, content_hash).join(shared, "h", "left_semi").groupBy("h", "norm").agg(F.count(F.lit(1)).alias("rows"))
    collided = ws.table(texts.groupBy("h").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("h"), "collided")
    keys = ["h"]
    if not collided.isEmpty():
        # Different texts under one hash: those rows carry their text as a second key.
        keys = ["h", "same"]
        marked = _rows(docs, content_hash).join(collided.withColumn("hit", F.lit(True)), "h", "left")
        base = ws.table(
            marked.select(
                "doc_id", "cps", "h", F.unhex(F.sha2("norm", 256)).alias("sha"), F.monotonically_increasing_id().alias("rid"),
                F.when(F.col("hit"), F.col("norm")).otherwise("").alias("same"),
            ),
            "base_by_text",
        )
        keepers = ws.table(_keepers(base, keys), "keepers_by_text")
    # Both sides come straight from tables, so that adaptive execution may split a hot hash.
    return base.join(keepers, keys, "left").select(
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("n").isNull() | (F.col("rid") == F.col("keep_rid"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir), Workspace(spark, "exact-dedup"))


ORACLE_SQL = r"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), ranked AS (
  SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id) AS keep_id
  FROM base
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM ranked
"""
