"""Boilerplate lines by the number of distinct sites that show them.

A HyperLogLog sketch of sites for each line hash is built in every task and merged by the aggregation, so a
line of any frequency costs one small sketch a task. The estimate settles lines clearly under or over the
limit; those near it get exact distinct counts. A boilerplate line stays at its first place (smallest
doc_id, then position) and is removed everywhere else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import Workspace, documents, unused

QUERY = "op8_line_spread"

#: A line on at least so many distinct sites is boilerplate.
MIN_SITES = 10
#: Relative standard deviation of the sketches: 128 registers.
SKETCH_ERROR = 0.1
#: Estimates within so many standard deviations of the limit are counted exactly.
NEAR = 4.0

_TRIMMED = " \t\r\x0b\x0c"


def _identity() -> Column:
    """Rows with the same id are told apart by their text."""
    return F.unhex(F.md5(F.coalesce("text", F.lit(""))))


def split_lines(docs: DataFrame, site: str) -> DataFrame:
    """doc_id, k, site, pos, h of every line with anything but white space; h is the 128-bit hash of the trimmed line."""
    lines = docs.select("doc_id", _identity().alias("k"), F.col(site).cast("string").alias("site"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    line = F.btrim(F.col("line"), F.lit(_TRIMMED))
    return lines.where(line != "").select("doc_id", "k", "site", "pos", F.unhex(F.md5(line)).alias("h"))


def boilerplate(lines: DataFrame, ws: Workspace, min_sites: int, error: float = SKETCH_ERROR) -> DataFrame:
    """h of the lines on at least ``min_sites`` distinct sites; a null site is none."""
    spread = ws.table(lines.groupBy("h").agg(F.approx_count_distinct("site", error).alias("sites")), "spread")
    margin = max(1.0, NEAR * error * min_sites)
    sure = spread.where(F.col("sites") > min_sites + margin).select("h")
    near = ws.table(spread.where(F.col("sites").between(min_sites - margin, min_sites + margin)).select("h"), "near")
    exact = lines.join(near, "h", "left_semi").groupBy("h").agg(F.count_distinct("site").alias("sites")).where(F.col("sites") >= min_sites).select("h")
    return ws.table(sure.unionByName(exact), "boilerplate")


def line_spread(docs: DataFrame, ws: Workspace, min_sites: int = MIN_SITES, site: str = "source") -> DataFrame:
    """The rows of ``docs`` with their text without boilerplate lines, and n_lines and n_removed.

    Lines end at a line feed and are compared without white space at their ends; blank lines are never
    boilerplate. A null text stays null and has no line; a text of which every line goes becomes empty. A
    null site is no site. Null ids come last in the order of first places; rows repeated in full are
    treated alike. An empty table gives an empty result. Further columns pass through; input columns named
    n_lines or n_removed are replaced.
    """
    lines = ws.table(split_lines(docs, site), "lines")
    bad = boilerplate(lines, ws, min_sites)
    hits = ws.table(lines.join(bad, "h").select("doc_id", "k", "pos", "h"), "hits")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "k", "pos")
    first = ws.table(hits.groupBy("h").agg(F.min(place).alias("first")).select("h", "first.doc_id", "first.k", "first.pos"), "first")
    first = first.select("h", F.col("doc_id").alias("keep_id"), F.col("k").alias("keep_k"), F.col("pos").alias("keep_pos"))
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("k") == F.col("keep_k")) & (F.col("pos") == F.col("keep_pos"))
    # Bounded by the document's own lines.
    drop = hits.join(first, "h").where(~stays).groupBy("doc_id", "k").agg(F.collect_set("pos").alias("drop"))
    drop_id, drop_k, gone = (unused(docs, x) for x in ("drop_id", "drop_k", "drop"))
    drop = ws.table(drop.select(F.col("doc_id").alias(drop_id), F.col("k").alias(drop_k), F.col("drop").alias(gone)), "drop")
    keep = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    split = F.split("text", "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(gone))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(split, i)), "\n"))
    joined = docs.join(drop, docs["doc_id"].eqNullSafe(drop[drop_id]) & (_identity() == drop[drop_k]), "left")
    return joined.select(
        *[text.alias(c) if c == "text" else docs[c] for c in keep],
        F.when(F.col("text").isNull(), 0).otherwise(F.size(split)).cast("long").alias("n_lines"),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    return line_spread(docs, Workspace(spark, "line-spread")).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(1, len(string_split(text, chr(10))))) AS pos
  FROM documents
), keyed AS (
  SELECT *, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS key FROM lines
), bad AS (
  SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT source) >= 10
), ranked AS (
  SELECT k.*, b.key IS NOT NULL AS hit, row_number() OVER (PARTITION BY k.key ORDER BY k.doc_id, k.pos) AS nth
  FROM keyed k LEFT JOIN bad b ON k.key = b.key
), grouped AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE hit AND nth > 1) AS n_removed,
         string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT (hit AND nth > 1)) AS text
  FROM ranked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(g.n_lines, 0) AS n_lines, coalesce(g.n_removed, 0) AS n_removed, sha256(coalesce(g.text, '')) AS text_sha256
FROM documents d LEFT JOIN grouped g ON d.doc_id = g.doc_id
"""
