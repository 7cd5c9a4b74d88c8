"""Views of the tables as timed text and intervals, in Spark and, word for word in meaning, in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Buckets of interval joins, in milliseconds: about the length of an interval.
WIDTH = 600_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ev(spark: SparkSession, d: str, kind: str | None = None) -> DataFrame:
    """Intervals: id, rec (the user), kind, s, e; ten minutes a unit of value."""
    rows = read(spark, d, "events").where("value > 0")
    start = F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    rows = rows.select(F.col("event_id").alias("id"), F.col("user_id").alias("rec"), F.col("event_type").alias("kind"), start.alias("s"), (start + F.floor(F.col("value") * 600_000).cast("long")).alias("e"), "value")
    rows = rows.where("e > s")
    return rows.where(F.col("kind") == kind) if kind else rows


EV = """ev AS (
  SELECT event_id AS id, user_id AS rec, event_type AS kind, epoch_us(ts) // 1000 AS s,
         epoch_us(ts) // 1000 + CAST(floor(value * 600000) AS BIGINT) AS e, value
  FROM events WHERE value > 0 AND CAST(floor(value * 600000) AS BIGINT) > 0
)"""


def chat(spark: SparkSession, d: str) -> DataFrame:
    """Chat messages: id, time in whole seconds since the first, text."""
    rows = read(spark, d, "events").select(F.col("event_id").alias("id"), F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("sec"), F.col("event_type").alias("text"))
    first = rows.agg(F.min("sec").alias("first"))
    return rows.crossJoin(F.broadcast(first)).select("id", (F.col("sec") - F.col("first")).alias("time"), "text")  # first is one row


CHAT = """chat AS (
  SELECT event_id AS id, epoch_us(ts) // 1000000 - (SELECT min(epoch_us(ts) // 1000000) FROM events) AS time, event_type AS text FROM events
)"""


def sentences(spark: SparkSession, d: str) -> DataFrame:
    """Transcript rows of conversations: rec, id, role, s, e, text on one clock a recording."""
    rows = read(spark, d, "conversations")
    order = Window.partitionBy("conv_id").orderBy("turn")
    size = F.greatest(F.lit(1), F.length(F.coalesce("text", F.lit(""))))
    start = 50 * F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.select(F.col("conv_id").alias("rec"), (F.row_number().over(order) - 1).cast("long").alias("id"), "role", start.alias("s"), (start + 50 * size - 10).alias("e"), F.coalesce("text", F.lit("")).alias("text"))


SENTENCES = """sized AS (
  SELECT conv_id AS rec, turn, role, coalesce(text, '') AS text, greatest(1, length(coalesce(text, ''))) AS size FROM conversations
), sentences AS (
  SELECT rec, row_number() OVER w - 1 AS id, role,
         CAST(50 * coalesce(sum(size) OVER (PARTITION BY rec ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s,
         CAST(50 * coalesce(sum(size) OVER (PARTITION BY rec ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 50 * size - 10 AS BIGINT) AS e, text
  FROM sized WINDOW w AS (PARTITION BY rec ORDER BY turn)
)"""


def proposals(spark: SparkSession, d: str) -> DataFrame:
    """Proposals over sentences: rec, start_id, end_id, score; some of them break a rule."""
    rows = sentences(spark, d)
    score = F.when(F.col("id") % 5 == 0, F.lit(None)).otherwise((F.col("id") * 37 % 130 - 10).cast("double"))
    return rows.select("rec", F.col("id").alias("start_id"), (F.col("id") + F.col("rec") % 5 - 1).alias("end_id"), score.cast("double").alias("score"))


PROPOSALS = """proposals AS (
  SELECT rec, id AS start_id, id + rec % 5 - 1 AS end_id, CASE WHEN id % 5 = 0 THEN NULL ELSE CAST(id * 37 % 130 - 10 AS DOUBLE) END AS score FROM sentences
)"""


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """Ledger rows: interval events with a status, and reasons of which some are blank."""
    status = F.when(F.col("id") % 4 == 0, "blocked").when(F.col("id") % 4 == 1, "suggested").otherwise("applied")
    blank = F.when(F.col("id") % 3 == 0, "").when(F.col("id") % 3 == 1, F.lit(None).cast("string")).otherwise("overlap")
    reason = F.when(F.col("id") % 5 == 0, " ").otherwise(F.col("kind"))
    return ev(spark, d).select("id", "rec", "s", "e", status.alias("status"), blank.alias("block_reason"), reason.alias("reason"))


CANDIDATES = """candidates AS (
  SELECT id, rec, s, e, CASE WHEN id % 4 = 0 THEN 'blocked' WHEN id % 4 = 1 THEN 'suggested' ELSE 'applied' END AS status,
         CASE WHEN id % 3 = 0 THEN '' WHEN id % 3 = 1 THEN NULL ELSE 'overlap' END AS block_reason,
         CASE WHEN id % 5 = 0 THEN ' ' ELSE kind END AS reason
  FROM ev
)"""


def clips(spark: SparkSession, d: str) -> DataFrame:
    return ev(spark, d).groupBy("rec").agg(F.min("s").alias("lo"), F.max("e").alias("hi"))


CLIPS = "clips AS (SELECT rec, min(s) AS lo, max(e) AS hi FROM ev GROUP BY rec)"


def words(spark: SparkSession, d: str) -> DataFrame:
    """Words of conversations: rec, id (place in the recording), word."""
    rows = sentences(spark, d).select("rec", "id", F.posexplode(F.split("text", " ")).alias("at", "word")).where("word <> ''")
    order = Window.partitionBy("rec").orderBy("id", "at")
    return rows.select("rec", (F.row_number().over(order) - 1).cast("long").alias("id"), F.lower("word").alias("word"))


WORDS = """cut AS (
  SELECT rec, id, unnest(string_split(text, ' ')) AS word, unnest(generate_series(1, len(string_split(text, ' ')))) AS place FROM sentences
), words AS (
  SELECT rec, row_number() OVER (PARTITION BY rec ORDER BY id, place) - 1 AS id, lower(word) AS word FROM cut WHERE word <> ''
)"""


def islands(source: str, name: str, keys: str = "rec", eps: int = 0) -> str:
    """CTEs that merge the intervals of ``source`` into ``name``."""
    return f"""{name}_f AS (
  SELECT {keys}, s, e, CASE WHEN s <= max(e) OVER (PARTITION BY {keys} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {eps} THEN 0 ELSE 1 END AS new FROM {source}
), {name}_n AS (
  SELECT {keys}, s, e, sum(new) OVER (PARTITION BY {keys} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM {name}_f
), {name} AS (
  SELECT {keys}, min(s) AS s, max(e) AS e FROM {name}_n GROUP BY {keys}, island
)"""
