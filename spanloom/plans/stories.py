"""Registered queries: retellings near in time, proofs that a telling is repeated, events of one story merged with their lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import consolidation, similar
from .catalogue import query
from .views import SENTENCES, WIDTH, sentences


def tellings(spark: SparkSession, d: str) -> DataFrame:
    """Rows of conversations as events, and what speakers say again five seconds later: users all but their first words, others with a slip."""
    rows = sentences(spark, d).select("rec", "id", "role", "s", "e", F.regexp_replace("text", r"[^\p{L}\p{M}\p{N}]+", "").alias("told"))
    slip = F.concat(F.substring(F.col("told"), F.lit(1), F.floor(F.length("told") / 2).cast("int")), F.lit("x"), F.substring(F.col("told"), F.floor(F.length("told") / 2).cast("int") + 2, F.length("told")))
    again = F.when(F.col("role") == "user", F.substring(F.col("told"), F.lit(5), F.length("told"))).otherwise(slip)
    retold = rows.select("rec", (F.col("id") + 100_000).alias("id"), "role", (F.col("e") + 5_000).alias("s"), (F.col("e") * 2 - F.col("s") + 5_000).alias("e"), again.alias("told"))
    return rows.unionByName(retold).drop("role")


@query()
def near_retellings(spark, d):
    """Events that tell almost the same a short time apart."""
    return similar.near_retellings(tellings(spark, d), WIDTH // 10)


@query()
def story_pairs(spark, d):
    """Events of one story: rows joined to the next, their retellings, by overlap or by what they tell."""
    events = tellings(spark, d).withColumn("start_id", F.col("id") % 100_000)
    events = events.withColumns({"end_id": F.col("start_id") + 1, "e": F.col("e") + (F.col("e") - F.col("s")) / 2}).withColumn("e", F.col("e").cast("long"))
    return similar.story_pairs(events, WIDTH // 10)


@query()
def repeat_references(spark, d):
    """Whether each row is told again, nearly, by the row before or the second after it."""
    rows = sentences(spark, d).withColumn("plain", tx.normalized("text"))
    decisions = rows.select("rec", "id", F.col("plain").alias("quote"), F.array("id").alias("own"), F.array(F.col("id") - 1, F.col("id") + 2).alias("reference_ids"))
    return similar.repeat_references(decisions, rows.select("rec", "id", "plain"))


def spans(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Each row of conversations as an event of one to four rows, what it rests on (its own row; assistants' are payoffs), and the rows."""
    rows = sentences(spark, d)
    last = rows.groupBy("rec").agg(F.max("id").alias("last"))
    events = rows.join(last, "rec").withColumn("end_id", F.least(F.col("id") + F.length("text") % 4, "last"))
    ends = rows.select("rec", F.col("id").alias("end_id"), F.col("e").alias("end"))
    events = events.drop("e").join(ends, ["rec", "end_id"]).select(
        "rec", "id", "s", F.col("end").alias("e"), F.col("id").alias("start_id"), "end_id", (F.length("text") % 20 + 80).alias("score"), (F.col("role") == "system").alias("unfinished"))
    evidence = rows.select("rec", "id", F.col("id").alias("row"), F.col("text").alias("quote"), F.when(F.col("role") == "assistant", consolidation.PAYOFF).otherwise("setup").alias("role"))
    return events, evidence, rows


_CLOSURE = f"""{SENTENCES}, last AS (SELECT rec, max(id) AS last FROM sentences GROUP BY rec),
x0 AS (SELECT s.rec, s.id, s.s, s.id AS start_id, least(s.id + length(s.text) % 4, last) AS end_id, length(s.text) % 20 + 80 AS score, s.role = 'system' AS unfinished, s.role = 'assistant' AS payoff FROM sentences s JOIN last USING (rec)),
x AS (SELECT x0.*, t.e FROM x0 JOIN sentences t ON t.rec = x0.rec AND t.id = x0.end_id),
edges AS (SELECT a.rec, a.id AS a, b.id AS b FROM x a JOIN x b ON a.rec = b.rec AND a.id <> b.id AND (
  100 * (least(a.e, b.e) - greatest(a.s, b.s)) >= 50 * least(a.e - a.s, b.e - b.s)
  OR 100 * greatest(0, least(a.end_id, b.end_id) - greatest(a.start_id, b.start_id) + 1) >= 50 * (least(a.end_id - a.start_id, b.end_id - b.start_id) + 1))),
reach AS (SELECT rec, id, id AS other FROM x UNION SELECT r.rec, r.id, w.b FROM reach r JOIN edges w ON r.rec = w.rec AND r.other = w.a),
comp AS (SELECT rec, id, min(other) AS component FROM reach GROUP BY rec, id),
g AS (SELECT x.*, component, count(*) OVER p AS members, max(score) OVER p AS top, bool_or(unfinished) OVER p AS open, row_number() OVER (PARTITION BY x.rec, component ORDER BY e - s DESC, score DESC, x.id) AS place
  FROM x JOIN comp ON x.rec = comp.rec AND x.id = comp.id WINDOW p AS (PARTITION BY x.rec, component)),
grow AS (SELECT rec, component, s, e, start_id, end_id, end_id - start_id + 1 AS n FROM g WHERE place = 1 AND members > 1
  UNION SELECT w.rec, w.component, least(w.s, min(g.s)), greatest(w.e, max(g.e)), least(w.start_id, min(g.start_id)), greatest(w.end_id, max(g.end_id)), w.n FROM grow w JOIN g ON g.rec = w.rec AND g.component = w.component AND (
  2 * (least(g.e, w.e) - greatest(g.s, w.s)) >= least(g.e - g.s, w.e - w.s) OR 2 * (least(g.end_id, w.end_id) - greatest(g.start_id, w.start_id) + 1) >= least(g.end_id - g.start_id + 1, w.n)) GROUP BY w.rec, w.component, w.s, w.e, w.start_id, w.end_id, w.n),
wide AS (SELECT rec, component, min(s) AS s, max(e) AS e, min(start_id) AS start_id, max(end_id) AS end_id FROM grow GROUP BY rec, component),
paid AS (SELECT w.*, chosen.id AS chosen, chosen.top, chosen.open, EXISTS (FROM g WHERE g.rec = w.rec AND g.component = w.component AND g.payoff AND g.start_id BETWEEN w.start_id AND w.end_id) AS merged,
  EXISTS (FROM g WHERE g.rec = w.rec AND g.component = w.component AND place > 1 AND (2 * (least(g.e, w.e) - greatest(g.s, w.s)) >= g.e - g.s OR 2 * (least(g.end_id, w.end_id) - greatest(g.start_id, w.start_id) + 1) >= least(g.end_id - g.start_id, chosen.end_id - chosen.start_id) + 1)) AS absorbed
  FROM wide w JOIN g chosen ON chosen.rec = w.rec AND chosen.component = w.component AND place = 1),
survivors AS (SELECT rec, chosen AS id, s, e, start_id, end_id, top AS score, open AS unfinished, CASE WHEN absorbed THEN 'overlapping' ELSE 'near_duplicate' END AS method, true AS paid FROM paid WHERE merged
  UNION ALL SELECT g.rec, g.id, g.s, g.e, g.start_id, g.end_id, g.score, g.unfinished, CASE WHEN members > 1 THEN 'refused' END, payoff FROM g LEFT JOIN paid p ON p.rec = g.rec AND p.component = g.component WHERE NOT coalesce(merged, false)),
first AS (SELECT g.rec, g.id, CASE WHEN coalesce(merged, false) THEN chosen ELSE g.id END AS into_id FROM g LEFT JOIN paid p ON p.rec = g.rec AND p.component = g.component),
flags AS (SELECT *, CASE WHEN start_id <= max(end_id) OVER (PARTITION BY rec ORDER BY start_id, end_id, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM survivors),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY rec ORDER BY start_id, end_id, id) AS run FROM flags),
decided AS (SELECT rec, id, paid, count(*) OVER p AS n, first_value(id) OVER (PARTITION BY rec, run ORDER BY paid DESC, score DESC, e - s DESC, id) AS best FROM runs WINDOW p AS (PARTITION BY rec, run)),
lineage AS (SELECT f.rec, f.id, CASE WHEN n = 1 THEN into_id WHEN paid OR into_id = best THEN best END AS into_id, CASE WHEN n > 1 AND NOT paid AND into_id <> best THEN 'no payoff of its own' END AS reason FROM first f JOIN decided d ON d.rec = f.rec AND d.id = f.into_id)"""


@query(f"WITH RECURSIVE {_CLOSURE} SELECT rec, id, s, e, start_id, end_id, score, unfinished, method FROM survivors")
def story_closure(spark, d):
    """Events of one story as the span they grow to, or as they were where no payoff lies in it."""
    events, evidence, rows = spans(spark, d)
    return consolidation.merge_windows(events, similar.same_story(events, WIDTH // 10), evidence, rows, WIDTH // 10).survivors


def consolidated(spark: SparkSession, d: str) -> consolidation.Merged:
    events, evidence, rows = spans(spark, d)
    return consolidation.consolidate(events, evidence, rows, WIDTH // 10)


@query(f'WITH RECURSIVE {_CLOSURE} SELECT rec, id, into_id AS "into", reason FROM lineage')
def story_lineage(spark, d):
    """Where each event went after all rounds of merging and deciding, or why it was rejected."""
    return consolidated(spark, d).lineage


@query(f'WITH RECURSIVE {_CLOSURE} SELECT rec, into_id AS "into", count(*) AS n, string_agg(CAST(id AS VARCHAR), \',\' ORDER BY id) AS ids FROM lineage WHERE into_id IS NOT NULL GROUP BY rec, into_id')
def story_members(spark, d):
    """The exact originals of every event that is left."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda i: i.cast("string")), ",")
    return consolidation.members(consolidated(spark, d).lineage).groupBy("rec", "into").agg(F.count(F.lit(1)).alias("n"), ids.alias("ids"))
