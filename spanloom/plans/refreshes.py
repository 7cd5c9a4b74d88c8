"""Registered queries: the ledger after the kept ranges were adjusted by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ledger
from .catalogue import query
from .views import CANDIDATES, EV, WIDTH, candidates, ev


def _snapped(df: DataFrame) -> DataFrame:
    """On hundredths of a second, so that no piece is as short as the tolerance."""
    return df.withColumns({"s": F.floor(F.col("s") / 10) * 10, "e": F.floor(F.col("e") / 10) * 10 + 10})


def refreshed(spark: SparkSession, d: str) -> ledger.Refreshed:
    """Candidates, of which the suggested ones count as restored, against views as the ranges to keep."""
    events = _snapped(ev(spark, d).select("rec", "kind", "s", "e"))
    clips = events.groupBy("rec").agg(F.min("s").alias("lo"), F.max("e").alias("hi"))
    rows = _snapped(candidates(spark, d).select("rec", "id", F.col("id").alias("at"), "s", "e", "status", "reason"))
    rows = rows.withColumn("status", F.when(F.col("status") == "suggested", "restored").otherwise(F.col("status")))
    return ledger.refresh(rows, events.where("kind = 'view'").select("rec", "s", "e"), clips, ["rec"], WIDTH, manual=True)


_REFRESHED = f"""{EV}, {CANDIDATES}, x AS (SELECT rec, id, s // 10 * 10 AS s, e // 10 * 10 + 10 AS e, CASE status WHEN 'suggested' THEN 'restored' ELSE status END AS was, reason FROM candidates),
c AS (SELECT rec, min(s) // 10 * 10 AS lo, max(e) // 10 * 10 + 10 AS hi FROM ev GROUP BY rec),
every AS (SELECT rec, s // 10 * 10 AS s, e // 10 * 10 + 10 AS e FROM ev WHERE kind = 'view' UNION ALL SELECT rec, lo, lo FROM c UNION ALL SELECT rec, hi, hi FROM c),
g AS (SELECT rec, max(e) OVER (PARTITION BY rec ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s, s AS e FROM every),
d AS (SELECT rec, s, e FROM g WHERE e - s > 2),
met AS (SELECT x.id, x.rec, d.s AS region, greatest(x.s, d.s) AS s, least(x.e, d.e) AS e FROM x JOIN d ON x.rec = d.rec AND least(x.e, d.e) - greatest(x.s, d.s) > 2),
f AS (SELECT id, sum(e - s) AS cut FROM met GROUP BY id),
items AS (SELECT x.*, CASE WHEN was = 'restored' AND cut > 0 THEN 'applied' WHEN was = 'applied' AND cut IS NULL THEN 'restored' ELSE was END AS status, cut FROM x LEFT JOIN f ON f.id = x.id),
ex AS (SELECT met.*, was, reason FROM met JOIN items ON items.id = met.id WHERE status = 'applied'),
inside AS (SELECT rec, region, s, e FROM ex UNION ALL SELECT rec, s, s, s FROM d UNION ALL SELECT rec, s, e, e FROM d),
gaps AS (SELECT rec, region, max(e) OVER (PARTITION BY rec, region ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s, s AS e FROM inside),
made AS (SELECT rec, region, 'manual:' || s || ':' || e AS id, s, e FROM gaps WHERE e - s > 2)"""


@query(f"""WITH {_REFRESHED}
SELECT rec, CAST(id AS VARCHAR) AS id, s, e, was, status, CASE WHEN was = 'restored' AND status = 'applied' THEN 'manual' END AS decision,
CASE WHEN was = 'restored' AND status = 'applied' THEN concat_ws('; ', '{ledger.MANUAL}', reason) ELSE reason END AS reason, CAST(CASE WHEN status = 'applied' THEN cut ELSE 0 END AS BIGINT) AS effective FROM items
UNION ALL SELECT rec, id, s, e, NULL, 'applied', 'manual', '{ledger.MANUAL}', e - s FROM made""")
def ledger_flips(spark, d):
    """Each row of the ledger with its status before and after, and the rows made for cuts that nobody recorded."""
    return refreshed(spark, d).items.drop("at")


@query(f"""WITH {_REFRESHED}, told AS (SELECT rec, region, count(*) AS n, count(DISTINCT id) AS ids, min(id) AS low_id FROM (SELECT rec, region, CAST(id AS VARCHAR) AS id FROM ex UNION ALL SELECT rec, region, id FROM made) GROUP BY rec, region)
SELECT d.rec, d.s, d.e, n AS contributors, ids AS distinct_ids, low_id FROM d JOIN told ON told.rec = d.rec AND told.region = d.s""")
def cut_contributors(spark, d):
    """Each cut with how many rows it is owed to; none is without."""
    regions = refreshed(spark, d).regions
    return regions.select("rec", "s", "e", F.size("ids").cast("long").alias("contributors"), F.size(F.array_distinct("ids")).cast("long").alias("distinct_ids"), F.array_min("ids").alias("low_id"))


@query(f"""WITH {_REFRESHED}, every_item AS (SELECT rec, status FROM items UNION ALL SELECT rec, 'applied' FROM made),
n AS (SELECT rec, count(*) AS suggested, count(*) FILTER (WHERE status = 'blocked') AS blocked, count(*) FILTER (WHERE status = 'applied') AS applied FROM every_item GROUP BY rec), r AS (SELECT rec, sum(e - s) AS removed FROM d GROUP BY rec)
SELECT c.rec, hi - lo AS source, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(hi - lo - coalesce(removed, 0) AS BIGINT) AS output, coalesce(suggested, 0) AS suggested, coalesce(blocked, 0) AS blocked, coalesce(applied, 0) AS applied
FROM c LEFT JOIN r ON r.rec = c.rec LEFT JOIN n ON n.rec = c.rec""")
def ledger_balance(spark, d):
    """Per recording: what was there, what is cut and left, and the ledger's counts."""
    return refreshed(spark, d).totals
