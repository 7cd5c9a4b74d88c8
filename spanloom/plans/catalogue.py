"""Registered queries, each with its DuckDB counterpart where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import intervals as iv
from ..operators import graph, rules, sequential, storage
from ..sources import timed_text
from ..streaming import state
from .views import CANDIDATES, CHAT, CLIPS, EV, PROPOSALS, SENTENCES, WIDTH, WORDS, candidates, chat, clips, ev, islands, proposals, read, sentences, words

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function under its name, with the SQL that gives the same rows."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a ledger of cuts leaves of each recording."""
    return ledger_refresh(spark, sf_dir)


# ---- intervals ----


@query(f"WITH {EV}, {islands('ev', 'u')} SELECT rec, s, e FROM u")
def iv_union(spark, d):
    return iv.union(ev(spark, d), ["rec"], slice_ms=24 * 3_600_000)


@query(f"""WITH {EV}, {CLIPS}, v AS (SELECT rec, s, e FROM ev WHERE kind = 'view'), inside AS (
  SELECT v.rec, greatest(s, lo) AS s, least(e, hi) AS e FROM v JOIN clips c ON v.rec = c.rec WHERE e > lo AND s < hi
  UNION ALL SELECT rec, lo, lo FROM clips UNION ALL SELECT rec, hi, hi FROM clips
), gaps AS (SELECT rec, max(e) OVER (PARTITION BY rec ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s, s AS e FROM inside)
SELECT rec, s, e FROM gaps WHERE e - s > 0""")
def iv_complement(spark, d):
    return iv.complement(ev(spark, d, "view"), clips(spark, d), ["rec"])


@query(f"""WITH RECURSIVE {EV}, r AS (SELECT id, rec, s, e FROM ev WHERE kind = 'view'), c0 AS (SELECT rec, s, e FROM ev WHERE kind = 'click'),
c AS (SELECT r.id, row_number() OVER (PARTITION BY r.id ORDER BY c0.s, c0.e) AS k, c0.s, c0.e FROM r JOIN c0 ON r.rec = c0.rec AND least(r.e, c0.e) - greatest(r.s, c0.s) > 2), n AS (SELECT r.id, r.rec, count(c.id) AS n FROM r LEFT JOIN c ON c.id = r.id GROUP BY r.id, r.rec),
p(id, k, s, e) AS (SELECT id, 0, s, e FROM r UNION ALL
  SELECT p.id, p.k + 1, CASE WHEN least(p.e, c.e) - greatest(p.s, c.s) > 2 AND side = 1 THEN c.e ELSE p.s END, CASE WHEN least(p.e, c.e) - greatest(p.s, c.s) > 2 AND side = 0 THEN c.s ELSE p.e END
  FROM p JOIN c ON c.id = p.id AND c.k = p.k + 1 CROSS JOIN (VALUES (0), (1)) v(side)
  WHERE CASE WHEN least(p.e, c.e) - greatest(p.s, c.s) > 2 THEN (side = 0 AND c.s - p.s > 2) OR (side = 1 AND p.e - c.e > 2) ELSE side = 0 END)
SELECT n.rec, p.id, p.s, p.e FROM p JOIN n ON n.id = p.id AND p.k = n.n""")
def iv_subtract(spark, d):
    return iv.subtract(ev(spark, d, "view").select("rec", "id", "s", "e"), ev(spark, d, "click").select("rec", "s", "e"), ["rec"], WIDTH)


@query(f"""WITH {EV} SELECT a.rec, a.id, b.id AS other, greatest(a.s, b.s) AS s, least(a.e, b.e) AS e
FROM ev a JOIN ev b ON a.rec = b.rec AND a.kind = 'view' AND b.kind = 'click' AND least(a.e, b.e) - greatest(a.s, b.s) > 2""")
def iv_intersections(spark, d):
    right = ev(spark, d, "click").select("rec", F.col("id").alias("other"), "s", "e")
    return iv.intersections(ev(spark, d, "view").select("rec", "id", "s", "e"), right, ["rec"], WIDTH)


_SEMI = "SELECT a.id, a.rec, a.s, a.e FROM ev a WHERE a.kind = 'view' AND {} EXISTS (SELECT 1 FROM ev b WHERE b.kind = 'click' AND b.rec = a.rec AND least(a.e, b.e) - greatest(a.s, b.s) > 2)"


@query(f"WITH {EV} {_SEMI.format('')}")
def iv_semi(spark, d):
    return iv.semi(ev(spark, d, "view").select("id", "rec", "s", "e"), ev(spark, d, "click"), ["rec"], "id", WIDTH)


@query(f"WITH {EV} {_SEMI.format('NOT')}")
def iv_anti(spark, d):
    return iv.anti(ev(spark, d, "view").select("id", "rec", "s", "e"), ev(spark, d, "click"), ["rec"], "id", WIDTH)


_IOU = f"""{EV}, m AS (
  SELECT a.rec, a.id AS clip, b.id AS truth, least(a.e, b.e) - greatest(a.s, b.s) AS common, greatest(a.e, b.e) - least(a.s, b.s) AS span, abs(a.s - b.s) AS start_error
  FROM ev a JOIN ev b ON a.rec = b.rec AND a.kind = 'view' AND b.kind = 'click' AND least(a.e, b.e) > greatest(a.s, b.s)
  WHERE 100 * (least(a.e, b.e) - greatest(a.s, b.s)) >= 50 * (greatest(a.e, b.e) - least(a.s, b.s))
)"""


def _iou(spark, d):
    clip = ev(spark, d, "view").select("rec", F.col("id").alias("clip"), "s", "e")
    return iv.iou_join(clip, ev(spark, d, "click").select("rec", F.col("id").alias("truth"), "s", "e"), ["rec"], WIDTH)


@query(f"WITH {_IOU} SELECT rec, clip, truth, common, span FROM m")
def iv_iou_match(spark, d):
    return _iou(spark, d).select("rec", "clip", "truth", "common", "span")


@query(f"""WITH {_IOU} SELECT (SELECT count(*) FROM ev WHERE kind = 'click') - (SELECT count(DISTINCT truth) FROM m) AS missed,
(SELECT count(*) FROM ev WHERE kind = 'view') - (SELECT count(DISTINCT clip) FROM m) AS false_positives,
CAST((SELECT coalesce(sum(n - 1), 0) FROM (SELECT count(*) AS n FROM m GROUP BY truth)) AS BIGINT) AS duplicates""")
def selection_metrics(spark, d):
    return rules.selection_metrics(ev(spark, d, "click"), ev(spark, d, "view"), ["rec"], WIDTH)


@query(f"""WITH {EV}, p AS (SELECT rec, s, e FROM ev WHERE kind = 'purchase'), k AS (SELECT rec, s, e FROM ev WHERE kind = 'view'), {islands('p', 'pu')}, {islands('k', 'ku')},
c AS (SELECT a.rec, sum(least(a.e, b.e) - greatest(a.s, b.s)) AS n FROM pu a JOIN ku b ON a.rec = b.rec AND least(a.e, b.e) > greatest(a.s, b.s) GROUP BY a.rec),
x AS (SELECT rec, sum(e - s) AS n FROM pu GROUP BY rec), y AS (SELECT rec, sum(e - s) AS n FROM k GROUP BY rec), z AS (SELECT rec, sum(e - s) AS n FROM ku GROUP BY rec)
SELECT coalesce(x.rec, y.rec) AS rec, CAST(coalesce(x.n, 0) - coalesce(c.n, 0) AS BIGINT) AS lost, CAST(coalesce(y.n, 0) - coalesce(z.n, 0) AS BIGINT) AS doubled
FROM x FULL JOIN y ON x.rec = y.rec LEFT JOIN z ON z.rec = coalesce(x.rec, y.rec) LEFT JOIN c ON c.rec = coalesce(x.rec, y.rec)""")
def protected_loss(spark, d):
    return rules.protected_loss(ev(spark, d, "purchase").select("rec", "s", "e"), ev(spark, d, "view").select("rec", "s", "e"), ["rec"], WIDTH)


_ORD = "SELECT rec, row_number() OVER (PARTITION BY rec ORDER BY s, id) AS n, s, e FROM ev WHERE kind = '{}'"


@query(f"""WITH {EV}, a AS ({_ORD.format('click')}), b AS ({_ORD.format('view')})
SELECT count(*) FILTER (WHERE a.s IS NOT NULL AND b.s IS NOT NULL) AS common, count(*) FILTER (WHERE b.s IS NULL) AS missing, count(*) FILTER (WHERE a.s IS NULL) AS unexpected,
max(greatest(abs(a.s - b.s), abs(a.e - b.e))) FILTER (WHERE a.s IS NOT NULL AND b.s IS NOT NULL) AS max_error FROM a FULL JOIN b ON a.rec = b.rec AND a.n = b.n""")
def caption_full_outer(spark, d):
    place = lambda k: ev(spark, d, k).select("rec", F.row_number().over(Window.partitionBy("rec").orderBy("s", "id")).alias("n"), "s", "e")
    return rules.caption_report(place("click"), place("view"), ["rec", "n"])


@query(f"""WITH {_IOU}, t AS (SELECT id, rec % 5 AS category, id IN (SELECT truth FROM m) AS hit FROM ev WHERE kind = 'click')
SELECT category, count(*) AS truths, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit) AS missed, 1000 * count(*) FILTER (WHERE hit) // count(*) AS hit_permille
FROM t GROUP BY ROLLUP (category)""")
def listening_rollup(spark, d):
    hit = _iou(spark, d).select(F.col("truth").alias("id"), F.lit(True).alias("hit")).distinct()
    rows = ev(spark, d, "click").select("id", (F.col("rec") % 5).alias("category")).join(hit, "id", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    n, hits = F.count(F.lit(1)), F.count_if("hit")
    return rows.rollup("category").agg(n.alias("truths"), hits.alias("hits"), F.count_if(~F.col("hit")).alias("missed"), F.floor(1000 * hits / n).cast("long").alias("hit_permille"))


@query(f"WITH {_IOU} SELECT quantile_disc(start_error, 0.5) AS p50, quantile_disc(start_error, 0.95) AS p95, median(start_error) AS median FROM m")
def boundary_percentiles(spark, d):
    error = _iou(spark, d).select(F.abs(F.col("s") - F.col("s2")).alias("error"))
    disc = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY error)")
    return error.agg(disc(0.5).alias("p50"), disc(0.95).alias("p95"), F.median("error").alias("median"))


@query()
def greedy_match(spark, d):
    pairs = _iou(spark, d).select("rec", (F.col("common") / (F.col("e2") - F.col("s2"))).alias("ratio"), F.col("clip").alias("cut"), F.col("truth").alias("gold"))
    return sequential.greedy_match(pairs)


@query()
def greedy_nms(spark, d):
    return sequential.greedy_nms(ev(spark, d).select("rec", "id", "s", "e", F.col("value").cast("double").alias("score")))


# ---- chat ----


@query(f"WITH {CHAT} SELECT time // 15 AS bin, count(*) AS n FROM chat GROUP BY bin")
def chat_activity(spark, d):
    return chat(spark, d).groupBy(F.floor(F.col("time") / 15).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


_REPEATS = "SELECT time // 15 AS bin, text, min(time) AS first, count(*) AS repeats FROM chat GROUP BY bin, text"


def _repeats(spark, d):
    return chat(spark, d).groupBy(F.floor(F.col("time") / 15).alias("bin"), "text").agg(F.min("time").alias("first"), F.count(F.lit(1)).alias("repeats"))


@query(f"WITH {CHAT} {_REPEATS}")
def chat_repeats(spark, d):
    return _repeats(spark, d)


@query(f"""WITH {CHAT}, r AS ({_REPEATS}), p AS (
  SELECT *, (bin // 5760) AS part, row_number() OVER (PARTITION BY bin // 5760 ORDER BY first, text) - 1 AS place, count(*) OVER (PARTITION BY bin // 5760) AS n,
  row_number() OVER (PARTITION BY bin // 5760 ORDER BY repeats DESC, first, text) AS top FROM r
) SELECT part, first, text, repeats FROM p WHERE (place % greatest(1, n // 70) = 0 AND place // greatest(1, n // 70) < 70) OR top <= 23""")
def chat_samples(spark, d):
    """Of each day 70 evenly spread messages and the 23 most repeated."""
    rows = _repeats(spark, d).withColumn("part", F.floor(F.col("bin") / 5760))
    day = Window.partitionBy("part")
    rows = rows.withColumns({"at": F.row_number().over(day.orderBy("first", "text")) - 1, "n": F.count(F.lit(1)).over(day), "top": F.row_number().over(day.orderBy(F.desc("repeats"), "first", "text"))})
    step = F.greatest(F.lit(1), F.floor(F.col("n") / 70))
    return rows.where(((F.col("at") % step == 0) & (F.floor(F.col("at") / step) < 70)) | (F.col("top") <= 23)).select("part", "first", "text", "repeats")


# ---- windows ----

_SESSION = """f AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY rec ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 90000 THEN 0 ELSE 1 END AS new FROM ev),
g AS (SELECT id, rec, s, e, sum(new) OVER (PARTITION BY rec ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS session FROM f)"""


@query(f"WITH {EV}, {_SESSION} SELECT id, rec, CAST(session AS BIGINT) AS session FROM g")
def sessions_gap(spark, d):
    return iv.gap_sessions(ev(spark, d), ["rec"], 90_000).select("id", "rec", "session")


@query(f"WITH {EV}, {_SESSION} SELECT rec, CAST(session AS BIGINT) AS session, min(s) AS s, max(e) AS e, count(*) AS members FROM g GROUP BY rec, session")
def component_bounds(spark, d):
    return iv.gap_sessions(ev(spark, d), ["rec"], 90_000).groupBy("rec", "session").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count(F.lit(1)).alias("members"))


@query()
def transcript_windows(spark, d):
    return sequential.transcript_windows(sentences(spark, d))


@query()
def row_batches(spark, d):
    return sequential.row_batches(sentences(spark, d))


@query()
def cue_groups(spark, d):
    timed = words(spark, d).select("rec", "id", (F.col("id") * 300).alias("s"), (F.col("id") * 300 + 250).alias("e"), F.col("word").alias("text"))
    return sequential.cue_groups(timed)


@query(f"""WITH {SENTENCES}, {PROPOSALS} SELECT p.rec, p.start_id, p.end_id, substring(string_agg(t.text, '' ORDER BY t.id), 1, 1500) AS excerpt
FROM proposals p JOIN sentences t ON t.rec = p.rec AND t.id BETWEEN p.start_id AND p.end_id WHERE p.start_id <= p.end_id GROUP BY p.rec, p.start_id, p.end_id""")
def id_range_excerpt(spark, d):
    return rules.excerpts(proposals(spark, d).where("start_id <= end_id"), sentences(spark, d))


@query(f"""WITH {SENTENCES} SELECT a.rec, a.id, string_agg(substring(b.text, 1, 150), '|' ORDER BY b.id) AS context
FROM sentences a JOIN sentences b ON a.rec = b.rec AND b.id BETWEEN a.id - 2 AND a.id + 2 GROUP BY a.rec, a.id""")
def neighbor_context(spark, d):
    near = Window.partitionBy("rec").orderBy("id").rowsBetween(-2, 2)
    return sentences(spark, d).select("rec", "id", F.array_join(F.collect_list(F.substring("text", 1, 150)).over(near), "|").alias("context"))


@query(f"""WITH {SENTENCES}, {PROPOSALS}, w AS (SELECT DISTINCT p.rec, p.start_id, p.end_id, t.id FROM proposals p JOIN sentences t ON t.rec = p.rec
  AND ((t.id >= p.start_id - 12 AND t.id < p.start_id + 14) OR (t.id >= p.end_id - 14 AND t.id < p.end_id + 12)) WHERE p.start_id <= p.end_id)
SELECT rec, start_id, end_id, count(*) AS n_rows, min(id) AS first_id, max(id) AS last_id FROM w GROUP BY rec, start_id, end_id""")
def boundary_context(spark, d):
    span = lambda c, lo, hi: F.sequence(F.col(c) - lo, F.col(c) + hi - 1)
    ids = F.array_distinct(F.concat(span("start_id", 12, 14), span("end_id", 14, 12)))
    wanted = proposals(spark, d).where("start_id <= end_id").select("rec", "start_id", "end_id", F.explode(ids).alias("id"))
    return wanted.join(sentences(spark, d).select("rec", "id"), ["rec", "id"]).groupBy("rec", "start_id", "end_id").agg(F.count(F.lit(1)).alias("n_rows"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


_KEPT = """kept AS (SELECT rec, id AS kept_id, s, e, coalesce(sum(e - s) OVER (PARTITION BY rec ORDER BY s, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM sentences WHERE id % 3 <> 0)"""


def _kept(spark, d):
    rows = sentences(spark, d).where("id % 3 <> 0").select("rec", F.col("id").alias("kept_id"), "s", "e")
    return iv.running_offset(rows, ["rec"], ["s", "kept_id"])


@query(f"WITH {SENTENCES}, {_KEPT} SELECT rec, kept_id, s, e, CAST(off AS BIGINT) AS \"offset\" FROM kept")
def running_offset(spark, d):
    return _kept(spark, d)


def _shifted(spark, d):
    """Rows that begin within one sentence and end within the next."""
    return sentences(spark, d).select("rec", "id", (F.col("s") + 100).alias("s"), (F.col("e") + 400).alias("e"))


_OUT = "out_clock AS (SELECT a.rec, a.id, k.kept_id, CAST(greatest(a.s + 100, k.s) - k.s + k.off AS BIGINT) AS s, CAST(least(a.e + 400, k.e) - k.s + k.off AS BIGINT) AS e FROM sentences a JOIN kept k ON a.rec = k.rec AND least(a.e + 400, k.e) - greatest(a.s + 100, k.s) > 2)"


@query(f"WITH {SENTENCES}, {_KEPT}, {_OUT} SELECT rec, id, kept_id, s, e FROM out_clock")
def output_clock_remap(spark, d):
    return iv.to_output(_shifted(spark, d), _kept(spark, d), ["rec"], WIDTH // 60)


@query(f"""WITH {SENTENCES}, {_KEPT}, {_OUT} SELECT o.rec, o.id, o.kept_id AS cue_of, k.kept_id, CAST(greatest(o.s, k.off) - k.off + k.s AS BIGINT) AS s, CAST(least(o.e, k.off + k.e - k.s) - k.off + k.s AS BIGINT) AS e
FROM out_clock o JOIN kept k ON o.rec = k.rec AND least(o.e, k.off + k.e - k.s) - greatest(o.s, k.off) > 2""")
def inverse_remap(spark, d):
    cues = output_clock_remap(spark, d).withColumnRenamed("kept_id", "cue_of")
    return iv.to_source(cues, _kept(spark, d), ["rec"], WIDTH // 60)


# ---- candidates and validators ----


@query(f"""WITH {EV}, g AS (SELECT rec, id, max(e) OVER (PARTITION BY rec ORDER BY s, e, id ROWS UNBOUNDED PRECEDING) AS lo, lead(s) OVER (PARTITION BY rec ORDER BY s, e, id) AS hi FROM ev)
SELECT rec, id, lo + 500 AS s, hi - 500 AS e FROM g WHERE hi - lo >= 2000 AND hi - lo - 1000 >= 500""")
def gap_candidates(spark, d):
    return rules.gap_candidates(ev(spark, d))


_AHEAD = " ".join(f"WHEN {' AND '.join(f'a{i} = a{i + w}' for i in range(w))} THEN {w}" for w in (4, 3, 2, 1))


@query(f"""WITH {SENTENCES}, {WORDS}, a AS (SELECT rec, id, {', '.join(f'lead(word, {k}) OVER (PARTITION BY rec ORDER BY id) AS a{k}' for k in range(8))} FROM words)
SELECT * FROM (SELECT rec, id, CASE {_AHEAD} END AS width FROM a) WHERE width IS NOT NULL""")
def tandem_repeats(spark, d):
    return rules.tandem_repeats(words(spark, d))


@query(f"WITH {SENTENCES}, {WORDS} SELECT rec, id, word FROM words WHERE regexp_full_match(word, '(the|and|of|la|el|en)[.,]?')")
def fillers(spark, d):
    return words(spark, d).where(F.col("word").rlike("^(the|and|of|la|el|en)[.,]?$"))


@query()
def lexical_neighbors(spark, d):
    rows = sentences(spark, d).select("rec", "id", tx.normalized("text").alias("text"))
    return rules.lexical_neighbors(rows, tx.similarity("a", "b"))


@query(f"""WITH {SENTENCES}, {PROPOSALS}, b AS (SELECT rec, min(s) AS lo, max(e) AS hi FROM sentences GROUP BY rec)
SELECT p.rec, p.start_id, p.end_id, greatest(x.s - 150, lo) AS s, least(y.e + 200, hi) AS e, least(greatest(coalesce(score, 60.0), 0.0), 100.0) AS score
FROM proposals p JOIN sentences x ON x.rec = p.rec AND x.id = p.start_id JOIN sentences y ON y.rec = p.rec AND y.id = p.end_id JOIN b ON b.rec = p.rec
WHERE p.start_id <= p.end_id AND y.e - x.s BETWEEN 5000 AND 60000""")
def candidate_validation(spark, d):
    return rules.validate_candidates(proposals(spark, d), sentences(spark, d), 5_000, 60_000)


@query("""WITH w AS (SELECT DISTINCT doc_id FROM documents), g AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id FROM labels UNION ALL SELECT doc_id FROM labels WHERE quality = 0) GROUP BY doc_id)
SELECT coalesce(w.doc_id, g.doc_id) AS doc_id, CASE WHEN g.doc_id IS NULL THEN 'missing' WHEN w.doc_id IS NULL THEN 'unknown' ELSE 'repeated' END AS rule
FROM w FULL JOIN g ON w.doc_id = g.doc_id WHERE g.doc_id IS NULL OR w.doc_id IS NULL OR g.n > 1""")
def partition_check(spark, d):
    labels = read(spark, d, "labels")
    given = labels.select("doc_id").unionByName(labels.where("quality = 0").select("doc_id"))
    return rules.partition_violations(read(spark, d, "documents").select("doc_id"), given, ["doc_id"])


_QUOTES = "quotes AS (SELECT rec * 1000 + id AS quote_id, rec * 1000 + id + CASE WHEN id % 7 = 0 THEN 1 ELSE 0 END AS id, CASE WHEN id % 4 = 0 THEN upper(substring(text, 3, 12)) ELSE substring(text, 3, 12) END AS quote FROM sentences), rows AS (SELECT rec * 1000 + id AS id, text FROM sentences)"


@query(f"""WITH {SENTENCES}, {_QUOTES} SELECT q.quote_id, q.id, CASE WHEN r.text IS NULL THEN 'unknown_row' ELSE 'not_in_row' END AS rule
FROM quotes q LEFT JOIN rows r ON q.id = r.id WHERE r.text IS NULL OR NOT contains(r.text, q.quote)""")
def quote_violations(spark, d):
    rows = sentences(spark, d).select((F.col("rec") * 1000 + F.col("id")).alias("row"), "id", "text")
    cut = F.substring("text", 3, 12)
    quotes = rows.select(F.col("row").alias("quote_id"), (F.col("row") + F.when(F.col("id") % 7 == 0, 1).otherwise(0)).alias("id"), F.when(F.col("id") % 4 == 0, F.upper(cut)).otherwise(cut).alias("quote"))
    return rules.quote_violations(quotes, rows.select(F.col("row").alias("id"), "text"))


@query("""WITH q AS (SELECT item_id AS quote_id, text AS quote FROM benchmark)
SELECT quote_id, min(doc_id) AS id FROM q JOIN documents ON contains(text, quote) GROUP BY quote_id HAVING count(*) = 1""")
def quote_rebind(spark, d):
    quotes = read(spark, d, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    return rules.rebind_quotes(quotes, read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))


_STORY = f"""{EV}, x AS (SELECT rec, id, s, e, s // 1200000 AS start_id, e // 1200000 AS end_id FROM ev), edges AS (
  SELECT a.rec, a.id AS a, b.id AS b FROM x a JOIN x b ON a.rec = b.rec AND a.id < b.id AND least(a.e, b.e) > greatest(a.s, b.s)
  WHERE 100 * (least(a.e, b.e) - greatest(a.s, b.s)) >= 50 * least(a.e - a.s, b.e - b.s)
     OR 100 * greatest(0, least(a.end_id, b.end_id) - greatest(a.start_id, b.start_id) + 1) >= 50 * (least(a.end_id - a.start_id, b.end_id - b.start_id) + 1)
)"""


def _events(spark, d):
    return ev(spark, d).select("rec", "id", "s", "e", F.floor(F.col("s") / 1_200_000).alias("start_id"), F.floor(F.col("e") / 1_200_000).alias("end_id"))


@query(f"WITH {_STORY} SELECT rec, a, b FROM edges")
def same_story_edges(spark, d):
    return rules.same_story(_events(spark, d), WIDTH)


@query(f"""WITH RECURSIVE {_STORY}, both_ways AS (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges), reach AS (
  SELECT id, id AS other FROM ev UNION SELECT r.id, w.b FROM reach r JOIN both_ways w ON r.other = w.a
) SELECT e.rec, r.id, min(r.other) AS component FROM reach r JOIN ev e ON e.id = r.id GROUP BY e.rec, r.id""")
def story_components(spark, d):
    return graph.components(ev(spark, d).select("rec", "id"), same_story_edges(spark, d))


@query(f"""WITH RECURSIVE {_STORY}, both_ways AS (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges), reach AS (
  SELECT id, id AS other FROM ev UNION SELECT r.id, w.b FROM reach r JOIN both_ways w ON r.other = w.a
), comp AS (SELECT id, min(other) AS component FROM reach GROUP BY id)
SELECT e.rec, c.component, min(e.s) AS s, max(e.e) AS e, count(*) AS members, arg_max(e.id, (e.e - e.s) * 100000000 - e.id) AS best_id FROM comp c JOIN ev e ON e.id = c.id GROUP BY e.rec, c.component HAVING count(*) > 1""")
def window_merge(spark, d):
    rows = iv.sorted_join(story_components(spark, d), ev(spark, d).select("id", "s", "e"), "id")
    best = F.max_by("id", (F.col("e") - F.col("s")) * 100_000_000 - F.col("id"))
    return rows.groupBy("rec", "component").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count(F.lit(1)).alias("members"), best.alias("best_id")).where("members > 1")


# ---- ledger and review ----


@query(f"""WITH {EV}, {CANDIDATES}, {CLIPS}, a AS (SELECT rec, s, e FROM candidates WHERE status = 'applied' AND e - s > 2), {islands('a', 'u', eps=2)},
r AS (SELECT u.rec, sum(least(e, hi) - greatest(s, lo)) AS removed FROM u JOIN clips c ON u.rec = c.rec WHERE least(e, hi) > greatest(s, lo) GROUP BY u.rec),
n AS (SELECT rec, count(*) FILTER (WHERE status = 'applied') AS applied, count(*) FILTER (WHERE status = 'blocked') AS blocked, count(*) FILTER (WHERE status = 'suggested') AS suggested FROM candidates GROUP BY rec)
SELECT c.rec, n.applied, n.blocked, n.suggested, hi - lo AS source, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(hi - lo - coalesce(removed, 0) AS BIGINT) AS output
FROM clips c JOIN n ON n.rec = c.rec LEFT JOIN r ON r.rec = c.rec""")
def ledger_refresh(spark, d):
    return rules.ledger_refresh(candidates(spark, d), clips(spark, d), ["rec"])


def _snapped(df):
    """Times in whole steps of 10 ms, cut towards 0 as the SQL's ``//`` does, so also those before 1970."""
    return df.withColumns({"s": F.expr("s div 10 * 10"), "e": F.expr("e div 10 * 10 + 10")})


@query(f"""WITH {EV}, {CANDIDATES}, x AS (SELECT rec, id, s // 10 * 10 AS s, e // 10 * 10 + 10 AS e, status FROM candidates), k AS (SELECT * FROM x WHERE status = 'suggested'),
t AS (SELECT * FROM x WHERE status = 'blocked'), p AS (SELECT * FROM x WHERE status = 'applied'), inside AS (
  SELECT t.id, t.rec, greatest(t.s, p.s) AS s, least(t.e, p.e) AS e FROM t JOIN p ON t.rec = p.rec AND least(t.e, p.e) > greatest(t.s, p.s)
  UNION ALL SELECT id, rec, s, s FROM t UNION ALL SELECT id, rec, e, e FROM t
), gaps AS (SELECT rec, max(e) OVER (PARTITION BY id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s, s AS e FROM inside),
every AS (SELECT rec, s, e FROM gaps WHERE e - s > 2 UNION ALL SELECT rec, s, e FROM k), {islands('every', 'u', eps=2)} SELECT rec, s, e FROM u""")
def ledger_restore(spark, d):
    rows = _snapped(candidates(spark, d).select("rec", "id", "s", "e", "status"))
    pick = lambda x: rows.where(F.col("status") == x).drop("status")
    return rules.ledger_restore(pick("suggested"), pick("blocked"), pick("applied").drop("id"), ["rec"], WIDTH)


@query(f"""WITH RECURSIVE {EV}, {CANDIDATES}, c AS (SELECT rec, id, s, e FROM candidates WHERE status = 'applied'), k AS (SELECT rec, s, e FROM candidates WHERE status = 'blocked'),
bad AS (SELECT DISTINCT c.rec, c.id, c.s, c.e FROM c JOIN k ON c.rec = k.rec AND least(c.e, k.e) - greatest(c.s, k.s) > 2
  UNION SELECT c.rec, c.id, c.s, c.e FROM c JOIN bad b ON c.rec = b.rec AND least(c.e, b.e) - greatest(c.s, b.s) > 2)
SELECT c.rec, c.id, CASE WHEN c.id IN (SELECT id FROM bad) THEN 'blocked' ELSE 'applied' END AS status FROM c""")
def overlap_fixpoint(spark, d):
    rows = candidates(spark, d)
    return rules.overlap_fixpoint(rows.where("status = 'applied'"), rows.where("status = 'blocked'"), ["rec"])


@query(f"WITH {EV}, {CANDIDATES} SELECT coalesce(nullif(trim(block_reason), ''), nullif(trim(reason), ''), 'unspecified') AS reason, count(*) AS n FROM candidates WHERE status = 'blocked' GROUP BY 1")
def block_reasons(spark, d):
    return rules.block_reasons(candidates(spark, d))


_SHARE = f"""{SENTENCES}, {PROPOSALS}, q AS (SELECT t.rec AS clip, t.s, t.e, t.text, substring(t.text, 1, 60) AS quote, b.lo, b.hi FROM sentences t JOIN (SELECT rec, min(s) AS lo, max(e) - 1000 AS hi FROM sentences GROUP BY rec) b ON b.rec = t.rec WHERE t.role = 'assistant'),
share AS (SELECT clip, CAST(sum(greatest(least(e, hi) - greatest(s, lo), 0) * length(quote) // greatest(length(text), 1)) AS BIGINT) AS quoted_ms, max(hi - lo) AS clip_ms FROM q GROUP BY clip)"""


def _share(spark, d):
    rows = sentences(spark, d)
    box = rows.groupBy("rec").agg(F.min("s").alias("lo"), (F.max("e") - 1000).alias("hi"))
    return rules.quoted_share(rows.where("role = 'assistant'").withColumn("quote", F.substring("text", 1, 60)).join(box, "rec").withColumnRenamed("rec", "clip"))


@query(f"WITH {_SHARE} SELECT clip, quoted_ms, clip_ms FROM share")
def mixed_share(spark, d):
    return _share(spark, d)


@query(f"WITH {_SHARE} SELECT clip, quoted_ms, clip_ms, CASE WHEN quoted_ms >= 10000 AND 100 * quoted_ms >= 20 * clip_ms THEN 'keep' ELSE 'exclude' END AS decision FROM share")
def review_gate(spark, d):
    return rules.mixed_gate(_share(spark, d))


@query(f"""WITH {EV}, p AS (SELECT rec AS clip, e - s AS ms, CASE kind WHEN 'view' THEN 'keep' WHEN 'click' THEN 'keep' WHEN 'purchase' THEN 'hold' ELSE 'exclude' END AS decision FROM ev),
g AS (SELECT clip, coalesce(sum(ms) FILTER (WHERE decision = 'keep'), 0) AS keep_ms, coalesce(sum(ms) FILTER (WHERE decision = 'exclude'), 0) AS exclude_ms, sum(ms) AS ms, bool_or(decision = 'hold') AS held FROM p GROUP BY clip)
SELECT clip, CAST(keep_ms AS BIGINT) AS keep_ms, CAST(exclude_ms AS BIGINT) AS exclude_ms, CASE WHEN 100 * keep_ms >= 75 * ms AND NOT held THEN 'keep' WHEN 100 * exclude_ms >= 75 * ms THEN 'exclude' ELSE 'hold' END AS decision FROM g""")
def segmented_review(spark, d):
    decision = F.when(F.col("kind").isin("view", "click"), "keep").when(F.col("kind") == "purchase", "hold").otherwise("exclude")
    return rules.segmented_gate(ev(spark, d).select(F.col("rec").alias("clip"), (F.col("e") - F.col("s")).alias("ms"), decision.alias("decision")))


# ---- ranking ----


@query(f"WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY rec, kind ORDER BY value DESC, id DESC) AS n FROM ev) SELECT rec, kind, id FROM r WHERE n = 1")
def dedup_last_wins(spark, d):
    return ev(spark, d).groupBy("rec", "kind").agg(F.max(F.struct("value", "id")).alias("top")).select("rec", "kind", "top.id")


@query(f"""WITH {EV}, p AS (SELECT rec, id, value, row_number() OVER (PARTITION BY rec ORDER BY s, id) AS place FROM ev), n AS (
  SELECT a.rec, a.id, b.id AS other, row_number() OVER (PARTITION BY a.rec, a.id ORDER BY abs(a.value - b.value), b.id) AS rank FROM p a JOIN p b ON a.rec = b.rec AND a.place <> b.place AND abs(a.place - b.place) <= 5)
SELECT rec, id, other, rank FROM n WHERE rank <= 3""")
def topk_neighbors(spark, d):
    rows = ev(spark, d).select("rec", "id", "value", F.row_number().over(Window.partitionBy("rec").orderBy("s", "id")).alias("at"))
    other = rows.select("rec", F.col("id").alias("other"), F.col("value").alias("v2"), F.explode(F.array(*[F.col("at") + k for k in range(-5, 6) if k])).alias("at"))
    rank = F.row_number().over(Window.partitionBy("rec", "id").orderBy(F.abs(F.col("value") - F.col("v2")), "other"))
    return rows.join(other, ["rec", "at"]).withColumn("rank", rank).where("rank <= 3").select("rec", "id", "other", "rank")


@query(f"WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY e - s DESC, value DESC, id) AS n FROM ev) SELECT rec, id, e - s AS length FROM r WHERE n = 1")
def best_member(spark, d):
    top = F.max(F.struct((F.col("e") - F.col("s")).alias("length"), "value", (-F.col("id")).alias("back")))
    return ev(spark, d).groupBy("rec").agg(top.alias("top")).select("rec", (-F.col("top.back")).alias("id"), "top.length")


@query(f"""WITH {EV}, r AS (SELECT rec, id, id % 3 <> 0 AS passes, row_number() OVER (PARTITION BY rec ORDER BY value DESC, id) AS n FROM ev),
k AS (SELECT *, count(*) FILTER (WHERE passes) OVER (PARTITION BY rec ORDER BY n ROWS UNBOUNDED PRECEDING) AS kept FROM r WHERE n <= 15) SELECT rec, id, n, kept FROM k WHERE passes AND kept <= 5""")
def budgeted_topk(spark, d):
    """Of each recording's fifteen best the first five that pass."""
    rank = Window.partitionBy("rec").orderBy(F.desc("value"), "id")
    rows = ev(spark, d).select("rec", "id", (F.col("id") % 3 != 0).alias("passes"), F.row_number().over(rank).alias("n")).where("n <= 15")
    kept = F.count_if("passes").over(Window.partitionBy("rec").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("kept", kept).where("passes AND kept <= 5").select("rec", "id", "n", "kept")


# ---- sets ----

_KEYS = ("SELECT DISTINCT o_custkey AS custkey FROM orders WHERE o_orderpriority = '1-URGENT'", "SELECT DISTINCT c_custkey AS custkey FROM customer WHERE c_acctbal > 0")


def _sets(spark, d):
    a = read(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("custkey"))
    return a, read(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("custkey"))


@query(f"{_KEYS[0]} UNION {_KEYS[1]}")
def set_union(spark, d):
    a, b = _sets(spark, d)
    return a.union(b).distinct()


@query(f"{_KEYS[0]} INTERSECT {_KEYS[1]}")
def set_intersect(spark, d):
    a, b = _sets(spark, d)
    return a.intersect(b)


@query(f"{_KEYS[0]} EXCEPT {_KEYS[1]}")
def set_except(spark, d):
    a, b = _sets(spark, d)
    return a.subtract(b)


@query("""WITH f AS (SELECT l_orderkey, l_returnflag, min(l_linenumber) AS first FROM lineitem GROUP BY l_orderkey, l_returnflag)
SELECT l_orderkey, string_agg(l_returnflag, ',' ORDER BY first, l_returnflag) AS flags FROM f GROUP BY l_orderkey""")
def ordered_distinct(spark, d):
    rows = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_returnflag"))).alias("x"))
    return rows.select("l_orderkey", F.array_join(F.array_distinct("x.l_returnflag"), ",").alias("flags"))


# ---- text ----

_SRT = "printf('%02d:%02d:%02d,%03d', {0} // 3600000, {0} // 60000 % 60, {0} // 1000 % 60, {0} % 1000)"


@query(f"""WITH {SENTENCES}, b AS (SELECT rec, s, e, text, row_number() OVER (PARTITION BY rec ORDER BY s, e, text) AS n FROM sentences)
SELECT rec, string_agg(n || chr(10) || {_SRT.format('s')} || ' --> ' || {_SRT.format('e')} || chr(10) || text, chr(10) || chr(10) ORDER BY n) || chr(10) AS srt FROM b GROUP BY rec""")
def srt_render(spark, d):
    return timed_text.render_srt(sentences(spark, d))


@query(f"WITH {EV} SELECT id, (s % 86400000) AS ms FROM ev")
def timestamp_parse(spark, d):
    return ev(spark, d).select("id", tx.parse_time(tx.srt_time(F.col("s") % 86_400_000)).alias("ms"))


@query("SELECT doc_id, md5(lower(regexp_replace(text, '[^\\p{L}\\p{N}]+', '', 'g'))) AS norm FROM documents")
def text_normalize(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(tx.letters_and_digits(F.col("text"))).alias("norm"))


@query("""SELECT page_id, coalesce(nullif(substring(trim(regexp_replace(url, '[<>:"/\\\\|?*\\x00-\\x1f]', '_', 'g'), ' .'), 1, 60), ''), 'untitled') AS name FROM pages""")
def safe_name(spark, d):
    return read(spark, d, "pages").select("page_id", tx.safe_name(F.col("url")).alias("name"))


@query("SELECT page_id, md5(regexp_replace(html, '<[^>]+>', '', 'g')) AS text_md5 FROM pages")
def tag_strip(spark, d):
    return read(spark, d, "pages").select("page_id", F.md5(tx.strip_tags(F.col("html"))).alias("text_md5"))


@query("SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.time') AS BIGINT), TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)) AS k FROM events")
def json_extract_coalesce(spark, d):
    value = lambda k: F.get_json_object("props", f"$.{k}").try_cast("long")
    return read(spark, d, "events").select("event_id", F.coalesce(value("time"), value("k")).alias("k"))


@query("SELECT event_id, coalesce(json_type(json_extract(props, '$.k')) IN ('UBIGINT', 'BIGINT'), false) AS whole FROM events")
def json_type_strict(spark, d):
    return read(spark, d, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k").rlike("^-?[0-9]+$") & ~F.col("props").rlike('"k": *"'), F.lit(False)).alias("whole"))


# ---- tables ----


@query("""WITH c AS (SELECT o_custkey AS c_custkey, o_totalprice, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM c) UNION ALL SELECT c_custkey, o_totalprice FROM c WHERE n = 1""")
def doc_upsert(spark, d):
    changes = read(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("c_acctbal"), F.col("o_orderkey").alias("ord"))
    return storage.upsert(read(spark, d, "customer").select("c_custkey", "c_acctbal"), changes, "c_custkey")


@query("""WITH t AS (SELECT p_partkey AS id, p_size AS revision, p_name AS payload FROM part), c AS (SELECT l_partkey AS id, CAST(l_quantity AS INT) AS seen, l_orderkey * 10 + l_linenumber AS ord FROM lineitem),
w AS (SELECT c.id, c.seen, min(ord) AS ord FROM c JOIN t ON t.id = c.id AND t.revision = c.seen GROUP BY c.id, c.seen)
SELECT t.id, CASE WHEN w.id IS NULL THEN t.revision ELSE t.revision + 1 END AS revision, CASE WHEN w.id IS NULL THEN t.payload ELSE 'order ' || w.ord END AS payload FROM t LEFT JOIN w ON w.id = t.id""")
def cas_update(spark, d):
    table = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("revision"), F.col("p_name").alias("payload"))
    ord_ = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    changes = read(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_quantity").cast("int").alias("seen"), ord_.alias("ord"), F.concat(F.lit("order "), ord_.cast("string")).alias("payload"))
    return storage.compare_and_swap(table, changes, "id")[0]


@query("""WITH f AS (SELECT doc_id AS id, n_chars AS bytes, doc_id * 7919 % 1000003 AS used, doc_id % 4 = 0 AS protected FROM documents),
b AS (SELECT *, coalesce(sum(bytes) OVER (ORDER BY used, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM f WHERE NOT protected)
SELECT id, bytes FROM b WHERE (SELECT sum(bytes) FROM f) - gone > 1000000""")
def lru_evict(spark, d):
    files = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("bytes"), (F.col("doc_id") * 7919 % 1_000_003).alias("used"), (F.col("doc_id") % 4 == 0).alias("protected"))
    return storage.evict(files, 1_000_000).select("id", "bytes")


@query("SELECT p_partkey AS path FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.08)")
def reference_protect(spark, d):
    used = read(spark, d, "lineitem").where("l_discount > 0.08").select(F.col("l_partkey").alias("path"))
    return storage.deletable(read(spark, d, "part").select(F.col("p_partkey").alias("path")), used)


# ---- signal and state ----


@query("""WITH x AS (SELECT vec_id, unnest(embedding) AS v, unnest(generate_series(0, len(embedding) - 1)) // 16 AS frame FROM embeddings)
SELECT vec_id, frame, CAST(round(avg(CAST(v AS DOUBLE) * v) * 1000000) AS BIGINT) AS energy FROM x GROUP BY vec_id, frame""")
def frame_energy(spark, d):
    rows = read(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("at", "v"))
    v = F.col("v").cast("double")
    return rows.groupBy("vec_id", F.floor(F.col("at") / 16).alias("frame")).agg(F.round(F.avg(v * v) * 1_000_000).cast("long").alias("energy"))


@query()
def open_event_fold(spark, d):
    rows = ev(spark, d).select("rec", F.col("s").alias("ord"), F.col("kind").alias("key"), F.floor(F.col("s") / 60_000).alias("start_id"), F.floor(F.col("e") / 60_000).alias("end_id"), (F.col("id") % 6 == 0).alias("ended"))
    return state.open_events(rows)


@query()
def step_machine(spark, d):
    wanted = F.element_at(F.array(*[F.lit(x) for x in ("running", "done", "failed", "interrupted", "running", "cancelled")]), (F.col("id") % 6 + 1).cast("int"))
    return state.step_machine(ev(spark, d).select("rec", F.col("s").alias("ord"), wanted.alias("state")))


@query()
def thread_policy(spark, d):
    return state.thread_policy(ev(spark, d).select("rec", F.col("s").alias("ord"), (F.col("value").cast("double") * 17 % 100).alias("load")))


# ---- sums over documents ----


@query("SELECT lang, count(*) AS requests, CAST(sum(greatest(n_chars, 0)) AS BIGINT) AS tokens FROM documents GROUP BY lang")
def token_usage(spark, d):
    return read(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("requests"), F.sum(F.greatest("n_chars", F.lit(0))).alias("tokens"))


@query("""SELECT source, count(*) AS checked, count(*) FILTER (WHERE quality = 0) AS excluded, count(*) FILTER (WHERE toxic = 1) AS held, count(*) FILTER (WHERE quality IS NULL) AS unreviewed
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY source""")
def review_summary(spark, d):
    rows = read(spark, d, "documents").select("doc_id", "source").join(read(spark, d, "labels"), "doc_id", "left")
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("checked"), F.count_if(F.col("quality") == 0).alias("excluded"), F.count_if(F.col("toxic") == 1).alias("held"), F.count_if(F.col("quality").isNull()).alias("unreviewed"))
