"""Registered queries: evidence about words and rows, id joins, duration and JSON rules, validators, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import intervals as iv
from ..operators import rules
from ..operators import speech as sp
from .catalogue import query
from .ledgers import ALIGNED, aligned
from .views import CANDIDATES, CHAT, CLIPS, EV, PROPOSALS, SENTENCES, WIDTH, candidates, chat, clips, ev, islands, proposals, read, sentences

#: Tolerance, and how far a word may stand outside its row, in milliseconds.
EPS, PADDING_MS = 2, 120
#: Slack after a window of chat, beside a pause, and beside a clip, in milliseconds.
CHAT_SLACK_S, PAUSE_SLACK_MS, REVIEW_SLACK_MS = 8, 8_000, 12_000
#: What a pause must sound like to be cut, in dBFS and as a ratio.
QUIET_DB, STABLE_DB, STABLE_MAX_DB, STABLE_RATIO, STABLE_SPREAD_DB, FEWEST_FRAMES = -43, -32, -25, 0.32, 6, 5
#: Lengths of titles, reasons, quotes and summaries, most events of a request, most evidence, last step.
TITLE, REASON, PLAN_REASON, QUOTE, SUMMARY, MOST_EVENTS, MOST_EVIDENCE, LAST_STEP = (1, 40), (1, 80), (3, 160), (1, 80), 240, 4, 4, 5


def _first(*pairs: tuple[Column, str]) -> Column:
    """The name of the first condition that holds, else null."""
    out = None
    for condition, name in pairs:
        out = F.when(condition, name) if out is None else out.when(condition, name)
    return out


def _broken(*pairs: tuple[Column, str]) -> Column:
    """A row for each condition that holds."""
    return F.explode(F.array_compact(F.array(*[F.when(c, n) for c, n in pairs])))


# ---- words and rows ----


@query(f"""WITH {EV}, {CLIPS}, x AS (SELECT id, rec, s + (id % 3 - 1) * 900000 AS s, e + (id % 3 - 1) * 900000 AS e FROM ev)
SELECT x.id, x.s >= lo - 2 AND x.e <= hi + 2 AND x.e > x.s AS positioned FROM x JOIN clips c ON c.rec = x.rec""")
def positioned(spark, d):
    """Whether each interval lies inside its recording, but for the tolerance."""
    moved = (F.col("id") % 3 - 1) * 900_000
    rows = ev(spark, d).select("id", "rec", (F.col("s") + moved).alias("s"), (F.col("e") + moved).alias("e")).join(clips(spark, d), "rec")
    return rows.select("id", ((F.col("s") >= F.col("lo") - EPS) & (F.col("e") <= F.col("hi") + EPS) & (F.col("e") > F.col("s"))).alias("positioned"))


_SHIFTED = """w AS (SELECT rec, row, place, word, s - CASE WHEN (row + place) % 11 = 5 THEN 400 ELSE 0 END AS s, e, text FROM aligned),
p AS (SELECT w.*, t.s AS row_s, t.e AS row_e, lag(w.e) OVER (PARTITION BY w.rec, w.row ORDER BY place) AS before FROM w JOIN sentences t ON t.rec = w.rec AND t.id = w.row)"""


def _shifted(spark: SparkSession, d: str) -> DataFrame:
    rows = sentences(spark, d).select("rec", F.col("id").alias("row"), F.col("s").alias("row_s"), F.col("e").alias("row_e"))
    words = aligned(spark, d).withColumn("s", F.col("s") - F.when((F.col("row") + F.col("at")) % 11 == 5, 400).otherwise(0))
    return words.join(rows, ["rec", "row"]).withColumn("before", F.lag("e").over(Window.partitionBy("rec", "row").orderBy("at")))


@query(f"""WITH {SENTENCES}, {ALIGNED}, {_SHIFTED} SELECT rec, row, bool_and(e > s AND s >= coalesce(before, row_s - 120) - 2 AND s >= row_s - 122 AND e <= row_e + 122)
AND string_agg(word, '' ORDER BY place) = replace(any_value(text), ' ', '') AS reliable FROM p GROUP BY rec, row""")
def reliable_rows(spark, d):
    """Rows whose words are in order, inside the row, each once, and together its text."""
    s, e = F.col("s"), F.col("e")
    fits = (e > s) & (s >= F.coalesce("before", F.col("row_s") - PADDING_MS) - EPS) & (s >= F.col("row_s") - PADDING_MS - EPS) & (e <= F.col("row_e") + PADDING_MS + EPS)
    told = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), "")
    found = _shifted(spark, d).groupBy("rec", "row").agg(F.bool_and(fits).alias("fits"), told.alias("told"))
    found = found.join(sentences(spark, d).select("rec", F.col("id").alias("row"), "text"), ["rec", "row"])
    return found.select("rec", "row", (F.col("fits") & (F.col("told") == F.replace("text", F.lit(" "), F.lit("")))).alias("reliable"))


@query(f"""WITH {SENTENCES}, {ALIGNED}, {_SHIFTED} SELECT rec, row, place, CASE WHEN e <= s THEN 'empty' WHEN s < coalesce(before, row_s - 120) - 2 THEN 'backward' WHEN s < row_s - 122 OR e > row_e + 122 THEN 'outside' END AS rule
FROM p WHERE e <= s OR s < coalesce(before, row_s - 120) - 2 OR s < row_s - 122 OR e > row_e + 122""")
def aligned_word_violations(spark, d):
    """Words that have no length, go back or leave their row's window."""
    s, e = F.col("s"), F.col("e")
    rule = _first((e <= s, "empty"), (s < F.coalesce("before", F.col("row_s") - PADDING_MS) - EPS, "backward"), ((s < F.col("row_s") - PADDING_MS - EPS) | (e > F.col("row_e") + PADDING_MS + EPS), "outside"))
    return _shifted(spark, d).select("rec", "row", F.col("at").alias("place"), rule.alias("rule")).where("rule IS NOT NULL")


def emotional(text: Column, emotion: Column, event: Column) -> Column:
    """Whether a row's words, its emotion or its event show emotion, or it is nothing but a reaction; labels count in normal form."""
    return sp.emotional(text, tx.normalized(text), tx.normalized(emotion), tx.normalized(event))


_FELT = """felt AS (SELECT rec, id, s, e, CASE WHEN id % 6 = 1 THEN '嘿嘿！' WHEN id % 4 = 2 THEN text || '哈哈' ELSE text END AS text, CASE WHEN id % 9 = 3 THEN ' Sad' ELSE 'neutral' END AS emotion, CASE WHEN id % 11 = 4 THEN 'Laughter' ELSE 'speech' END AS event FROM sentences),
told AS (SELECT rec, id, s, e, regexp_matches(text, '哭|呜呜|哈哈|呵呵|哽咽|抽泣|心疼|难过|自责|伤心|好疼|好痛') OR regexp_full_match(replace(text, '！', ''), '(哈|呵|呜|嘿|啊|唔){2,}') OR lower(trim(emotion)) IN ('sad', 'angry', 'fearful', 'disgusted') OR lower(trim(event)) IN ('cry', 'crying', 'laugh', 'laughter', 'music', 'singing') AS emotional FROM felt)"""


def _felt(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("id")
    text = F.when(n % 6 == 1, "嘿嘿！").when(n % 4 == 2, F.concat("text", F.lit("哈哈"))).otherwise(F.col("text"))
    return sentences(spark, d).select("rec", "id", "s", "e", emotional(text, F.when(n % 9 == 3, " Sad").otherwise("neutral"), F.when(n % 11 == 4, "Laughter").otherwise("speech")).alias("emotional"))


@query(f"WITH {SENTENCES}, {_FELT} SELECT rec, id, emotional FROM told")
def emotional_rows(spark, d):
    return _felt(spark, d).select("rec", "id", "emotional")


@query(f"""WITH {SENTENCES}, x AS (SELECT rec, id, s, e, id % 7 = 0 AS fallback, id % 3 = 0 AS explicit, id % 5 = 0 AS warned FROM sentences)
SELECT rec, id, s, e FROM x WHERE fallback OR (NOT (explicit AND e - s > 300) AND warned) UNION ALL SELECT rec, id, s + 100, s + 200 FROM x WHERE NOT fallback AND explicit AND e - s > 300""")
def row_review_spans(spark, d):
    """What of each row needs a listen: all of a fallback, else the spans that are named and long enough, else all of a row with a warning."""
    n, s, e = F.col("id"), F.col("s"), F.col("e")
    span = lambda a, b: F.struct(a.alias("s"), b.alias("e"))
    named = F.when((n % 3 == 0) & (e - s > 300), F.array(span(s + 100, s + 200), span(s + 300, s + 301))).otherwise(F.array().cast("array<struct<s:bigint,e:bigint>>"))
    named = F.filter(named, lambda x: x["e"] - x["s"] > EPS)
    whole = F.array(span(s, e))
    spans = F.when(n % 7 == 0, whole).when(F.size(named) > 0, named).when(n % 5 == 0, whole)
    return sentences(spark, d).select("rec", "id", F.explode(spans).alias("x")).select("rec", "id", "x.s", "x.e")


@query(f"""WITH {SENTENCES}, x AS (SELECT rec, id, trim(regexp_replace('<|en|>' || CASE WHEN id % 8 = 0 THEN '' ELSE text END || '<|noise|>', '<[|][^|]*[|]>', '', 'g'), ' ') AS text FROM sentences)
SELECT rec, id, text FROM x WHERE text <> ''""")
def asr_rows(spark, d):
    """Recognised rows without the recogniser's tags; empty ones drop out."""
    raw = F.concat(F.lit("<|en|>"), F.when(F.col("id") % 8 == 0, "").otherwise(F.col("text")), F.lit("<|noise|>"))
    return sentences(spark, d).select("rec", "id", F.trim(F.regexp_replace(raw, r"<[|][^|]*[|]>", "")).alias("text")).where("text <> ''")


@query(f"""WITH {SENTENCES}, {ALIGNED} SELECT a.rec, a.row, min(a.s) + 5000 AS first, max(a.e) + 5000 AS last, any_value(t.s) + 5000 AS s, any_value(t.e) + 5000 AS e FROM aligned a JOIN sentences t ON t.rec = a.rec AND t.id = a.row GROUP BY a.rec, a.row""")
def shifted_rows(spark, d):
    """Rows and the first and last of their words, moved to the recording's clock."""
    offset = 5000
    rows = sentences(spark, d).select("rec", F.col("id").alias("row"), (F.col("s") + offset).alias("s"), (F.col("e") + offset).alias("e"))
    words = aligned(spark, d).groupBy("rec", "row").agg((F.min("s") + offset).alias("first"), (F.max("e") + offset).alias("last"))
    return words.join(rows, ["rec", "row"])


@query("""SELECT url, regexp_matches(url, '^https://[^/?#@]+(/[^?#]*)?$') OR regexp_matches(url, '^http://(localhost|127[.]0[.]0[.]1|\\[::1\\])(:[0-9]+)?(/[^?#]*)?$') AS allowed FROM pages WHERE url IS NOT NULL""")
def api_bases(spark, d):
    """Addresses that may be called: https, or http on this machine, without credentials, query or fragment."""
    url = F.col("url")
    return read(spark, d, "pages").where(url.isNotNull()).select("url", (url.rlike(r"^https://[^/?#@]+(/[^?#]*)?$") | url.rlike(r"^http://(localhost|127[.]0[.]0[.]1|\[::1\])(:[0-9]+)?(/[^?#]*)?$")).alias("allowed"))


@query("SELECT page_id, lower(replace(url, '\\', '/')) AS path FROM pages")
def normal_paths(spark, d):
    return read(spark, d, "pages").select("page_id", F.lower(F.replace("url", F.lit("\\"), F.lit("/"))).alias("path"))


@query(f"WITH {EV}, {CANDIDATES} SELECT id, status = 'applied' AND s < e AND e - s > 60000 AS restorable FROM candidates")
def restorable_candidates(spark, d):
    """Applied candidates of which some effective interval is longer than a minute."""
    pieces = F.array(F.struct("s", "e"), F.struct(F.col("e").alias("s"), F.col("e")))
    return candidates(spark, d).select("id", ((F.col("status") == "applied") & (F.col("s") < F.col("e")) & F.exists(pieces, lambda x: x["e"] - x["s"] > 60_000)).alias("restorable"))


# ---- joins by id and by time ----


@query(f"""WITH {EV}, g AS (SELECT id, rec, sum(new) OVER (PARTITION BY rec ORDER BY s, e, id) AS part FROM (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY rec ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 90000 THEN 0 ELSE 1 END AS new FROM ev)),
m AS (SELECT id // 5 AS grp, rec, part FROM g) SELECT grp, count(*) AS members, count(DISTINCT (rec, part)) = 1 AS one_component FROM m GROUP BY grp""")
def component_membership(spark, d):
    """Whether the members of each group are of one component."""
    rows = iv.gap_sessions(ev(spark, d), ["rec"], 90_000).select("id", F.struct("rec", "session").alias("part"))
    return rows.groupBy(F.floor(F.col("id") / 5).alias("grp")).agg(F.count(F.lit(1)).alias("members"), (F.count_distinct("part") == 1).alias("one_component"))


@query(f"""WITH {EV}, {CANDIDATES}, r AS (SELECT id, CASE WHEN id % 6 = 0 THEN 'restore' ELSE 'keep' END AS action, kind FROM ev WHERE id % 2 = 0)
SELECT c.id, CASE WHEN r.action = 'restore' AND c.status = 'applied' THEN 'suggested' ELSE c.status END AS status, coalesce(r.kind, c.reason) AS reason FROM candidates c LEFT JOIN r ON r.id = c.id""")
def applied_decisions(spark, d):
    """Candidates with the action and reason that were decided for their ids."""
    made = ev(spark, d).where("id % 2 = 0").select("id", F.when(F.col("id") % 6 == 0, "restore").otherwise("keep").alias("action"), "kind")
    status = F.when((F.col("action") == "restore") & (F.col("status") == "applied"), "suggested").otherwise(F.col("status"))
    return candidates(spark, d).join(made, "id", "left").select("id", status.alias("status"), F.coalesce("kind", "reason").alias("reason"))


@query("""SELECT o_orderkey AS task, n AS clip, l_quantity IS NOT NULL AS existed FROM (SELECT o_orderkey, unnest(generate_series(1, 3)) AS n FROM orders WHERE o_orderstatus = 'P') LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = n""")
def created_projects(spark, d):
    """A project for each clip of a task; those that exist stay."""
    wanted = read(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("task"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("clip"))
    there = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("task"), F.col("l_linenumber").alias("clip"), F.lit(True).alias("there"))
    return wanted.join(there, ["task", "clip"], "left").select("task", "clip", F.coalesce("there", F.lit(False)).alias("existed"))


@query("""SELECT l_orderkey AS item, l_linenumber AS line, coalesce(p_name, 'part ' || l_partkey) AS part, coalesce(s_name, 'unknown') AS supplier FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_partkey % 2 = 0) p ON p_partkey = l_partkey LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 3 > 0) s ON s_suppkey = l_suppkey""")
def queue_labels(spark, d):
    """Queue items with the names of what they refer to, or a stand-in."""
    part = read(spark, d, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    supplier = read(spark, d, "supplier").where("s_suppkey % 3 > 0").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    rows = read(spark, d, "lineitem").join(part, "l_partkey", "left").join(supplier, "l_suppkey", "left")
    return rows.select(F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("line"), F.coalesce("p_name", F.concat(F.lit("part "), "l_partkey")).alias("part"), F.coalesce("s_name", F.lit("unknown")).alias("supplier"))


@query("SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey AND abs(c_acctbal - s_acctbal) <= 800")
def relocated_sources(spark, d):
    """Sources that may be the same file elsewhere: equal in kind, and lengths no further apart than the tolerance."""
    width = 800
    left = read(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("kind"), F.col("c_acctbal").alias("a"), F.floor(F.col("c_acctbal") / width).alias("bucket"))
    right = read(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("kind"), F.col("s_acctbal").alias("b"), F.explode(F.array(*[F.floor(F.col("s_acctbal") / width) + k for k in (-1, 0, 1)])).alias("bucket"))
    return left.join(right, ["kind", "bucket"]).where(F.abs(F.col("a") - F.col("b")) <= width).select("c_custkey", "s_suppkey")


_OLD_FRESH = """old AS (SELECT rec, id, s, e FROM sentences), fresh AS (SELECT rec, id, s + 700 AS s, e + 650 AS e, text FROM sentences WHERE id % 4 <> 1)"""


def _old_fresh(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = sentences(spark, d)
    fresh = rows.where("id % 4 <> 1").select("rec", F.col("id").alias("fresh_id"), (F.col("s") + 700).alias("s"), (F.col("e") + 650).alias("e"), "text")
    return rows.select("rec", "id", "s", "e"), fresh


@query(f"WITH {SENTENCES}, {_OLD_FRESH} SELECT o.rec, o.id, count(f.id) AS n, coalesce(string_agg(f.text, ' ' ORDER BY f.s, f.id), '') AS told FROM old o LEFT JOIN fresh f ON f.rec = o.rec AND least(o.e, f.e) - greatest(o.s, f.s) > 2 GROUP BY o.rec, o.id")
def fresh_overlap(spark, d):
    """What a fresh transcript says where each old row stands."""
    old, fresh = _old_fresh(spark, d)
    hit = iv.overlap_join(old, fresh, ["rec"], WIDTH // 60, EPS).groupBy("rec", "id").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("s2", "fresh_id", "text"))).alias("x"))
    return old.join(hit, ["rec", "id"], "left").select("rec", "id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.array_join(F.col("x.text"), " "), F.lit("")).alias("told"))


@query(f"""WITH {SENTENCES}, {_OLD_FRESH} SELECT rec, id, s, e, false AS original_fallback FROM fresh
UNION ALL SELECT rec, id, s, e, true FROM old o WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE f.rec = o.rec AND least(o.e, f.e) - greatest(o.s, f.s) > 2)""")
def fallback_rows(spark, d):
    """The fresh rows, and old ones where nothing fresh was heard."""
    old, fresh = _old_fresh(spark, d)
    lost = iv.overlap_join(old, fresh.select("rec", "s", "e"), ["rec"], WIDTH // 60, EPS).select("rec", "id").distinct()
    lost = old.join(lost, ["rec", "id"], "left_anti").withColumn("original_fallback", F.lit(True))
    return fresh.select("rec", F.col("fresh_id").alias("id"), "s", "e", F.lit(False).alias("original_fallback")).unionByName(lost)


@query(f"""WITH {CHAT}, w AS (SELECT DISTINCT time // 900 * 900 AS lo FROM chat) SELECT lo, count(*) AS messages FROM w JOIN chat ON time BETWEEN lo AND lo + 600 + 8 GROUP BY lo""")
def chat_windows(spark, d):
    """Messages from each window's start until some seconds after its end; windows and messages meet by buckets."""
    rows, length = chat(spark, d), 600
    windows = rows.select((F.floor(F.col("time") / 900) * 900).alias("lo")).distinct()
    dealt = windows.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("lo") / 15), F.floor((F.col("lo") + length + CHAT_SLACK_S) / 15))))
    hits = rows.withColumn("bucket", F.floor(F.col("time") / 15)).join(dealt, "bucket").where(F.col("time").between(F.col("lo"), F.col("lo") + length + CHAT_SLACK_S))
    return hits.groupBy("lo").agg(F.count(F.lit(1)).alias("messages"))


@query(f"""WITH {SENTENCES}, {_FELT}, g AS (SELECT rec, id, e AS s, e + 600 AS e FROM told WHERE id % 5 = 2) SELECT g.rec, g.id, EXISTS (SELECT 1 FROM told t WHERE t.rec = g.rec AND t.emotional AND t.e >= g.s - 8000 AND t.s <= g.e + 8000) AS blocked FROM g""")
def pause_neighbors(spark, d):
    """Pauses beside which a row shows emotion stay."""
    rows = _felt(spark, d)
    gaps = rows.where("id % 5 = 2").select("rec", "id", F.col("e").alias("s"), (F.col("e") + 600).alias("e"))
    near = gaps.withColumns({"s": F.col("s") - PAUSE_SLACK_MS, "e": F.col("e") + PAUSE_SLACK_MS})
    hit = iv.overlap_join(near, rows.where("emotional").select("rec", "s", "e"), ["rec"], WIDTH // 30, -1).select("rec", "id").distinct().withColumn("hit", F.lit(True))
    return gaps.join(hit, ["rec", "id"], "left").select("rec", "id", F.coalesce("hit", F.lit(False)).alias("blocked"))


@query(f"WITH {SENTENCES}, c AS (SELECT rec, id, s, e FROM sentences WHERE id % 6 = 3) SELECT c.rec, c.id, min(t.id) AS first_id, max(t.id) AS last_id, count(*) AS n_rows FROM c JOIN sentences t ON t.rec = c.rec AND t.e > c.s - 12000 AND t.s < c.e + 12000 GROUP BY c.rec, c.id")
def review_context(spark, d):
    """The transcript around each clip that a review reads."""
    rows = sentences(spark, d)
    near = rows.where("id % 6 = 3").select("rec", "id", (F.col("s") - REVIEW_SLACK_MS).alias("s"), (F.col("e") + REVIEW_SLACK_MS).alias("e"))
    hit = iv.overlap_join(near, rows.select("rec", F.col("id").alias("row"), "s", "e"), ["rec"], WIDTH // 30, 0)
    return hit.groupBy("rec", "id").agg(F.min("row").alias("first_id"), F.max("row").alias("last_id"), F.count(F.lit(1)).alias("n_rows"))


@query(f"""WITH {EV}, a AS (SELECT id, rec FROM ev WHERE id % 3 > 0), b AS (SELECT id, kind FROM ev WHERE id % 4 > 0) SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'not_measured' WHEN a.id IS NULL THEN 'unmatched' ELSE 'measured' END AS state FROM a FULL JOIN b ON a.id = b.id""")
def measured_samples(spark, d):
    """Samples with and without a proposal, and proposals of no sample."""
    rows = ev(spark, d)
    both = rows.where("id % 3 > 0").select("id", F.lit(1).alias("a")).join(rows.where("id % 4 > 0").select("id", F.lit(1).alias("b")), "id", "full_outer")
    return both.select("id", F.when(F.col("b").isNull(), "not_measured").when(F.col("a").isNull(), "unmatched").otherwise("measured").alias("state"))


@query(f"""WITH {SENTENCES}, k0 AS (SELECT rec, id, s, e FROM sentences WHERE id % 3 <> 1), k AS (SELECT *, coalesce(sum(e - s) OVER (PARTITION BY rec ORDER BY s, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM k0),
r AS (SELECT rec, s + 400 AS s, e + 400 AS e FROM sentences WHERE id % 5 = 0), m AS (SELECT k.rec, greatest(r.s, k.s) - k.s + k.o AS s, least(r.e, k.e) - k.s + k.o AS e FROM r JOIN k ON k.rec = r.rec AND least(r.e, k.e) - greatest(r.s, k.s) > 2),
c AS (SELECT rec, id, o AS s, o + e - s AS e FROM k) SELECT rec, id FROM c WHERE EXISTS (SELECT 1 FROM m WHERE m.rec = c.rec AND least(m.e, c.e) - greatest(m.s, c.s) > 2)""")
def review_cues(spark, d):
    """Captions of the output that meet a region under review, once that is moved to the output's clock."""
    rows = sentences(spark, d).select("rec", "id", "s", "e")
    kept = iv.running_offset(rows.where("id % 3 <> 1"), ["rec"], ["s", "id"])
    regions = rows.where("id % 5 = 0").select("rec", (F.col("s") + 400).alias("s"), (F.col("e") + 400).alias("e"))
    moved = iv.to_output(regions, kept.select("rec", "s", "e", "offset"), ["rec"], WIDTH // 60)
    cues = kept.select("rec", "id", F.col("offset").alias("s"), (F.col("offset") + F.col("e") - F.col("s")).alias("e"))
    return iv.overlap_join(cues, moved.select("rec", "s", "e"), ["rec"], WIDTH // 60, EPS).select("rec", "id").distinct()


# ---- validators ----


@query(f"""WITH {SENTENCES}, {PROPOSALS}, x AS (SELECT p.rec, p.start_id, p.end_id, substring(t.text, 1, CAST(p.start_id % 50 AS INT)) AS title, substring(t.text, 1, CAST(p.start_id % 90 AS INT)) AS reason, l.rec AS known, lead(p.start_id) OVER (PARTITION BY p.rec ORDER BY p.start_id) AS following
FROM proposals p JOIN sentences t ON t.rec = p.rec AND t.id = p.start_id LEFT JOIN sentences l ON l.rec = p.rec AND l.id = p.end_id)
SELECT rec, start_id, 'unknown' AS rule FROM x WHERE known IS NULL UNION ALL SELECT rec, start_id, 'reversed' FROM x WHERE end_id < start_id UNION ALL SELECT rec, start_id, 'title' FROM x WHERE length(title) NOT BETWEEN 1 AND 40
UNION ALL SELECT rec, start_id, 'reason' FROM x WHERE length(reason) NOT BETWEEN 1 AND 80 UNION ALL SELECT rec, start_id, 'overlap' FROM x WHERE end_id >= following UNION ALL SELECT rec, NULL, 'too_many' FROM x GROUP BY rec HAVING count(*) > 4""")
def continuity_violations(spark, d):
    """What is wrong with the events that a request returned: ids, order, texts, overlaps, number."""
    rows = sentences(spark, d)
    x = proposals(spark, d).join(rows.select("rec", F.col("id").alias("start_id"), "text"), ["rec", "start_id"]).join(rows.select("rec", F.col("id").alias("end_id"), F.lit(1).alias("known")), ["rec", "end_id"], "left")
    x = x.withColumns({"following": F.lead("start_id").over(Window.partitionBy("rec").orderBy("start_id")), "title": F.length(F.substring("text", F.lit(1), F.col("start_id") % 50)), "reason": F.length(F.substring("text", F.lit(1), F.col("start_id") % 90))})
    rule = _broken((F.col("known").isNull(), "unknown"), (F.col("end_id") < F.col("start_id"), "reversed"), (~F.col("title").between(*TITLE), "title"), (~F.col("reason").between(*REASON), "reason"), (F.col("end_id") >= F.col("following"), "overlap"))
    many = x.groupBy("rec").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST_EVENTS)
    return x.select("rec", "start_id", rule.alias("rule")).unionByName(many.select("rec", F.lit(None).cast("long").alias("start_id"), F.lit("too_many").alias("rule")))


@query(f"""WITH {SENTENCES}, w AS (SELECT DISTINCT rec, id // 2 AS section FROM sentences), g AS (SELECT rec, section, CASE WHEN section % 5 = 3 THEN 'maybe' ELSE 'story' END AS decision FROM w WHERE section % 6 <> 2 UNION ALL SELECT rec, section, 'none' FROM w WHERE section % 6 = 4),
n AS (SELECT rec, section, count(*) AS n FROM g GROUP BY rec, section)
SELECT w.rec, w.section, CASE WHEN n IS NULL THEN 'missing' ELSE 'repeated' END AS rule FROM w LEFT JOIN n ON n.rec = w.rec AND n.section = w.section WHERE n IS NULL OR n > 1 UNION ALL SELECT rec, section, 'decision' FROM g WHERE decision NOT IN ('story', 'none')""")
def section_violations(spark, d):
    """Sections that were not decided exactly once, and decisions that don't exist."""
    wanted = sentences(spark, d).select("rec", F.floor(F.col("id") / 2).alias("section")).distinct()
    given = wanted.where("section % 6 <> 2").withColumn("decision", F.when(F.col("section") % 5 == 3, "maybe").otherwise("story")).unionByName(wanted.where("section % 6 = 4").withColumn("decision", F.lit("none")))
    wrong = given.where(~F.col("decision").isin("story", "none")).select("rec", "section", F.lit("decision").alias("rule"))
    return rules.partition_violations(wanted, given, ["rec", "section"]).unionByName(wrong)


@query(f"""WITH {EV}, m AS (SELECT rec, id, id // 3 AS grp FROM ev), g AS (SELECT rec, grp, count(*) AS n, min(id) + grp % 4 AS keep, count(*) FILTER (WHERE id % 9 <> 0) AS backed FROM m GROUP BY rec, grp)
SELECT rec, grp, 'single' AS rule FROM g WHERE n < 2 UNION ALL SELECT rec, grp, 'evidence' FROM g WHERE backed < n UNION ALL SELECT rec, grp, 'keep' FROM g WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.rec = g.rec AND m.grp = g.grp AND m.id = g.keep)""")
def retelling_violations(spark, d):
    """Groups of retold events: two members at least, the kept one among them, evidence for each."""
    rows = ev(spark, d).select("rec", "id", F.floor(F.col("id") / 3).alias("grp"))
    groups = rows.groupBy("rec", "grp").agg(F.count(F.lit(1)).alias("n"), (F.min("id") + F.col("grp") % 4).alias("keep"), F.count_if(F.col("id") % 9 != 0).alias("backed"), F.collect_list("id").alias("ids"))
    return groups.select("rec", "grp", _broken((F.col("n") < 2, "single"), (F.col("backed") < F.col("n"), "evidence"), (~F.array_contains("ids", F.col("keep")), "keep")).alias("rule"))


@query(f"""WITH {SENTENCES}, x AS (SELECT rec, id, text, id % 10 = 9 AS missing, id % 3 = 0 AS removed, CASE WHEN id % 4 = 0 THEN 'other' ELSE 'repeat' END AS kind, substring('because of it', 1, CAST(id % 7 AS INT)) AS reason, CASE WHEN id % 6 = 0 THEN '~~' ELSE substring(text, 1, 10) END AS quote FROM sentences)
SELECT rec, id, 'missing' AS rule FROM x WHERE missing UNION ALL SELECT rec, id, 'kind' FROM x WHERE NOT missing AND removed AND kind <> 'repeat' UNION ALL SELECT rec, id, 'reason' FROM x WHERE NOT missing AND removed AND length(trim(reason)) NOT BETWEEN 3 AND 160
UNION ALL SELECT rec, id, 'quote' FROM x WHERE NOT missing AND removed AND (length(trim(quote)) NOT BETWEEN 1 AND 80 OR NOT contains(text, quote))""")
def plan_violations(spark, d):
    """A plan keeps or removes every row; what it removes needs a kind, a reason and words of the row."""
    n = F.col("id")
    x = sentences(spark, d).select("rec", "id", "text", (n % 10 == 9).alias("missing"), (n % 3 == 0).alias("removed"), F.when(n % 4 == 0, "other").otherwise("repeat").alias("kind"),
                                   F.substring(F.lit("because of it"), F.lit(1), n % 7).alias("reason"), F.when(n % 6 == 0, "~~").otherwise(F.substring("text", 1, 10)).alias("quote"))
    gone = ~F.col("missing") & F.col("removed")
    bad = ~F.length(F.trim("quote")).between(*QUOTE) | ~F.contains("text", "quote")
    return x.select("rec", "id", _broken((F.col("missing"), "missing"), (gone & (F.col("kind") != "repeat"), "kind"), (gone & ~F.length(F.trim("reason")).between(*PLAN_REASON), "reason"), (gone & bad, "quote")).alias("rule"))


@query(f"""WITH {EV}, {CANDIDATES}, x AS (SELECT id + CASE WHEN id % 50 = 7 THEN 10000000 ELSE 0 END AS id, CASE WHEN id % 4 = 2 THEN 'remove' ELSE 'keep' END AS action, id + 1 AS ref, reason AS kind FROM candidates WHERE id % 13 <> 0)
SELECT id, 'unknown' AS rule FROM x WHERE id NOT IN (SELECT id FROM candidates) UNION ALL SELECT id, 'missing' FROM candidates WHERE id NOT IN (SELECT id FROM x) UNION ALL SELECT id, 'kind' FROM x WHERE action = 'remove' AND kind NOT IN ('view', 'click') UNION ALL SELECT id, 'reference' FROM x WHERE action = 'remove' AND ref NOT IN (SELECT id FROM candidates)""")
def decision_violations(spark, d):
    """Decisions on unknown candidates, candidates without one, removals of a kind that wasn't asked for, references to nothing."""
    known = candidates(spark, d).select("id", "reason")
    made = known.where("id % 13 <> 0").select((F.col("id") + F.when(F.col("id") % 50 == 7, 10_000_000).otherwise(0)).alias("id"), F.when(F.col("id") % 4 == 2, "remove").otherwise("keep").alias("action"), (F.col("id") + 1).alias("ref"), F.col("reason").alias("kind"))
    ids, removed = known.select("id"), made.where("action = 'remove'")
    parts = (made.join(ids, "id", "left_anti").select("id", F.lit("unknown").alias("rule")), ids.join(made, "id", "left_anti").select("id", F.lit("missing").alias("rule")),
             removed.where(~F.col("kind").isin("view", "click")).select("id", F.lit("kind").alias("rule")), removed.join(ids.withColumnRenamed("id", "ref"), "ref", "left_anti").select("id", F.lit("reference").alias("rule")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(f"""WITH {SENTENCES}, q AS (SELECT rec, id, CASE WHEN id % 5 = 4 THEN 'hero' ELSE 'setup' END AS role, CASE WHEN id % 3 = 0 THEN id + 1 ELSE id END AS row, substring(text, 1, 24) AS quote FROM sentences WHERE length(text) >= 24),
x AS (SELECT q.*, coalesce(contains(t.text, q.quote), false) AS there FROM q LEFT JOIN sentences t ON t.rec = q.rec AND t.id = q.row), h AS (SELECT x.rec, x.id, min(t.id) AS lone, count(*) AS n FROM x JOIN sentences t ON t.rec = x.rec AND contains(t.text, x.quote) WHERE NOT there GROUP BY x.rec, x.id)
SELECT x.rec, x.id, CASE WHEN role NOT IN ('setup', 'event', 'payoff') THEN 'role' WHEN there THEN 'verbatim' WHEN n = 1 THEN 'rebound' ELSE 'lost' END AS state, CASE WHEN there THEN row WHEN n = 1 THEN lone END AS bound FROM x LEFT JOIN h ON h.rec = x.rec AND h.id = x.id""")
def story_nodes(spark, d):
    """Nodes of a story: a known role, and a quote that its row, or else exactly one other row of the recording, holds."""
    rows = sentences(spark, d).select("rec", "id", "text")
    role = F.when(F.col("id") % 5 == 4, "hero").otherwise("setup")
    quotes = rows.where("length(text) >= 24").select("rec", "id", role.alias("role"), F.when(F.col("id") % 3 == 0, F.col("id") + 1).otherwise(F.col("id")).alias("row"), F.substring("text", 1, 24).alias("quote"))
    there = quotes.join(rows.select("rec", F.col("id").alias("row"), "text"), ["rec", "row"], "left").withColumn("there", F.coalesce(F.contains("text", "quote"), F.lit(False))).drop("text")
    # A recording's rows are few; quotes meet them by recording.
    found = there.where("NOT there").select("rec", "id", "quote").join(rows.select("rec", F.col("id").alias("other"), "text"), "rec").where(F.contains("text", "quote")).groupBy("rec", "id").agg(F.min("other").alias("lone"), F.count(F.lit(1)).alias("n"))
    state = F.when(~F.col("role").isin("setup", "event", "payoff"), "role").when(F.col("there"), "verbatim").when(F.col("n") == 1, "rebound").otherwise("lost")
    return there.join(found, ["rec", "id"], "left").select("rec", "id", state.alias("state"), F.when(F.col("there"), F.col("row")).when(F.col("n") == 1, F.col("lone")).alias("bound"))


@query(f"""WITH {SENTENCES}, x AS (SELECT rec, id // 6 AS part, string_agg(text, ' ' ORDER BY id) AS summary, count(*) FILTER (WHERE id % 2 = 0 OR id % 7 = 0) AS evidence FROM sentences GROUP BY rec, id // 6)
SELECT rec, part, 'summary' AS rule FROM x WHERE length(summary) NOT BETWEEN 1 AND 240 UNION ALL SELECT rec, part, 'evidence' FROM x WHERE evidence NOT BETWEEN 1 AND 4""")
def outline_violations(spark, d):
    """Parts of an outline with too long a summary, or without one to four rows of evidence."""
    x = sentences(spark, d).groupBy("rec", F.floor(F.col("id") / 6).alias("part")).agg(F.sort_array(F.collect_list(F.struct("id", "text"))).alias("told"), F.count_if((F.col("id") % 2 == 0) | (F.col("id") % 7 == 0)).alias("evidence"))
    size = F.length(F.array_join(F.col("told.text"), " "))
    return x.select("rec", "part", _broken((~size.between(1, SUMMARY), "summary"), (~F.col("evidence").between(1, MOST_EVIDENCE), "evidence")).alias("rule"))


@query("""WITH x AS (SELECT event_id AS id, user_id % 40 AS name, value - 20 AS a, value * (event_id % 3) AS b FROM events), n AS (SELECT name, count(*) AS n FROM x GROUP BY name)
SELECT id, CASE WHEN a IS NULL OR b IS NULL OR NOT isfinite(a + b) THEN 'number' WHEN a < 0 THEN 'negative' WHEN b <= a THEN 'empty' WHEN n > 1 THEN 'name' END AS rule FROM x JOIN n USING (name) WHERE a IS NULL OR b IS NULL OR NOT isfinite(a + b) OR a < 0 OR b <= a OR n > 1""")
def benchmark_interval_violations(spark, d):
    """Intervals of a benchmark that are no numbers, negative or empty, or whose names repeat."""
    x = read(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 40).alias("name"), (F.col("value") - 20).alias("a"), (F.col("value") * (F.col("event_id") % 3)).alias("b"))
    n = x.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    total = (F.col("a") + F.col("b")).cast("double")
    number = F.col("a").isNull() | F.col("b").isNull() | F.isnan(total) | (F.abs(total) == float("inf"))
    rule = _first((number, "number"), (F.col("a") < 0, "negative"), (F.col("b") <= F.col("a"), "empty"), (F.col("n") > 1, "name"))
    return x.join(n, "name").select("id", rule.alias("rule")).where("rule IS NOT NULL")


@query("""SELECT o_orderkey AS id, CASE WHEN o_custkey % 9 <> o_orderkey % 9 THEN 'stale' WHEN o_orderkey % 8 NOT BETWEEN 0 AND 5 THEN 'step' ELSE 'accepted' END AS outcome FROM orders""")
def revision_guards(spark, d):
    """Changes asked for: only those of the current revision, and to a step that exists."""
    wanted, current, step = F.col("o_orderkey") % 9, F.col("o_custkey") % 9, F.col("o_orderkey") % 8
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(current != wanted, "stale").when(~step.between(0, LAST_STEP), "step").otherwise("accepted").alias("outcome"))


@query(f"""WITH {SENTENCES}, {PROPOSALS} SELECT rec, start_id, CASE WHEN end_id < start_id THEN 'reversed' WHEN score IS NULL THEN 'score' END AS refused FROM proposals""")
def quarantined_rows(spark, d):
    """All rows of a batch, those that break a rule with the rule: accepted ones go on, the others wait for a look."""
    return proposals(spark, d).select("rec", "start_id", _first((F.col("end_id") < F.col("start_id"), "reversed"), (F.col("score").isNull(), "score")).alias("refused"))


# ---- sound ----


_FRAMES = """x AS (SELECT vec_id, unnest(embedding) AS v, unnest(generate_series(0, len(embedding) - 1)) AS place, len(embedding) AS n FROM embeddings),
f AS (SELECT vec_id, (place - n // 4) // 4 AS frame, 20 * log10(greatest(sqrt(avg(CAST(v AS DOUBLE) * v)), 1e-8)) AS db FROM x WHERE place >= n // 4 AND place < 3 * (n // 4) GROUP BY vec_id, frame),
i AS (SELECT vec_id, sqrt(avg(CAST(v AS DOUBLE) * v) FILTER (WHERE place >= n // 4 AND place < 3 * (n // 4))) / greatest(sqrt(avg(CAST(v AS DOUBLE) * v) FILTER (WHERE NOT (place >= n // 4 AND place < 3 * (n // 4)))), 1e-8) AS ratio FROM x GROUP BY vec_id),
g AS (SELECT vec_id, count(*) AS frames, quantile_cont(db, 0.95) AS p95, max(db) AS top, quantile_cont(db, 0.9) - quantile_cont(db, 0.1) AS spread FROM f GROUP BY vec_id)"""


@query(f"""WITH {_FRAMES} SELECT g.vec_id, CAST(floor(p95 * 100 + 0.5) AS BIGINT) AS p95_cdb, CAST(floor(spread * 100 + 0.5) AS BIGINT) AS spread_cdb, CAST(floor(ratio * 10000 + 0.5) AS BIGINT) AS ratio_e4,
CASE WHEN frames < 5 THEN 'few' WHEN p95 <= -43 THEN 'quiet' WHEN p95 <= -32 AND top <= -25 AND ratio <= 0.32 AND spread <= 6 THEN 'stable' ELSE 'insufficient' END AS criterion FROM g JOIN i ON i.vec_id = g.vec_id""")
def gap_evidence(spark, d):
    """What the sound of a pause shows: level, spread, ratio to its neighbours, and whether it may be cut."""
    v, n = F.col("v").cast("double"), F.col("n")
    x = read(spark, d, "embeddings").select("vec_id", F.size("embedding").alias("n"), F.posexplode("embedding").alias("place", "v")).withColumn("quarter", F.floor(n / 4))
    inside = (F.col("place") >= F.col("quarter")) & (F.col("place") < 3 * F.col("quarter"))
    rms = lambda column: F.sqrt(F.avg(column * column))
    frames = x.where(inside).groupBy("vec_id", F.floor((F.col("place") - F.col("quarter")) / 4).alias("frame")).agg((20 * F.log10(F.greatest(rms(v), F.lit(1e-8)))).alias("db"))
    ratio = x.groupBy("vec_id").agg((rms(F.when(inside, v)) / F.greatest(rms(F.when(~inside, v)), F.lit(1e-8))).alias("ratio"))
    level = frames.groupBy("vec_id").agg(F.count(F.lit(1)).alias("frames"), F.percentile("db", 0.95).alias("p95"), F.max("db").alias("top"), (F.percentile("db", 0.9) - F.percentile("db", 0.1)).alias("spread"))
    stable = (F.col("p95") <= STABLE_DB) & (F.col("top") <= STABLE_MAX_DB) & (F.col("ratio") <= STABLE_RATIO) & (F.col("spread") <= STABLE_SPREAD_DB)
    criterion = F.when(F.col("frames") < FEWEST_FRAMES, "few").when(F.col("p95") <= QUIET_DB, "quiet").when(stable, "stable").otherwise("insufficient")
    scaled = lambda c, k: F.floor(F.col(c) * k + 0.5).cast("long")
    return level.join(ratio, "vec_id").select("vec_id", scaled("p95", 100).alias("p95_cdb"), scaled("spread", 100).alias("spread_cdb"), scaled("ratio", 10_000).alias("ratio_e4"), criterion.alias("criterion"))


@query("""WITH x AS (SELECT vec_id, list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * v)) AS a FROM embeddings) SELECT x.vec_id, CAST(floor(1000 * 10 * log10(greatest(y.a, 1e-12) / greatest(x.a, 1e-12)) + 0.5) AS BIGINT) AS change_mdb FROM x JOIN x y ON y.vec_id = x.vec_id + 1""")
def level_change(spark, d):
    """How much louder the next sample is, in thousandths of a decibel."""
    x = read(spark, d, "embeddings").select("vec_id", F.aggregate("embedding", F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")).alias("a"))
    following = x.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    ratio = F.greatest("b", F.lit(1e-12)) / F.greatest("a", F.lit(1e-12))
    return x.join(following, "vec_id").select("vec_id", F.floor(1000 * 10 * F.log10(ratio) + 0.5).cast("long").alias("change_mdb"))


# ---- durations, JSON, numbers ----


_PROBED = """p AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN 0 ELSE o_custkey * 1000 END AS stream_ms, CASE WHEN o_orderkey % 4 < 2 THEN printf('%02d:%02d:%02d', o_custkey % 3, o_orderkey % 60, o_custkey % 60) END AS tag,
o_orderkey % 5 * 100 AS start_ms, o_custkey * 900 AS format_ms, o_orderkey % 2 = 0 AS matroska, o_orderkey % 7 <> 0 AS video FROM orders)"""


@query(f"""WITH {_PROBED}, t AS (SELECT *, CASE WHEN tag IS NOT NULL THEN (CAST(split_part(tag, ':', 1) AS BIGINT) * 3600 + CAST(split_part(tag, ':', 2) AS BIGINT) * 60 + CAST(split_part(tag, ':', 3) AS BIGINT)) * 1000 - start_ms END AS tag_ms FROM p)
SELECT id, CAST(CASE WHEN NOT video THEN format_ms WHEN stream_ms > 0 THEN stream_ms WHEN tag_ms > 0 THEN tag_ms WHEN matroska THEN greatest(0, format_ms - start_ms) ELSE greatest(0, format_ms) END AS BIGINT) AS duration_ms FROM t""")
def resolved_durations(spark, d):
    """How long a video is: its stream's duration, else its tag's end less its start, else the container's, which ends at the last picture in some formats."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    tag = F.when(key % 4 < 2, F.format_string("%02d:%02d:%02d", customer % 3, key % 60, customer % 60))
    stream = F.when(key % 3 == 0, F.lit(None)).when(key % 3 == 1, 0).otherwise(customer * 1000)
    p = read(spark, d, "orders").select(key.alias("id"), stream.alias("stream_ms"), tag.alias("tag"), (key % 5 * 100).alias("start_ms"), (customer * 900).alias("format_ms"), (key % 2 == 0).alias("matroska"), (key % 7 != 0).alias("video"))
    part = lambda i: F.split_part("tag", F.lit(":"), F.lit(i)).cast("long")
    tag_ms = (part(1) * 3600 + part(2) * 60 + part(3)) * 1000 - F.col("start_ms")
    duration = F.when(~F.col("video"), F.col("format_ms")).when(F.col("stream_ms") > 0, F.col("stream_ms")).when(tag_ms > 0, tag_ms)
    rest = F.when(F.col("matroska"), F.greatest(F.lit(0), F.col("format_ms") - F.col("start_ms"))).otherwise(F.greatest(F.lit(0), F.col("format_ms")))
    return p.select("id", F.coalesce(duration, rest).cast("long").alias("duration_ms"))


@query("""SELECT o_orderkey AS id, '{"customer":' || o_custkey || ',"order":' || o_orderkey || ',"status":"' || o_orderstatus || '"}' AS told, sha256('{"customer":' || o_custkey || ',"order":' || o_orderkey || ',"status":"' || o_orderstatus || '"}') AS fingerprint FROM orders""")
def fingerprints(spark, d):
    """Rows as JSON with sorted keys and no blanks, and its SHA-256."""
    names = {"order": "o_orderkey", "customer": "o_custkey", "status": "o_orderstatus"}
    told = F.to_json(F.struct(*[F.col(names[k]).alias(k) for k in sorted(names)]))
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), told.alias("told"), F.sha2(told, 256).alias("fingerprint"))


@query("""WITH x AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN '```json' || chr(10) || '{"n": ' || o_custkey || '}' || chr(10) || '```' WHEN o_orderkey % 4 = 1 THEN '[1]' WHEN o_orderkey % 4 = 2 THEN '{"n": ' ELSE '{"n": ' || o_custkey || '}' END AS raw FROM orders)
SELECT id, CASE WHEN id % 4 IN (0, 3) THEN CAST(regexp_extract(raw, '([0-9]+)', 1) AS BIGINT) END AS n FROM x""")
def model_objects(spark, d):
    """Objects that a model answered, with or without a fence; anything else is null."""
    key = F.col("o_orderkey") % 4
    plain = F.concat(F.lit('{"n": '), "o_custkey", F.lit("}"))
    raw = F.when(key == 0, F.concat(F.lit("```json\n"), plain, F.lit("\n```"))).when(key == 1, "[1]").when(key == 2, '{"n": ').otherwise(plain)
    bare = F.regexp_replace(raw, r"^\s*```(?:json)?\s*|\s*```\s*$", "")
    whole = F.when(bare.rlike(r"^\s*\{"), F.from_json(bare, "n long", {"mode": "PERMISSIVE"}))
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), whole["n"].alias("n"))


@query("SELECT l_orderkey AS id, l_linenumber AS line, CAST(round_even(CAST(l_quantity AS DOUBLE) / 2, 0) AS BIGINT) AS half FROM lineitem")
def half_even(spark, d):
    """Numbers rounded so that halves go to the even neighbour."""
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.bround(F.col("l_quantity").cast("double") / 2, 0).cast("long").alias("half"))


# ---- storage and totals ----


@query("SELECT n_name AS key, CAST(n_nationkey AS VARCHAR) AS value FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT r_name, 'region ' || r_regionkey FROM region WHERE r_regionkey = 2")
def settings_scan(spark, d):
    """Settings after an upsert of one and the removal of some: key, value."""
    held = read(spark, d, "nation").where("n_regionkey <> 2").select(F.col("n_name").alias("key"), F.col("n_nationkey").cast("string").alias("value"))
    put = read(spark, d, "region").where("r_regionkey = 2").select(F.col("r_name").alias("key"), F.concat(F.lit("region "), "r_regionkey").alias("value"))
    return held.join(put.select("key"), "key", "left_anti").unionByName(put)


@query("SELECT o_orderkey AS id, o_orderstatus AS status, o_orderdate AS created FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def recent_tasks(spark, d):
    """The newest tasks, as a list shows them."""
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created")).orderBy(F.desc("created"), F.desc("id")).limit(50)


@query("SELECT o_custkey AS project, o_orderkey AS id, n FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n <= 2")
def newest_versions(spark, d):
    """The two newest versions of each project, first the newest."""
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    return read(spark, d, "orders").select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("id"), n.alias("n")).where("n <= 2")


@query("SELECT p_partkey AS id, p_name AS title FROM part WHERE contains(lower(p_name), 'e') AND p_size > 10")
def listed_tasks(spark, d):
    """Tasks of a state whose title holds what was typed."""
    return read(spark, d, "part").where(F.contains(F.lower("p_name"), F.lit("E".lower())) & (F.col("p_size") > 10)).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))


@query(f"""WITH {EV}, {CANDIDATES}, g AS (SELECT rec, id // 4 AS grp, count(*) AS n, bool_or(status = 'applied') AS selected FROM candidates GROUP BY rec, id // 4)
SELECT rec, CAST(sum(n) AS BIGINT) AS candidates, count(*) FILTER (WHERE selected) AS selected, count(*) FILTER (WHERE NOT selected) AS not_selected, CAST(sum(n - 1) AS BIGINT) AS merged FROM g GROUP BY rec""")
def editorial_summary(spark, d):
    """Candidates, groups selected and not, and members beyond the first of each group."""
    groups = candidates(spark, d).groupBy("rec", F.floor(F.col("id") / 4).alias("grp")).agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("status") == "applied").alias("selected"))
    return groups.groupBy("rec").agg(F.sum("n").alias("candidates"), F.count_if("selected").alias("selected"), F.count_if(~F.col("selected")).alias("not_selected"), F.sum(F.col("n") - 1).alias("merged"))


@query(f"""WITH {EV} SELECT kind, CAST(sum(e - s) AS BIGINT) AS ms, CAST(sum(id % 1000) * 1000 + count(*) * 7 AS BIGINT) AS cost FROM ev GROUP BY kind""")
def export_totals(spark, d):
    """Length and price of all exports, by kind."""
    return ev(spark, d).groupBy("kind").agg(F.sum(F.col("e") - F.col("s")).alias("ms"), (F.sum(F.col("id") % 1000) * 1000 + F.count(F.lit(1)) * 7).alias("cost"))


@query("""WITH g AS (SELECT l_orderkey AS first, l_partkey AS member, l_linenumber AS at FROM lineitem), c AS (SELECT o_custkey AS second, o_orderkey AS first FROM orders)
SELECT second, count(DISTINCT member) AS members, min(member) AS low FROM c JOIN g USING (first) GROUP BY second""")
def remapped_members(spark, d):
    """Members of merged groups, by the groups of a second merge over the first one's."""
    first = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("first"), F.col("l_partkey").alias("member"))
    second = read(spark, d, "orders").select(F.col("o_custkey").alias("second"), F.col("o_orderkey").alias("first"))
    return second.join(first, "first").groupBy("second").agg(F.count_distinct("member").alias("members"), F.min("member").alias("low"))
