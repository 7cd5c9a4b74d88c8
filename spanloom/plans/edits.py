"""More registered queries: captions, ranges, words, reports and table state."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import captions
from ..sources import timed_text
from .catalogue import query
from .views import CLIPS, EV, SENTENCES, WIDTH, clips, ev, islands, read, sentences

_IDS = "row_number() OVER (PARTITION BY rec ORDER BY s, id)"


@query(f"WITH {SENTENCES} SELECT rec, row_number() OVER (PARTITION BY rec ORDER BY s, e) - 1 AS id, s, e, role || ' ' || id AS text FROM sentences")
def subtitle_scan(spark, d):
    """Subtitles rendered and read again."""
    cues = sentences(spark, d).select("rec", "s", "e", F.concat_ws(" ", "role", F.col("id").cast("string")).alias("text"))
    return timed_text.parse_subtitles(timed_text.render_srt(cues).withColumnRenamed("srt", "text"), F.lit(1 << 40))


@query("SELECT event_id % 100000 AS time, event_type AS text FROM events")
def chat_json_scan(spark, d):
    """Chat objects written as JSON documents and read again."""
    row = F.to_json(F.struct((F.col("event_id") % 100_000).alias("progress"), F.col("event_type").alias("content")))
    files = read(spark, d, "events").groupBy("user_id").agg(F.concat(F.lit('{"danmaku":['), F.array_join(F.collect_list(row), ","), F.lit("]}")).alias("text"))
    return timed_text.parse_chat_json(files, 100_000)


@query(f"""WITH {EV}, {CLIPS}, x AS (SELECT rec, id, s, e, max(e) OVER (PARTITION BY rec ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ev),
y AS (SELECT x.rec, id, CASE WHEN e - s < 40 THEN 'short' WHEN s < lo + 1000 - 1 OR e > hi - 1000 + 1 THEN 'outside' WHEN before - s > 1 THEN 'overlap' END AS rule FROM x JOIN clips c ON c.rec = x.rec)
SELECT rec, id, rule FROM y WHERE rule IS NOT NULL""")
def valid_ranges(spark, d):
    box = clips(spark, d).select("rec", (F.col("lo") + 1000).alias("lo"), (F.col("hi") - 1000).alias("hi"))
    return captions.range_violations(ev(spark, d).select("rec", "id", "s", "e"), box)


@query(f"""WITH {SENTENCES}, g AS (SELECT rec, id AS ord, s - 500 AS s, e, CASE WHEN id % 6 = 0 THEN ' ' ELSE role END AS text FROM sentences)
SELECT rec, row_number() OVER (PARTITION BY rec ORDER BY ord) - 1 AS id, s, e, text FROM g WHERE s >= 0 AND s < e AND e <= 30050 AND trim(text) <> ''""")
def clean_cues(spark, d):
    rows = sentences(spark, d).select("rec", F.col("id").alias("ord"), (F.col("s") - 500).alias("s"), "e", F.when(F.col("id") % 6 == 0, " ").otherwise(F.col("role")).alias("text"))
    return captions.clean_cues(rows, 30_000)


@query(f"""WITH {SENTENCES}, k AS (SELECT rec, s + 700 AS s, e + 300 AS e FROM sentences WHERE id % 4 = 1), x AS (SELECT rec, s AS at FROM k UNION SELECT rec, e FROM k)
SELECT rec, id FROM sentences t WHERE EXISTS (SELECT 1 FROM x WHERE x.rec = t.rec AND x.at > t.s + 2 AND x.at < t.e - 2)""")
def crossing_rows(spark, d):
    rows = sentences(spark, d).select("rec", "id", "s", "e")
    kept = rows.where("id % 4 = 1").select("rec", (F.col("s") + 700).alias("s"), (F.col("e") + 300).alias("e"))
    return captions.crossing(rows, kept, ["rec"], WIDTH // 60).select("rec", "id")


@query("""WITH x AS (SELECT source, sum(length(substring(text, 1, 60))) AS a, sum(length(substring(text, 1, 40))) AS b, sum(length(substring(text, 1, 20))) AS c FROM documents GROUP BY source)
SELECT source, CASE WHEN a <= 6000 THEN 60 WHEN b <= 6000 THEN 40 WHEN c <= 6000 THEN 20 END AS cut FROM x""")
def payload_budget(spark, d):
    """The longest excerpt of each row with which a source's rows stay within 6000 characters."""
    sums = read(spark, d, "documents").groupBy("source").agg(*[F.sum(F.length(F.substring("text", 1, k))).alias(f"n{k}") for k in (60, 40, 20)])
    return sums.select("source", F.coalesce(*[F.when(F.col(f"n{k}") <= 6000, k) for k in (60, 40, 20)]).alias("cut"))


@query(f"WITH {EV}, x AS (SELECT rec, s < lag(s) OVER (PARTITION BY rec ORDER BY id) AS back FROM ev) SELECT rec, bool_or(coalesce(back, false)) AS reordered FROM x GROUP BY rec")
def reordered_flag(spark, d):
    back = F.col("s") < F.lag("s").over(Window.partitionBy("rec").orderBy("id"))
    return ev(spark, d).select("rec", F.coalesce(back, F.lit(False)).alias("back")).groupBy("rec").agg(F.bool_or("back").alias("reordered"))


@query(f"""WITH {SENTENCES}, n AS (SELECT *, greatest(1, CAST(ceil(length(text) / 36.0) AS BIGINT)) AS n FROM sentences), p AS (SELECT *, unnest(generate_series(0, n - 1)) AS piece FROM n)
SELECT rec, id, piece, s + (e - s) * piece // n AS s, s + (e - s) * (piece + 1) // n AS e, substring(text, piece * 36 + 1, 36) AS text FROM p""")
def two_line_captions(spark, d):
    return captions.two_lines(sentences(spark, d).select("rec", "id", "s", "e", "text"))


@query(f"""WITH {SENTENCES}, p AS (SELECT rec, id, row_number() OVER (PARTITION BY rec ORDER BY id) - 1 AS place, count(*) OVER (PARTITION BY rec) AS n FROM sentences)
SELECT rec, id FROM p WHERE place IN (0, n - 1, n // 4, n * 2 // 4, n * 3 // 4)""")
def quartile_excerpt(spark, d):
    return captions.quartile_rows(sentences(spark, d).select("rec", "id"))


@query(f"""WITH {EV}, p AS (SELECT rec, id, row_number() OVER (PARTITION BY rec ORDER BY id) - 1 AS place, count(*) OVER (PARTITION BY rec) AS n FROM ev),
w AS (SELECT DISTINCT rec, CAST(floor(i * (n - 1) / 7.0 + 0.5) AS BIGINT) AS place FROM p, generate_series(0, 7) t(i) WHERE n > 8)
SELECT p.rec, p.id FROM p LEFT JOIN w ON p.rec = w.rec AND p.place = w.place WHERE n <= 8 OR w.rec IS NOT NULL""")
def spanning_nodes(spark, d):
    return captions.spread_rows(ev(spark, d).select("rec", "id"), 8)


@query(f"""WITH {EV}, x AS (SELECT rec, id, s, max(s) OVER (PARTITION BY rec ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM ev) SELECT rec, id, s FROM x WHERE top IS NULL OR s >= top""")
def monotone_filter(spark, d):
    return captions.monotone(ev(spark, d).select("rec", "id", "s"), "s")


@query(f"""WITH {SENTENCES} SELECT rec, id, greatest(coalesce(lag(e) OVER w, s - 25), s - 25) AS s, least(coalesce(lead(s) OVER w, e + 25), e + 25) AS e FROM sentences WINDOW w AS (PARTITION BY rec ORDER BY s, id)""")
def word_padding(spark, d):
    return captions.padded_words(sentences(spark, d).select("rec", "id", "s", "e"))


_DAY = f"{EV}, clips AS (SELECT rec, min(s) AS lo, min(s) + sum(e - s) AS hi FROM ev GROUP BY rec)"


def _days(spark, d):
    return ev(spark, d).groupBy("rec").agg(F.min("s").alias("lo"), F.sum(F.col("e") - F.col("s")).alias("len")).select("rec", "lo", (F.col("lo") + F.col("len")).alias("hi"))


@query(f"""WITH {_DAY}, p AS (SELECT rec, CAST(lo AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi, unnest(generate_series(0, greatest(1, CAST(ceil((hi - lo) / 240000.0) AS BIGINT)) - 1)) AS part FROM clips)
SELECT rec, part, lo + part * 240000 AS s, least(lo + (part + 1) * 240000, hi) AS e FROM p""")
def review_parts(spark, d):
    return captions.parts(_days(spark, d))


@query(f"""WITH {_DAY}, p AS (SELECT rec, CAST(lo AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi, unnest([5, 23, 41, 59, 77, 95]) AS h, unnest([0, 1, 2, 3, 4, 5]) AS frame FROM clips)
SELECT rec, CAST(frame AS BIGINT) AS frame, lo + (hi - lo) * h // 100 AS at FROM p""".replace(" AS at FROM", ' AS "at" FROM'))
def frame_positions(spark, d):
    return captions.frames(_days(spark, d))


@query(f"WITH {EV} SELECT rec, id, count(*) FILTER (WHERE kind = 'view') OVER (PARTITION BY rec ORDER BY id ROWS UNBOUNDED PRECEDING) AS place FROM ev")
def queue_positions(spark, d):
    order = Window.partitionBy("rec").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    return ev(spark, d).select("rec", "id", F.count_if(F.col("kind") == "view").over(order).alias("place"))


@query(f"""WITH {EV}, r AS (SELECT rec, s, e FROM ev WHERE kind = 'click'), {islands('r', 'u')}, g AS (SELECT rec, id // 3 AS grp, s, e FROM ev WHERE kind = 'view'),
h AS (SELECT g.rec, g.grp, sum(least(g.e, u.e) - greatest(g.s, u.s)) AS covered FROM g JOIN u ON g.rec = u.rec AND least(g.e, u.e) - greatest(g.s, u.s) > 2 GROUP BY g.rec, g.grp),
t AS (SELECT rec, grp, sum(e - s) AS total FROM g GROUP BY rec, grp)
SELECT t.rec, t.grp, CAST(total AS BIGINT) AS total, CAST(covered AS BIGINT) AS covered FROM t JOIN h ON t.rec = h.rec AND t.grp = h.grp WHERE total - covered > 2""")
def partial_groups(spark, d):
    rows = ev(spark, d, "view").select("rec", F.floor(F.col("id") / 3).alias("grp"), "s", "e")
    return captions.partly_hit(rows, ev(spark, d, "click").select("rec", "s", "e"), ["rec"], "grp", WIDTH)


@query(f"""WITH {SENTENCES}, x AS (SELECT rec, id, s, CASE WHEN id % 2 = 0 THEN e + 200 ELSE e + 900 END AS e FROM sentences), y AS (SELECT *, lag(e) OVER w - s AS b, e - lead(s) OVER w AS a FROM x WINDOW w AS (PARTITION BY rec ORDER BY s, id))
SELECT rec, id, CASE WHEN b BETWEEN 1 AND 351 THEN s + b - b // 2 ELSE s END AS s, CASE WHEN a BETWEEN 1 AND 351 THEN e - a // 2 ELSE e END AS e FROM y""")
def split_overlaps(spark, d):
    rows = sentences(spark, d).select("rec", "id", "s", F.when(F.col("id") % 2 == 0, F.col("e") + 200).otherwise(F.col("e") + 900).alias("e"))
    return captions.split_overlaps(rows)


@query(f"""WITH {SENTENCES}, b AS (SELECT rec, min(s) AS lo, max(e) AS hi FROM sentences GROUP BY rec), c AS (SELECT rec, s, e FROM sentences WHERE id % 3 <> 0),
every AS (SELECT rec, s, e FROM c UNION ALL SELECT rec, lo, lo FROM b UNION ALL SELECT rec, hi, hi FROM b), g AS (SELECT rec, max(e) OVER (PARTITION BY rec ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s, s AS e FROM every)
SELECT g.rec, g.s, g.e FROM g WHERE g.e - g.s > 100 AND NOT EXISTS (SELECT 1 FROM sentences t WHERE t.rec = g.rec AND t.id % 6 = 0 AND least(t.e, g.e) > greatest(t.s, g.s))""")
def unexplained_cuts(spark, d):
    """Deletions that no applied cut explains; the slivers between rows are shorter than a tenth of a second."""
    rows = sentences(spark, d)
    box = rows.groupBy("rec").agg(F.min("s").alias("lo"), F.max("e").alias("hi"))
    applied = rows.where("id % 6 = 0").select("rec", (F.col("s") - 10).alias("s"), (F.col("e") + 10).alias("e"))
    return captions.unexplained(rows.where("id % 3 <> 0").select("rec", "s", "e"), applied, box, ["rec"], WIDTH // 60).where("e - s > 100")


@query(f"""WITH {EV}, x AS (SELECT rec, CASE id % 5 WHEN 0 THEN 'done' WHEN 1 THEN 'partial' WHEN 2 THEN 'odd' ELSE 'failed' END AS status, kind, id FROM ev), w AS (SELECT rec, kind, min(id) AS first FROM x WHERE status <> 'done' GROUP BY rec, kind)
SELECT x.rec, count(*) FILTER (WHERE status = 'done') AS done, count(*) FILTER (WHERE status = 'partial') AS partly, count(*) FILTER (WHERE status NOT IN ('done', 'partial')) AS failed,
(SELECT string_agg(kind, ',' ORDER BY first) FROM w WHERE w.rec = x.rec) AS warnings FROM x GROUP BY x.rec""")
def alignment_summary(spark, d):
    status = F.when(F.col("id") % 5 == 0, "done").when(F.col("id") % 5 == 1, "partial").when(F.col("id") % 5 == 2, "odd").otherwise("failed")
    rows = ev(spark, d).select("rec", status.alias("status"), "kind", "id")
    told = F.sort_array(F.collect_list(F.when(F.col("status") != "done", F.struct("id", "kind"))))
    out = rows.groupBy("rec").agg(F.count_if(F.col("status") == "done").alias("done"), F.count_if(F.col("status") == "partial").alias("partly"), F.count_if(~F.col("status").isin("done", "partial")).alias("failed"), told.alias("told"))
    return out.select("rec", "done", "partly", "failed", F.array_join(F.slice(F.array_distinct("told.kind"), 1, 6), ",").alias("warnings"))


@query("SELECT user_id, arg_max(CAST(floor(value * 1000) AS BIGINT), (ts, event_id)) - arg_min(CAST(floor(value * 1000) AS BIGINT), (ts, event_id)) AS growth, max(CAST(floor(value * 1000) AS BIGINT)) AS peak FROM events GROUP BY user_id")
def peak_counters(spark, d):
    value, at = F.floor(F.col("value") * 1000).cast("long"), F.struct("ts", "event_id")
    return read(spark, d, "events").groupBy("user_id").agg((F.max_by(value, at) - F.min_by(value, at)).alias("growth"), F.max(value).alias("peak"))


@query("""WITH f AS (SELECT source AS path, max(n_chars) AS bytes, bool_or(lang = 'de') AS protected FROM documents GROUP BY source)
SELECT CAST(sum(bytes) AS BIGINT) AS total, CAST(coalesce(sum(bytes) FILTER (WHERE protected), 0) AS BIGINT) AS kept, count(*) FILTER (WHERE protected) AS kept_files, sum(bytes) > 100000 AS over FROM f""".replace(" AS over FROM", ' AS "over" FROM'))
def cache_totals(spark, d):
    files = read(spark, d, "documents").groupBy("source").agg(F.max("n_chars").alias("bytes"), F.bool_or(F.col("lang") == "de").alias("protected"))
    return files.agg(F.sum("bytes").alias("total"), F.coalesce(F.sum(F.when(F.col("protected"), F.col("bytes"))), F.lit(0)).alias("kept"), F.count_if("protected").alias("kept_files"), (F.sum("bytes") > 100_000).alias("over"))


@query("""SELECT CASE WHEN l.doc_id IS NULL THEN 'not_measured' ELSE 'measured' END AS state, count(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1""")
def acceptance_counts(spark, d):
    rows = read(spark, d, "documents").select("doc_id").join(read(spark, d, "labels").select("doc_id", F.lit(1).alias("hit")), "doc_id", "left")
    return rows.groupBy(F.when(F.col("hit").isNull(), "not_measured").otherwise("measured").alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH a AS (SELECT vec_id, unnest(embedding) AS x, unnest(generate_series(0, len(embedding) - 1)) AS i FROM embeddings), p AS (SELECT a.vec_id, CAST(a.x AS DOUBLE) AS x, CAST(b.x AS DOUBLE) AS y FROM a JOIN a b ON b.vec_id = a.vec_id + 1 AND a.i = b.i)
SELECT vec_id, CAST(round(max(abs(x - y)) * 100000) AS BIGINT) AS worst, CAST(round(sqrt(avg((x - y) * (x - y))) * 100000) AS BIGINT) AS rms, CAST(round(corr(x, y) * 100000) AS BIGINT) AS corr FROM p GROUP BY vec_id""")
def waveform_regression(spark, d):
    a = read(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("x"))
    pairs = a.join(a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id").select("vec_id", F.explode(F.arrays_zip("x", "y")).alias("z")).select("vec_id", F.col("z.x").cast("double").alias("x"), F.col("z.y").cast("double").alias("y"))
    n, gap = lambda c: F.round(c * 100_000).cast("long"), F.col("x") - F.col("y")
    return pairs.groupBy("vec_id").agg(n(F.max(F.abs(gap))).alias("worst"), n(F.sqrt(F.avg(gap * gap))).alias("rms"), n(F.corr("x", "y")).alias("corr"))


@query("""WITH x AS (SELECT conv_id, turn, length(coalesce(text, '')) AS n, row_number() OVER w AS place, sum(length(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS used FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC))
SELECT conv_id, turn FROM x WHERE used <= 1200 AND place <= 24""")
def history_budget(spark, d):
    """The newest turns of a conversation that fit into a budget."""
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    rows = read(spark, d, "conversations").select("conv_id", "turn", F.row_number().over(order).alias("place"), F.sum(F.length(F.coalesce("text", F.lit("")))).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("used"))
    return rows.where("used <= 1200 AND place <= 24").select("conv_id", "turn")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus IN ('P', 'O') THEN 'interrupted' ELSE 'done' END AS state, o_orderstatus IN ('P', 'O') AS changed FROM orders")
def interrupted_update(spark, d):
    """Tasks that were under way when the service stopped are marked as interrupted."""
    busy = F.col("o_orderstatus").isin("P", "O")
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(busy, "interrupted").otherwise("done").alias("state"), busy.alias("changed"))


@query("SELECT o_orderkey AS id, CAST(ceil(o_totalprice * 1.08) AS BIGINT) + 5 * 4096 AS bytes FROM orders")
def storage_estimate(spark, d):
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.ceil(F.col("o_totalprice") * F.lit(1.08)) + 5 * 4096).cast("long").alias("bytes"))


@query("""SELECT DISTINCT l_orderkey AS id, l_returnflag AS quote, l_linestatus AS role FROM lineitem""")
def evidence_union(spark, d):
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("quote"), F.col("l_linestatus").alias("role")).dropDuplicates()


@query("""SELECT l_orderkey AS id FROM lineitem GROUP BY l_orderkey HAVING list_has_any(list(l_partkey), (SELECT list(p_partkey) FROM part WHERE p_size = 7))""")
def exports_touching(spark, d):
    """Exports with a clip among those that were rejected."""
    rejected = read(spark, d, "part").where("p_size = 7").select(F.col("p_partkey").alias("l_partkey"))
    return read(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(rejected, "l_partkey", "left_semi").select(F.col("l_orderkey").alias("id")).distinct()
