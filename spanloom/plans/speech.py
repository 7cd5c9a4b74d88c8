"""Registered queries: words found again in their texts, local windows, streams, and proposals to cut speech."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import speech as sp
from .catalogue import query
from .views import SENTENCES, sentences

#: The normal form as DuckDB has it: enough for texts without compatibility characters.
_PLAIN = "replace(lower(regexp_replace({}, '[\\s\\p{{P}}]+', '', 'g')), 'ß', 'ss')"

#: What the speakers of conversations are made to say, as an aligner and a listener would report it.
REPEATS, CLEANUP = ("retakes", "fillers"), ("repeats", "greetings")
#: Characters from which a row's last word is not aligned, and from which its windows are not complete either.
LONG, VERY_LONG = 600, 900


def spoken(spark: SparkSession, d: str) -> DataFrame:
    """Rows of speech: assistants stumble over their first word, users start with a filler, others end in laughter.

    Words have 50 ms a character. Long rows lack their last word; windows of their first three and four words stand in.
    """
    role, first = F.col("role"), F.split_part("text", F.lit(" "), F.lit(1))
    said = F.when(role == "assistant", F.concat(first, F.lit(" "), "text")).when(role == "user", F.concat(F.lit("嗯 "), "text")).otherwise(F.concat("text", F.lit(" 哈哈")))
    rows = sentences(spark, d).select("rec", "id", "role", "s", said.alias("text"))
    words = rows.select("rec", "id", "s", F.posexplode(F.split("text", " ")).alias("at", "text"))
    before = Window.partitionBy("rec", "id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("s") + 50 * F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0))
    words = words.withColumns({"s": start, "plain": tx.normalized("text")}).where("text <> ''")
    word = F.struct("at", F.col("at").cast("string").alias("id"), "text", "plain", "s", (F.col("s") + 50 * F.length("text") - 10).alias("e"), F.lit("forced_alignment").alias("method"))
    words = words.groupBy("rec", "id").agg(F.transform(F.array_sort(F.collect_list(word)), lambda w: F.struct(*[w[x].alias(x) for x in ("id", "text", "plain", "s", "e", "method")])).alias("words"))
    rows = rows.withColumns({"e": F.col("s") + 50 * F.length("text") - 10, "plain": tx.normalized("text")}).join(words, ["rec", "id"])
    n = F.length("text")

    def window(name: str, k: int) -> F.Column:
        taken = F.slice("words", 1, k)
        end = ((F.element_at(taken, -1)["e"] - F.col("s") + 10) / 50).cast("int")
        return F.when(F.size(taken) == k, F.struct(
            F.lit(name).alias("id"), F.lit(0).alias("char_start"), end.alias("char_end"), F.substring("text", F.lit(1), end).alias("text"), F.array_join(F.transform(taken, lambda w: w["plain"]), "").alias("plain"),
            (n <= VERY_LONG).alias("complete"), F.col("s").alias("s"), F.element_at(taken, -1)["e"].alias("e"), taken.alias("words"),
        ))

    short = F.when(n > LONG, F.slice("words", 1, F.greatest(F.size("words") - 1, F.lit(0)))).otherwise(F.col("words"))
    rows = rows.withColumn("windows", F.array_compact(F.array(window("w0", 3), window("w1", 4)))).withColumn("words", short)
    return rows.select(
        "rec", "id", "role", "s", "e", "text", "plain", "words", "windows", ((role == "system") & (n > 300)).alias("edited"), F.when(role == "system", "neutral").alias("emotion"),
        F.when(role == "system", "speech").alias("event"), F.when(role == "user", " late ").otherwise("").alias("warning"), F.lit(1000).cast("long").alias("lo"), (F.max("e").over(Window.partitionBy("rec")) - 1000).alias("hi"),
    )


_WINDOW = """CASE WHEN len(words) >= {k} THEN [{{'window': '{name}', 's': s, 'e': words[{k}].e, 'words': list_transform(words[1:{k}], lambda w: {{'id': w.id, 'text': w.text, 'plain': w.plain, 's': w.s, 'e': w.e,
  'char_start': ((w.s - s) // 50)::INTEGER, 'char_end': ((w.s - s) // 50 + length(w.text))::INTEGER}})}}] ELSE [] END"""

SPOKEN = f"""said AS (
  SELECT rec, id, role, s, CASE role WHEN 'assistant' THEN split_part(text, ' ', 1) || ' ' || text WHEN 'user' THEN '嗯 ' || text ELSE text || ' 哈哈' END AS text FROM sentences
), cut_up AS (
  SELECT *, s + 50 * length(text) - 10 AS e, {_PLAIN.format('text')} AS plain, string_split(text, ' ') AS tokens FROM said
), all_words AS (
  SELECT * EXCLUDE tokens, max(e) OVER (PARTITION BY rec) - 1000 AS hi, list_filter(list_transform(tokens, lambda x, i: {{'id': (i - 1)::VARCHAR, 'text': x, 'plain': {_PLAIN.format('x')},
    's': (s + 50 * coalesce(list_sum(list_transform(tokens[1:i - 1], lambda y: length(y) + 1)), 0))::BIGINT,
    'e': (s + 50 * (coalesce(list_sum(list_transform(tokens[1:i - 1], lambda y: length(y) + 1)), 0) + length(x)) - 10)::BIGINT, 'char_start': NULL::INTEGER, 'char_end': NULL::INTEGER}}), lambda w: w.text <> '') AS words FROM cut_up
), spoken AS (
  SELECT rec, id, role, s, e, hi, text, plain, CASE WHEN length(text) > {LONG} THEN words[1:len(words) - 1] ELSE words END AS words,
    CASE WHEN length(text) <= {VERY_LONG} THEN list_concat({_WINDOW.format(k=3, name='w0')}, {_WINDOW.format(k=4, name='w1')}) ELSE [] END AS windows,
    role = 'system' AND length(text) > 300 AS edited FROM all_words
), streamed AS (
  SELECT *, CASE WHEN edited THEN [] WHEN len(words) > 0 AND len(list_filter(words, lambda w: w.plain = '')) = 0 AND array_to_string(list_transform(words, lambda w: w.plain), '') = plain
    THEN [{{'window': NULL::VARCHAR, 's': s, 'e': e, 'words': words}}] ELSE list_filter(windows, lambda x: len(list_filter(x.words, lambda w: w.plain = '')) = 0) END AS streams FROM spoken
)"""


# ---- words and texts ----


_MARKS = "[\\s\\p{P}]"


@query(f"""WITH {SENTENCES}, {SPOKEN}, w AS (SELECT rec, id, text, s, words, array_to_string(list_transform(words, lambda w: w.plain), '') = plain AS covered, unnest(range(1, len(words))) AS i FROM spoken WHERE len(words) > 1),
r AS (SELECT rec, id, i, text, covered AND (words[i].plain <> '' OR words[i + 1].plain <> '') AS literal, words[i].text AS x, words[i + 1].text AS y, (words[i].s - s) // 50 AS a, (words[i + 1].s - s) // 50 + length(words[i + 1].text) AS b FROM w)
SELECT rec, id, i - 1 AS first, CASE WHEN literal THEN
    regexp_replace(regexp_replace(substring(text, a + 1, b - a) || regexp_extract(substring(text, b + 1), '^{_MARKS}*'), '^{_MARKS}+', ''), '\\s+$', '')
  ELSE x || CASE WHEN regexp_matches(x, '[A-Za-z]$') AND regexp_matches(y, '^[A-Za-z]') AND length(y) > 1 THEN ' ' ELSE '' END || y END AS told FROM r""")
def recovered_text(spark, d):
    """What the row has for each pair of neighbouring words, in its own spelling and with the marks that follow."""
    rows = spoken(spark, d).where(F.size("words") > 1).withColumn("mapped", sp.normal_map(F.col("text"), F.transform("words", lambda w: w["plain"])))
    told = F.transform(F.sequence(F.lit(0), F.size("words") - 2), lambda i: sp.recovered_text(F.col("text"), F.col("words"), F.col("mapped"), i, i + 1))
    return rows.select("rec", "id", F.posexplode(told).alias("first", "told"))


@query(f"""WITH RECURSIVE {SENTENCES}, {SPOKEN}, w AS (SELECT rec, id, text, unnest(words) AS w, unnest(range(1, len(words) + 1)) AS i FROM spoken),
f AS (SELECT rec, id, 0 AS i, 1::BIGINT AS cursor, NULL::BIGINT AS at FROM spoken UNION ALL
  SELECT f.rec, f.id, w.i, CASE WHEN instr(substring(w.text, f.cursor), w.w.text) > 0 THEN f.cursor + instr(substring(w.text, f.cursor), w.w.text) - 1 + length(w.w.text) ELSE f.cursor END,
    CASE WHEN instr(substring(w.text, f.cursor), w.w.text) > 0 THEN f.cursor + instr(substring(w.text, f.cursor), w.w.text) - 2 END FROM f JOIN w ON w.rec = f.rec AND w.id = f.id AND w.i = f.i + 1)
SELECT f.rec, f.id, f.i - 1 AS place, f.at::INTEGER AS char_start, (f.at + length(w.w.text))::INTEGER AS char_end,
  CASE WHEN x.id IS NULL THEN 'coverage' END AS violation FROM f JOIN w ON w.rec = f.rec AND w.id = f.id AND w.i = f.i
  LEFT JOIN (SELECT rec, id FROM spoken WHERE array_to_string(list_transform(words, lambda w: w.plain), '') = plain AND len(list_filter(words, lambda w: w.plain = '')) = 0) x ON x.rec = f.rec AND x.id = f.id""")
def located_words(spark, d):
    """Where each word stands in its row, looked for after the one before, and whether the row's words are all its text."""
    rows = spoken(spark, d)
    rows = rows.withColumns({"violation": sp.alignment_violation(F.col("plain"), F.col("words"), F.col("s"), F.col("e")), "places": sp.places_in(F.array("text"), F.array(F.transform("words", lambda w: w["text"])))})
    rows = rows.withColumn("found", sp.located(F.col("words"), F.get("places", F.lit(0))))
    violation = F.when(F.col("violation").isin("coverage", "no_text"), "coverage").otherwise(F.col("violation"))
    return rows.select("rec", "id", violation.alias("violation"), F.posexplode("found").alias("place", "w")).select("rec", "id", "place", "w.char_start", "w.char_end", "violation")


_FILLER = f"[{sp.FILLERS}]"


@query()
def local_windows(spark, d):
    """Where to listen again around repeats and fillers: a lateral join with a table function."""
    rows = spoken(spark, d)
    token = F.transform("words", lambda w: F.struct(w["text"].alias("text"), w["s"].alias("anchor")))
    rows = rows.select("rec", "id", F.col("text").alias("row_text"), F.col("s").alias("row_s"), F.col("e").alias("row_e"), token.alias("tokens"))
    return rows.lateralJoin(sp.LocalWindows(*[F.col(c).outer() for c in ("row_text", "row_s", "row_e", "tokens")])).select("rec", "id", "char_start", "char_end", "text", "s", "e")


@query(f"WITH {SENTENCES}, {SPOKEN}, x AS (SELECT rec, id, unnest(streams) AS x FROM streamed) SELECT rec, id, coalesce(x.window, '') AS window, x.s, x.e, len(x.words) AS n_words, x.words[1].char_start AS char_start, x.words[-1].char_end AS char_end FROM x")
def timed_streams(spark, d):
    """What of each row can be worked on: all its words, or the windows whose words can be relied on."""
    rows = sp.timed_streams(spoken(spark, d)).select("rec", "id", F.explode("streams").alias("x"))
    return rows.select("rec", "id", F.coalesce("x.window", F.lit("")).alias("window"), "x.s", "x.e", F.size("x.words").alias("n_words"), F.get("x.words", F.lit(0))["char_start"].alias("char_start"), F.element_at("x.words", -1)["char_end"].alias("char_end"))


# ---- proposals ----

_SAME = "array_to_string(list_transform(w[i:i + {m}], lambda x: x.plain), '') = array_to_string(list_transform(w[i + {n}:i + {n} + {m}], lambda x: x.plain), '')"
_WIDTH_OF = " ".join(f"WHEN i + {2 * n - 1} <= len(w) AND {_SAME.format(n=n, m=n - 1)} THEN {n}" for n in (4, 3, 2, 1))

_CUTS = f"""each AS (SELECT rec, id, role, text, hi, k, x.window AS win, x.s AS ss, x.e AS se, x.words AS w, unnest(range(1, len(x.words) + 1)) AS i
  FROM (SELECT *, unnest(streams) AS x, unnest(range(1, len(streams) + 1)) AS k FROM streamed)),
hits AS (SELECT *, 'retakes' AS kind, CASE {_WIDTH_OF} END AS n FROM each UNION ALL SELECT *, 'fillers', CASE WHEN list_contains(string_split('{sp.FILLERS}', ''), w[i].plain) THEN 1 END FROM each),
placed AS (SELECT *, greatest(CASE WHEN i > 1 THEN w[i - 1].e ELSE ss END, w[i].s - 25) AS a, least(coalesce(w[i + n].s, se), w[i + n - 1].e + 25) AS b, w[i].s AS a0, w[i + n - 1].e AS b0, w[i].char_start AS c0, w[i + n - 1].char_end AS c1,
  array_to_string(list_transform(w[i:i + n - 1], lambda x: x.text), '') AS said, array_to_string(list_transform(w[i:i + n - 1], lambda x: x.plain), '') AS pl FROM hits WHERE n IS NOT NULL),
once AS (SELECT * FROM placed QUALIFY win IS NULL OR row_number() OVER (PARTITION BY rec, id, kind, c0, c1 ORDER BY k, i) = 1),
cuts AS (SELECT rec, id AS row, 'word:' || id || ':' || coalesce(win || ':', '') || (i - 1) || ':' || (i - 1 + n) || ':' || kind AS cand_id, kind, a AS s, b AS e, CASE WHEN win IS NULL THEN said ELSE substring(text, c0 + 1, c1 - c0) END AS quote,
  CASE WHEN a > a0 + 2 OR b < b0 - 2 THEN 'partial_word' WHEN kind = 'retakes' AND regexp_matches(pl, '{sp.MEASURES}') THEN 'one_by_one'
    WHEN b - a < 80 OR regexp_full_match(pl, '({sp.REACTION})+') OR regexp_matches(said, '{sp.EMOTION_WORDS}') THEN 'short_or_reaction' END AS reason,
  concat_ws(',', 'forced_alignment', CASE WHEN win IS NOT NULL THEN 'source_window' END, CASE WHEN role = 'system' THEN 'asr_hint' END, CASE WHEN kind = 'retakes' THEN 'tandem_repeat' END) AS evidence, hi FROM once)"""


@query(f"""WITH {SENTENCES}, {SPOKEN}, {_CUTS}, whole AS (SELECT rec, id AS row, 'row:' || id AS cand_id, 'semantic' AS kind, greatest(1000, s) AS s, least(hi, e) AS e, text AS quote,
  CASE WHEN regexp_full_match(plain, '({sp.REACTION}){{2,}}') OR regexp_matches(text, '{sp.EMOTION_WORDS}') THEN 'emotion' WHEN least(hi, e) - greatest(1000, s) > 4000 AND 1000 * length(plain) < least(hi, e) - greatest(1000, s) THEN 'sparse' END AS reason,
  concat_ws(',', 'source_segment', CASE WHEN regexp_matches(text, '{sp.GREETINGS}') THEN 'greeting_phrase' END) AS evidence, hi FROM streamed WHERE least(hi, e) > greatest(1000, s)),
pairs AS (SELECT rec, id, bool_or(substring(plain, p, n) = substring(plain, p + n, n) AND p + 2 * n - 1 <= length(plain)) AS repeats FROM (SELECT rec, id, plain, unnest(range(1, length(plain) + 1)) AS p FROM streamed WHERE len(streams) = 0), range(1, 5) r(n) GROUP BY rec, id),
timing AS (SELECT x.rec, x.id AS row, 'timing:' || x.id AS cand_id, 'retakes' AS kind, NULL::BIGINT AS s, NULL::BIGINT AS e, text AS quote, CASE WHEN role = 'user' THEN 'late' ELSE 'no_reliable_words' END AS reason, 'alignment' AS evidence, hi
  FROM streamed x LEFT JOIN pairs p ON p.rec = x.rec AND p.id = x.id WHERE len(streams) = 0 AND (p.repeats OR regexp_matches(plain, '{_FILLER}'))),
made AS (SELECT * FROM whole UNION ALL SELECT * FROM timing UNION ALL SELECT * FROM cuts)
SELECT rec, row, cand_id, kind, s, e, quote, CASE WHEN coalesce(s < 998 OR e > hi + 2, false) OR reason IS NOT NULL THEN 'blocked' ELSE 'suggested' END AS status,
  CASE WHEN coalesce(s < 998 OR e > hi + 2, false) THEN 'outside_clip' ELSE reason END AS reason, evidence FROM made""")
def speech_candidates(spark, d):
    """Everything that may be cut from speech, and why what may not; the transcript is read once."""
    found = sp.speech_candidates(spoken(spark, d), CLEANUP, REPEATS)
    return found.withColumn("evidence", F.array_join("evidence", ","))
