"""Words inside rows: literal places, reliable streams, and proposals to cut, all from one pass over the rows.

A row carries its words as an array of (id, text, plain, s, e, method), so that everything about a row is
decided by array functions where the row is. Only the Unicode normal form of texts needs Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from ..functions.text import normalize_text

#: Tolerance, how far a word may stand outside its row, and what a cut takes beside a word, in milliseconds.
EPSILON_MS, OUTSIDE_MS, BESIDE_MS = 2, 120, 25
#: Most words of an aligned row, widest repeat in words, shortest cut, and when a transcript is too sparse to cut.
MOST_WORDS, WIDEST, SHORTEST_MS, SPARSE_MS = 1500, 4, 80, 4_000
#: Around a local window in milliseconds, its bounds, and most windows of a row.
WINDOW_BEFORE_MS, WINDOW_AFTER_MS, WINDOW_MS, MOST_WINDOWS = 80, 700, (150, 8_000), 12
#: Syllables that fill, words and syllables that show emotion, and labels that count as either.
FILLERS = "嗯呃额唔"
EMOTION_WORDS = "哭|呜呜|哈哈|呵呵|哽咽|抽泣|心疼|难过|自责|伤心|好疼|好痛"
REACTION = "哈|呵|呜|嘿|啊|唔"
EMOTIONS = ("sad", "angry", "fearful", "disgusted")
EVENTS = ("cry", "crying", "laugh", "laughter", "music", "singing")
#: Measure words whose repetition means "one by one", and phrases of routine thanks.
MEASURES = "^一[个句次步点遍本件条张段字口天回]$"
GREETINGS = "谢谢.{0,12}(礼物|关注|舰长)|欢迎.{0,8}(回来|加入)|感谢.{0,8}(礼物|支持)"


# ---- literal places ----


_INTS = ArrayType(IntegerType())


@F.pandas_udf(StructType([StructField("plain", StringType()), StructField("at", _INTS), StructField("until", _INTS), StructField("starts", _INTS)]))
def normal_map(text: pd.Series, plains: pd.Series) -> pd.DataFrame:
    """The normal form of each text, made code point by code point, and where its code points come from.

    ``at`` is the place of each in the text, ``until`` the next place in the text that has a normal form (or the end);
    ``starts`` are the running sums, from 0, of the lengths of the words' normal forms.
    """
    out = []
    for x, words in zip(text, plains, strict=True):
        parts = [normalize_text(c) for c in x or ""]
        places = [i for i, p in enumerate(parts) if p]
        after = dict(zip(places, [*places[1:], len(parts)], strict=False))
        at = [i for i, p in enumerate(parts) for _ in p]
        out.append(("".join(parts), at, [after[i] for i in at], [0, *accumulate(len(w or "") for w in (words if words is not None else ()))]))
    return pd.DataFrame(out, columns=["plain", "at", "until", "starts"])


@F.pandas_udf(ArrayType(_INTS))
def places_in(texts: pd.Series, words: pd.Series) -> pd.Series:
    """For each text of a row the places of its words, each looked for after the one before; null where it is not there."""

    def places(text: str | None, told: list) -> list[int | None]:
        out, cursor = [], 0
        for w in told:
            at = -1 if text is None or not w else text.find(w, cursor)
            out.append(None if at < 0 else at)
            cursor = cursor if at < 0 else at + len(w)
        return out

    return pd.Series([None if x is None else [places(t, w) for t, w in zip(x, ws, strict=True)] for x, ws in zip(texts, words, strict=True)])


def joined(words: Column) -> Column:
    """Texts in order, with a space only between a Latin letter and a Latin word of several characters."""
    step = lambda told, w: F.concat(told, F.when(told.rlike("[A-Za-z]$") & w.rlike("^[A-Za-z]") & (F.length(w) > 1), F.lit(" ")).otherwise(""), w)
    return F.aggregate(words, F.lit(""), step)


def recovered_text(text: Column, words: Column, mapped: Column, first: Column, last: Column) -> Column:
    """The original wording of the words from ``first`` up to and with ``last`` (numbers from 0), with the marks that follow.

    words is an array of (text, plain), mapped the ``normal_map`` of the text and the words' normal forms. Where those
    together have the length of the text's, places come from the running sums; else, or where the range has nothing in
    normal form, the words are joined. Ranges that are inverted or leave the words give null.
    """
    a, b = F.get(mapped["starts"], first), F.get(mapped["starts"], last + 1)
    covered = (F.element_at(mapped["starts"], -1) == F.length(mapped["plain"])) & (b > a)
    start = F.get(mapped["at"], a)
    literal = F.regexp_replace(F.substring(text, start + 1, F.get(mapped["until"], b - 1) - start), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    plainly = joined(F.transform(F.slice(words, first + 1, F.greatest(last - first + 1, F.lit(0))), lambda w: w["text"]))
    return F.when((first >= 0) & (first <= last) & (last < F.size(words)), F.coalesce(F.when(covered, literal), plainly))


def source_text(text: Column, words: Column, mapped: Column, first: Column, last: Column) -> Column:
    """As ``recovered_text``, but words that know their places (char_start, char_end) and have there what they say are taken at their word."""
    a, b, at = F.get(words, first)["char_start"], F.get(words, last)["char_end"], mapped["at"]
    before = lambda place: F.size(F.filter(at, lambda x: x < place))
    there = F.substring(mapped["plain"], before(a) + 1, before(b) - before(a))
    told = F.array_join(F.transform(F.slice(words, first + 1, F.greatest(last - first + 1, F.lit(0))), lambda w: w["plain"]), "")
    until = F.coalesce(F.array_min(F.filter(at, lambda x: x >= b)), F.length(text))
    literal = F.regexp_replace(F.substring(text, a + 1, until - a), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    fits = (first >= 0) & (first <= last) & (last < F.size(words)) & (a >= 0) & (a < b) & (b <= F.length(text)) & (there == told)
    return F.when(F.coalesce(fits, F.lit(False)), literal).otherwise(recovered_text(text, words, mapped, first, last))


def located(words: Column, places: Column, base: Column | None = None) -> Column:
    """``words`` with char_start and char_end from their places in a text that starts at ``base``; null where they have none."""
    base = F.lit(0) if base is None else base
    return F.transform(
        words,
        lambda w, i: F.struct(
            *[w[x].alias(x) for x in ("id", "text", "plain", "s", "e", "method")], (base + F.get(places, i)).cast("int").alias("char_start"),
            (base + F.get(places, i) + F.length(w["text"])).cast("int").alias("char_end"),
        ),
    )


def _neighbours_in_order(words: Column, s: Column, e: Column, slack: int, outside: int) -> Column:
    """Whether every word has a length, starts no earlier than the one before ends, and stays in the row, but for the given slack."""
    before = lambda i: F.coalesce(F.get(words, i - 1)["e"], s - outside)
    fits = F.transform(words, lambda w, i: (w["e"] > w["s"]) & (w["s"] >= before(i) - slack) & (w["s"] >= s - outside - slack) & (w["e"] <= e + outside + slack))
    return F.forall(fits, lambda x: F.coalesce(x, F.lit(False)))


def alignment_violation(plain: Column, words: Column, s: Column, e: Column) -> Column:
    """The first rule that an aligner's answer for a row breaks: none or too many words, a word without text, bounds, coverage; null if none."""
    texts = F.forall(words, lambda w: F.coalesce(w["plain"] != "", F.lit(False)))
    whole = F.array_join(F.transform(words, lambda w: w["plain"]), "") == plain
    return (
        F.when(words.isNull() | (F.size(words) == 0) | (F.size(words) > MOST_WORDS), "incomplete").when(~texts, "no_text")
        .when(~_neighbours_in_order(words, s, e, 1, 0), "bounds").when(~whole, "coverage")
    )


# ---- local windows ----


_WINDOW = StructType([StructField("char_start", IntegerType()), StructField("char_end", IntegerType()), StructField("text", StringType()), StructField("s", LongType()), StructField("e", LongType())])


@F.udtf(returnType=_WINDOW, useArrow=False)
class LocalWindows:
    """The parts of a row around repeats and fillers, for a lateral join: 0 to MOST_WINDOWS rows for each row.

    Tokens (text, anchor in ms) have to spell the row's normal form in order, anchors may not go back or leave the
    row; otherwise there is no window. A window takes a character of context on both sides and says only where to listen.
    """

    def eval(self, text: str, s: int, e: int, tokens: list) -> Iterator[tuple]:
        parts = [normalize_text(c) for c in text or ""]
        plain, at = "".join(parts), [i for i, p in enumerate(parts) for _ in p]
        anchors, spelled, last = [], "", None if s is None else s - 2
        for token in tokens or []:
            anchor, told = token["anchor"], normalize_text(token["text"] or "")
            if s is None or e is None or anchor is None or anchor < last or anchor > e + 1:
                return
            last = anchor - 1
            spelled += told
            anchors += [anchor] * len(told)
        if not plain or spelled != plain:
            return
        # Repeats first, then fillers, each in order of place.
        hits = [m.span() for m in regex.finditer(r"(.{1,4})\1", plain, regex.DOTALL)] + [m.span() for m in regex.finditer(f"[{FILLERS}]", plain)]
        given = {}
        for a, b in hits:
            left, right = max(0, a - 1), min(len(plain), b + 1)
            place = at[left], at[right - 1] + 1
            start, end = max(s, anchors[left] - WINDOW_BEFORE_MS), min(e, anchors[right - 1] + WINDOW_AFTER_MS)
            if place not in given:
                given[place] = WINDOW_MS[0] <= end - start <= WINDOW_MS[1] and anchors[left] <= anchors[right - 1]
                if given[place]:
                    yield *place, text[place[0] : place[1]], start, end
            if sum(given.values()) == MOST_WINDOWS:
                return


# ---- streams ----


def _reliable(words: Column, plain: Column, s: Column, e: Column) -> Column:
    """Whether measured words, each with its own id, stand in order in their row and spell it out."""
    own = (F.size(F.array_distinct(F.transform(words, lambda w: w["id"]))) == F.size(words)) & F.forall(words, lambda w: F.coalesce(w["id"].isNotNull() & (w["method"] == "forced_alignment") & (w["plain"] != ""), F.lit(False)))
    told = F.array_join(F.transform(words, lambda w: w["plain"]), "") == plain
    return F.coalesce((F.size(words) > 0) & own & _neighbours_in_order(words, s, e, EPSILON_MS, OUTSIDE_MS) & told, F.lit(False))


def timed_streams(rows: DataFrame) -> DataFrame:
    """``rows`` with ``streams``: (window, s, e, words) to work with; the row itself where all its words are reliable, else its reliable windows.

    rows: s, e, text, plain, edited, words, windows. windows is an array of (id, char_start, char_end, text, plain, complete, s,
    e, words). A window counts if it is complete, its text is what the row has at its place, its words are reliable in it,
    inside the row, and all found in its text; words of windows then carry their places in the row. Rows that a user edited have none.
    """
    blank = F.lit(None).cast("int")
    whole = F.transform("words", lambda w: F.struct(*[w[x].alias(x) for x in ("id", "text", "plain", "s", "e", "method")], blank.alias("char_start"), blank.alias("char_end")))
    full = F.struct(F.lit(None).cast("string").alias("window"), F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e"), whole.alias("words"))

    def counts(w: Column) -> Column:
        a, b = w["char_start"], w["char_end"]
        placed = (a >= 0) & (a < b) & (b <= F.length("text")) & (w["text"] == F.substring("text", a + 1, b - a))
        inside = (F.get(w["words"], F.lit(0))["s"] >= F.col("s") - OUTSIDE_MS - EPSILON_MS) & (F.element_at(w["words"], -1)["e"] <= F.col("e") + OUTSIDE_MS + EPSILON_MS)
        return F.coalesce(w["id"].isNotNull() & w["complete"] & placed & _reliable(w["words"], w["plain"], w["s"], w["e"]) & inside, F.lit(False))

    found = places_in(F.transform("windows", lambda w: w["text"]), F.transform("windows", lambda w: F.transform(w["words"], lambda x: x["text"])))
    rows = rows.withColumn("_places", found)
    kept = F.filter(F.transform("windows", lambda w, i: F.struct(w.alias("w"), F.get("_places", i).alias("at"))), lambda x: counts(x["w"]))
    local = F.transform(kept, lambda x: F.struct(x["w"]["id"].alias("window"), x["w"]["s"].cast("long").alias("s"), x["w"]["e"].cast("long").alias("e"), located(x["w"]["words"], x["at"], x["w"]["char_start"]).alias("words")))
    local = F.filter(local, lambda x: F.forall(x["words"], lambda w: w["char_start"].isNotNull()))
    usable = ~F.coalesce("edited", F.lit(False))
    none = F.array().cast("array<struct<window:string,s:bigint,e:bigint,words:array<struct<id:string,text:string,plain:string,s:bigint,e:bigint,method:string,char_start:int,char_end:int>>>>")
    streams = F.when(usable & _reliable(F.col("words"), F.col("plain"), F.col("s"), F.col("e")), F.array(full)).when(usable & F.col("windows").isNotNull(), local).otherwise(none)
    return rows.withColumn("streams", streams).drop("_places")


# ---- proposals ----


def emotional(text: Column, plain: Column, emotion: Column, event: Column) -> Column:
    """Whether a row's words, its emotion or its event (in normal form) show emotion, or it is nothing but a reaction."""
    return plain.rlike(f"^({REACTION}){{2,}}$") | F.coalesce(emotion.isin(*EMOTIONS), F.lit(False)) | F.coalesce(event.isin(*EVENTS), F.lit(False)) | text.rlike(EMOTION_WORDS)


_MADE = "array<struct<cand_id:string,kind:string,s:bigint,e:bigint,quote:string,reason:string,evidence:array<string>,key:string>>"


def _proposal(cand_id: Column, kind: Column, s: Column, e: Column, quote: Column, reason: Column, evidence: list[Column], key: Column | None = None) -> Column:
    return F.struct(
        cand_id.alias("cand_id"), kind.alias("kind"), s.cast("long").alias("s"), e.cast("long").alias("e"), quote.alias("quote"), reason.alias("reason"),
        F.array_compact(F.array(*evidence)).alias("evidence"), (F.lit(None).cast("string") if key is None else key).alias("key"),
    )


def _cut(stream: Column, first: Column, width: Column, kind: str) -> Column:
    """A proposal to cut ``width`` words of a stream, with the room beside them that belongs to no other word."""
    words, last = stream["words"], first + width
    taken = F.slice(words, first + 1, width)
    begin, end = F.get(words, first)["s"], F.get(words, last - 1)["e"]
    left = F.when(first > 0, F.get(words, first - 1)["e"]).otherwise(stream["s"])
    a = F.greatest(left, begin - BESIDE_MS)
    b = F.least(F.coalesce(F.get(words, last)["s"], stream["e"]), end + BESIDE_MS)
    window = stream["window"]
    from_, to = F.get(words, first)["char_start"], F.get(words, last - 1)["char_end"]
    spoken = F.array_join(F.transform(taken, lambda w: w["text"]), "")
    plain = F.array_join(F.transform(taken, lambda w: w["plain"]), "")
    reaction = plain.rlike(f"^({REACTION})+$") | spoken.rlike(EMOTION_WORDS) | F.coalesce(F.col("event").isin(*EVENTS), F.lit(False))
    reason = F.when((a > begin + EPSILON_MS) | (b < end - EPSILON_MS), "partial_word")
    if kind == "retakes":
        reason = reason.when(plain.rlike(MEASURES), "one_by_one")
    reason = reason.when((b - a < SHORTEST_MS) | reaction, "short_or_reaction")
    hint = (F.coalesce("emotion", F.lit("")) != "") | (F.coalesce("event", F.lit("")) != "")
    evidence = [F.lit("forced_alignment"), F.when(window.isNotNull(), "source_window"), F.when(hint, "asr_hint"), F.lit("tandem_repeat") if kind == "retakes" else F.lit(None).cast("string")]
    name = F.concat_ws(":", F.lit("word"), F.col("id").cast("string"), window, first.cast("string"), last.cast("string"), F.lit(kind))
    quote = F.when(window.isNull(), spoken).otherwise(F.substring("text", from_ + 1, to - from_))
    key = F.when(window.isNotNull(), F.concat_ws(":", F.lit(kind), from_.cast("string"), to.cast("string")))
    return _proposal(name, F.lit(kind), a, b, quote, reason, evidence, key)


def _repeat_width(words: Column, first: Column) -> Column:
    """How many words from ``first`` on the same number of following words repeats, the most of up to WIDEST; null if none."""
    told = lambda at, n: F.array_join(F.transform(F.slice(words, at + 1, F.lit(n)), lambda w: w["plain"]), "")
    fits = lambda n: first + 2 * n <= F.size(words)
    return F.coalesce(*[F.when(fits(n) & (told(first, n) == told(first + n, n)), n) for n in range(WIDEST, 0, -1)])


def speech_candidates(rows: DataFrame, cleanup: tuple[str, ...], speech: tuple[str, ...]) -> DataFrame:
    """rec, row, cand_id, kind, s, e, quote, status, reason, evidence: everything that may be cut, and why what may not.

    rows: rec, id, s, e, text, plain, edited, emotion, event (both in normal form), warning, words, windows (see
    ``timed_streams``), lo and hi (the clip). Each row is read once; its proposals are, if asked for:

    - the row's part in the clip (any of ``cleanup``), blocked if it shows emotion or its transcript is too sparse;
    - where no stream is reliable but repeats or fillers are written, a proposal without times, blocked;
    - words that the next words repeat (retakes), the widest repeat from each word on, and fillers, each place once
      whichever stream shows it; blocked by the first of: a part of a word, measure words, too short or a reaction.

    A proposal that leaves the clip is blocked for that, whatever else holds. Null and empty texts are never repeats or fillers.
    """
    # One row for each stream, or for a row without any; what concerns the row as a whole goes with its first.
    rows = timed_streams(rows).select(*[c for c in rows.columns if c not in ("words", "windows")], F.posexplode_outer("streams").alias("k", "stream"))
    lead, none = F.coalesce("k", F.lit(0)) == 0, F.array().cast(_MADE)
    a, b = F.greatest("lo", "s"), F.least("hi", "e")
    sparse = (b - a > SPARSE_MS) & (1000 * F.length("plain") < b - a)
    reason = F.when(emotional(F.col("text"), F.col("plain"), F.col("emotion"), F.col("event")), "emotion").when(sparse, "sparse")
    thanks = F.when(F.col("text").rlike(GREETINGS), "greeting_phrase") if "greetings" in cleanup else F.lit(None).cast("string")
    semantic = _proposal(F.concat(F.lit("row:"), F.col("id").cast("string")), F.lit("semantic"), a, b, F.col("text"), reason, [F.lit("source_segment"), thanks])
    parts = [F.when(lead & (b > a) if cleanup else F.lit(False), F.array(semantic)).otherwise(none)]
    targets = [F.col("plain").rlike(r"(?s)(.{1,4})\1")] * ("retakes" in speech) + [F.col("plain").rlike(f"[{FILLERS}]")] * ("fillers" in speech)
    if targets:
        nothing = F.lit(None).cast("long")
        told = F.substring(F.coalesce(F.nullif(F.trim("warning"), F.lit("")), F.lit("no_reliable_words")), 1, 300)
        timing = _proposal(F.concat(F.lit("timing:"), F.col("id").cast("string")), F.lit("retakes" if "retakes" in speech else "fillers"), nothing, nothing, F.col("text"), told, [F.lit("alignment")])
        parts.append(F.when(F.col("stream").isNull() & reduce(Column.__or__, targets), F.array(timing)).otherwise(none))
    stream = F.col("stream")
    if "retakes" in speech:
        widths = F.transform(stream["words"], lambda w, i: F.struct(i.alias("i"), _repeat_width(stream["words"], i).alias("n")))
        parts.append(F.transform(F.filter(widths, lambda y: y["n"].isNotNull()), lambda y: _cut(stream, y["i"], y["n"], "retakes")))
    if "fillers" in speech:
        spots = F.filter(F.transform(stream["words"], lambda w, i: F.struct(i.alias("i"), w["plain"].alias("plain"))), lambda y: y["plain"].isin(*FILLERS))
        parts.append(F.transform(spots, lambda y: _cut(stream, y["i"], F.lit(1), "fillers")))
    made = F.concat(*[F.coalesce(x.cast(_MADE), none) for x in parts])
    out = rows.select("rec", F.col("id").alias("row"), "lo", "hi", "k", F.explode(made).alias("x")).select("rec", "row", "lo", "hi", "k", "x.*")
    # Of windows that overlap, the first shows a place.
    order = F.row_number().over(Window.partitionBy("rec", "row", "key").orderBy("k", "cand_id"))
    out = out.withColumn("_seen", F.when(F.col("key").isNotNull(), order).otherwise(1)).where("_seen = 1")
    leaves = F.coalesce((F.col("s") < F.col("lo") - EPSILON_MS) | (F.col("e") > F.col("hi") + EPSILON_MS), F.lit(False))
    reason = F.when(leaves, "outside_clip").otherwise(F.col("reason"))
    return out.select("rec", "row", "cand_id", "kind", "s", "e", "quote", F.when(reason.isNotNull(), "blocked").otherwise("suggested").alias("status"), reason.alias("reason"), "evidence")
