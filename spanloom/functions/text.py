"""Text functions: built-in expressions where Spark has them, vectorised UDFs for the rest."""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

#: Shortest text that is compared, and the similarities from which rows repeat or retell each other.
MIN_COMPARED = 8
#: White space and punctuation.
_NO_TEXT = regex.compile(r"[\s\x1c-\x1f\p{P}]+")
REPEAT_SIMILARITY, STORY_SIMILARITY = 0.45, 0.92


def normalize_text(text: str | None, fold: bool = True) -> str | None:
    """NFKC without white space and punctuation, case-folded."""
    if text is None:
        return None
    told = _NO_TEXT.sub("", unicodedata.normalize("NFKC", text))
    return told.casefold() if fold else told


@F.pandas_udf(StringType())
def normalized(text: pd.Series) -> pd.Series:
    return text.map(normalize_text)


@F.pandas_udf(StringType())
def normalized_case(text: pd.Series) -> pd.Series:
    return text.map(lambda x: normalize_text(x, False))


def letters_and_digits(text: Column) -> Column:
    """Lower-case letters and digits of ASCII and Latin texts; stays in the JVM."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", ""))


def similarity_of(a: str | None, b: str | None) -> float:
    """Nothing under eight characters, all where one holds the other, else the share of matching characters."""
    if not a or not b or min(len(a), len(b)) < MIN_COMPARED:
        return 0.0
    short, long = sorted((a, b), key=len)
    return 1.0 if short in long else difflib.SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similarity_of(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def coverage_of(a: str | None, b: str | None) -> float:
    """The share of the first text that the matching blocks of both cover."""
    if not a or not b:
        return 0.0
    return sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()) / len(a)


@F.pandas_udf(DoubleType())
def coverage(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([coverage_of(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def srt_time(ms: Column) -> Column:
    """HH:MM:SS,mmm of milliseconds; nothing under zero."""
    ms = F.greatest(ms, F.lit(0)).cast("long")
    part = lambda by, of: (F.floor(ms / by) % of).cast("int")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3_600_000).cast("int"), part(60_000, 60), part(1_000, 60), (ms % 1_000).cast("int"))


def parse_time(text: Column) -> Column:
    """Milliseconds of [H:]M:S[.,]mmm; null where minutes or seconds reach 60 or anything else is not a number."""
    clean = F.replace(F.trim(text), F.lit(","), F.lit("."))
    shape = r"^(?:(\d+):)?(\d{1,2}):(\d{1,2}(?:\.\d+)?)$"
    hours, minutes, seconds = (F.regexp_extract(clean, shape, i) for i in (1, 2, 3))
    h = F.coalesce(hours.try_cast("long"), F.lit(0))
    m, s = minutes.try_cast("long"), seconds.try_cast("decimal(20,6)")
    good = clean.rlike(shape) & (m < 60) & (s < 60)
    return F.when(good, h * 3_600_000 + m * 60_000 + F.floor(s * 1000 + 0.5).cast("long"))


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]+>", "")


def safe_name(text: Column, default: str = "untitled") -> Column:
    """A file name: no reserved or control characters, no blanks or dots at its ends, 60 characters at most."""
    clean = F.regexp_replace(text, r'[<>:"/\\|?*\x00-\x1f]', "_")
    return F.coalesce(F.nullif(F.substring(F.btrim(clean, F.lit(" .")), 1, 60), F.lit("")), F.lit(default))
