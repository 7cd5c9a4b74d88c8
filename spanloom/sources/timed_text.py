"""Readers of subtitles, chat and recognised rows, and writers of subtitles and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import parse_time, srt_time, strip_tags

#: Characters of a subtitle and of a chat message, rows of a chat, and bytes of a text file.
SUBTITLE_CHARS, CHAT_CHARS, CHAT_ROWS, FILE_BYTES = 3000, 160, 300_000, 32 << 20


def read_utf8(spark: SparkSession, path: str) -> DataFrame:
    """path, text, problem of whole files: too large or not UTF-8 ones have a problem and no text; a byte order mark goes."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", "content")
    text = F.regexp_replace(F.try_validate_utf8(F.col("content").cast("string")), "^﻿", "")
    problem = F.when(F.col("length") > FILE_BYTES, "too_large").when(text.isNull(), "not_utf8")
    return files.select("path", F.when(problem.isNull(), text).alias("text"), problem.alias("problem"))


def parse_subtitles(files: DataFrame, duration_ms: Column) -> DataFrame:
    """rec, id, s, e, text of SRT or VTT files (rec, text): cues with a text that start in time, ends clamped, ids in order of time."""
    blocks = files.select("rec", duration_ms.alias("dur"), F.posexplode(F.split(F.regexp_replace("text", "\r\n?", "\n"), r"\n[\x20\t]*\n")).alias("ord", "block"))
    timing = F.regexp_extract("block", r"(?m)^(.*-->.*)$", 1)
    sides = F.split(timing, "-->")
    start, end = parse_time(F.get(sides, F.lit(0))), parse_time(F.regexp_extract(F.get(sides, F.lit(1)), r"^\s*(\S+)", 1))
    told = F.trim(strip_tags(F.array_join(F.filter(F.split(F.regexp_extract("block", r"(?s)-->[^\n]*\n(.*)$", 1), "\n"), lambda x: F.trim(x) != ""), " ")))
    cues = blocks.where(timing != "").select("rec", "ord", start.alias("s"), F.least(end, F.col("dur")).alias("e"), F.substring(told, 1, SUBTITLE_CHARS).alias("text"), "dur")
    cues = cues.where("text <> '' AND e > s AND s < dur")
    return cues.select("rec", (F.row_number().over(Window.partitionBy("rec").orderBy("s", "e", "ord")) - 1).cast("long").alias("id"), "s", "e", "text")


def _chat(rows: DataFrame, duration_ms: int) -> DataFrame:
    return rows.where(F.col("time").between(0, duration_ms) & (F.trim("text") != "")).select("time", F.substring(F.trim("text"), 1, CHAT_CHARS).alias("text"))


def read_chat_xml(spark: SparkSession, path: str, duration_ms: int, offset_ms: int = 0) -> DataFrame:
    """time, text of <d p="seconds,...">text</d> elements."""
    rows = spark.read.format("xml").option("rowTag", "d").schema("_p string, _VALUE string").load(path)
    seconds = F.split("_p", ",")[0].try_cast("double")
    return _chat(rows.select((F.floor(seconds * 1000 + 0.5).cast("long") + offset_ms).alias("time"), F.col("_VALUE").alias("text")), duration_ms)


def chat_time(row: Column) -> Column:
    """Milliseconds of a chat object in JSON: the first of time, start and offset that is present, even if null; then progress in milliseconds."""
    there = F.json_object_keys(row)
    value = lambda k: F.get_json_object(row, f"$.{k}").try_cast("double")
    first = F.when(F.array_contains(there, "time"), value("time")).when(F.array_contains(there, "start"), value("start")).when(F.array_contains(there, "offset"), value("offset"))
    return F.floor(F.coalesce(first * 1000, value("progress")) + 0.5).cast("long")


def parse_chat_json(files: DataFrame, duration_ms: int, offset_ms: int = 0) -> DataFrame:
    """time, text of files (text) that are a list of objects, or an object with one under danmaku, else comments."""
    body = F.coalesce(F.get_json_object("text", "$.danmaku"), F.get_json_object("text", "$.comments"), F.col("text"))
    rows = files.select(F.explode(F.from_json(body, "array<string>")).alias("row"))
    told = F.coalesce(F.get_json_object("row", "$.text"), F.get_json_object("row", "$.content"))
    return _chat(rows.select((chat_time(F.col("row")) + offset_ms).alias("time"), told.alias("text")), duration_ms)


def read_rows(spark: SparkSession, path: str, duration_ms: int) -> DataFrame:
    """Recognised rows, one JSON object a line; blank and broken lines drop out, ends are clamped."""
    rows = spark.read.schema("id long, start double, end double, text string").option("mode", "DROPMALFORMED").json(path)
    ms = lambda c: F.floor(F.col(c) * 1000 + 0.5).cast("long")
    return rows.where("text IS NOT NULL").select("id", ms("start").alias("s"), F.least(ms("end"), F.lit(duration_ms)).alias("e"), "text")


def render_srt(cues: DataFrame) -> DataFrame:
    """rec, srt of cues (rec, s, e, text): numbered blocks parted by a blank line."""
    told = cues.groupBy("rec").agg(F.sort_array(F.collect_list(F.struct("s", "e", "text"))).alias("cues"))
    block = lambda c, i: F.concat_ws("\n", (i + 1).cast("string"), F.concat(srt_time(c["s"]), F.lit(" --> "), srt_time(c["e"])), c["text"])
    return told.select("rec", F.concat(F.array_join(F.transform("cues", block), "\n\n"), F.lit("\n")).alias("srt"))


def write_report(report: DataFrame, path: str) -> None:
    """One JSON object a row; a NaN or an infinity in any floating column stops the write."""
    for name, kind in report.dtypes:
        if kind in ("double", "float"):
            bad = F.isnan(name) | (F.abs(name) == float("inf"))
            report = report.withColumn(name, F.when(bad, F.raise_error(F.lit(f"{name} is not finite"))).otherwise(F.col(name)))
    report.write.mode("overwrite").json(path)
