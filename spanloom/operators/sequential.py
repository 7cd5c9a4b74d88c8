"""Operators whose next decision depends on the last: one ordered pass per group, in Arrow batches.

Groups (a recording, a sample, a task) are bounded by what they describe; they run in parallel.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate, groupby, pairwise
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The limits of a transcript window (characters, seconds, overlap, allowance a row), of a
#: batch of rows (rows, characters of JSON), of a caption (characters, seconds, gap), and the overlap of
#: the shorter one from which a lower-scored candidate is dropped.
WINDOW_CHARS, WINDOW_MS, WINDOW_OVERLAP_MS, ROW_CHARS = 10_500, 480_000, 45_000, 50
BATCH_ROWS, BATCH_CHARS = 24, 2_800
CUE_CHARS, CUE_MS, CUE_GAP_MS = 36, 6_000, 800
NMS_OVERLAP = 0.35


#: Rows of a batch that a pass hands on.
OUT_ROWS = 10_000


def ordered_pass(rows: DataFrame, order: list[str | Column], run: Callable[[list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """What ``run`` makes of each recording's rows (rec first) in order; recordings follow each other in a task, without a frame each."""
    out, types = zip(*((name, {"long": pa.int64(), "string": pa.string()}[kind]) for name, kind in map(str.split, schema.split(", "))), strict=True)

    def handed(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), types, strict=True)], names=list(out))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        stream = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for _, group in groupby(stream, itemgetter(0)):
            found += run(list(group))
            if len(found) >= OUT_ROWS:
                yield handed(found)
                found = []
        if found:
            yield handed(found)

    return rows.repartition("rec").sortWithinPartitions("rec", *order).mapInArrow(each, schema)


def _sums(sizes: list[int]) -> list[int]:
    """What all rows before each place take together."""
    return [0, *accumulate(sizes)]


def window_bounds(chars: list[int], starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """(first, end) of overlapping windows over rows in order of their starts.

    A window takes the rows whose characters and time fit, one at least. The next begins at the earliest row
    that starts less than the overlap before the window's end, after the window's first row and at its end at the latest.
    """
    sums, found, n = _sums([c + ROW_CHARS for c in chars]), [], len(chars)
    first = 0
    while n and (not found or found[-1][1] < n):
        fits = bisect_right(sums, sums[first] + WINDOW_CHARS, first + 1) - 1
        late = next((i for i in range(first + 1, fits) if ends[i] > starts[first] + WINDOW_MS), fits)
        found.append((first, min(n, max(late, first + 1))))
        last = found[-1][1] - 1
        first = min(last + 1, max(first + 1, bisect_right(starts, ends[last] - WINDOW_OVERLAP_MS)))
    return found


def transcript_windows(rows: DataFrame) -> DataFrame:
    """rec, window, first_id, last_id, n_rows of rows (rec, id, s, e, text)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["s", "e", "id"])
        ids = group["id"].tolist()
        bounds = window_bounds(group["text"].str.len().tolist(), group["s"].tolist(), group["e"].tolist())
        return pd.DataFrame([(group["rec"].iloc[0], i, ids[a], ids[b - 1], b - a) for i, (a, b) in enumerate(bounds)], columns=["rec", "window", "first_id", "last_id", "n_rows"])

    return rows.groupBy("rec").applyInPandas(run, "rec long, window long, first_id long, last_id long, n_rows long")


def batch_bounds(sizes: list[int], max_rows: int = BATCH_ROWS, max_chars: int = BATCH_CHARS) -> list[int]:
    """The batch of each row: as many rows as fit by number and by characters, one at least."""
    sums, cuts = _sums(sizes), [0]
    while cuts[-1] < len(sizes):
        first = cuts[-1]
        cuts.append(min(first + max_rows, len(sizes), max(first + 1, bisect_right(sums, sums[first] + max_chars, first) - 1)))
    return [batch for batch, (a, b) in enumerate(pairwise(cuts)) for _ in range(a, b)]


def row_batches(rows: DataFrame) -> DataFrame:
    """rec, id, batch; a row's size is its length as JSON."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["s", "e", "id"])
        sizes = [len(json.dumps({"id": int(i), "text": t}, ensure_ascii=False)) for i, t in zip(group["id"], group["text"], strict=True)]
        return pd.DataFrame({"rec": group["rec"], "id": group["id"], "batch": batch_bounds(sizes)})

    return rows.groupBy("rec").applyInPandas(run, "rec long, id long, batch long")


def cue_numbers(chars: list[int], starts: list[int], ends: list[int]) -> list[int]:
    """The caption of each word: a new one begins past the characters (with the spaces that join words), the time, or a long pause."""
    out, cue, size, begin = [], -1, 0, 0
    for i, (n, s, e) in enumerate(zip(chars, starts, ends, strict=True)):
        if i == 0 or size + 1 + n > CUE_CHARS or e - begin > CUE_MS or s - ends[i - 1] > CUE_GAP_MS:
            cue, size, begin = cue + 1, -1, s
        size += 1 + n
        out.append(cue)
    return out


def cue_groups(words: DataFrame) -> DataFrame:
    """rec, cue, s, e, text of words (rec, id, s, e, text) joined into captions."""

    def run(group: list[tuple]) -> list[tuple]:
        rec, starts, ends, texts = group[0][0], [x[1] for x in group], [x[2] for x in group], [x[4] for x in group]
        cues = groupby(zip(cue_numbers([len(x) for x in texts], starts, ends), starts, ends, texts, strict=True), itemgetter(0))
        return [(rec, cue, min(x[1] for x in held), max(x[2] for x in held), " ".join(x[3] for x in held)) for cue, held in ((cue, list(x)) for cue, x in cues)]

    return ordered_pass(words.select("rec", "s", "e", "id", "text"), ["s", "e", "id"], run, "rec long, cue long, s long, e long, text string")


def suppress(rows: list[tuple[int, int, float]], limit: int | None = None) -> list[int]:
    """Places of the rows (s, e, score) that stay: best score first, none that overlaps a better one by too much of the shorter."""
    kept: list[int] = []
    for i in sorted(range(len(rows)), key=lambda i: (-rows[i][2], i)):
        s, e, _ = rows[i]
        if all(min(e, rows[k][1]) - max(s, rows[k][0]) <= NMS_OVERLAP * max(1, min(e - s, rows[k][1] - rows[k][0])) for k in kept):
            kept.append(i)
            if limit and len(kept) >= limit:
                break
    return sorted(kept, key=lambda i: (rows[i][0], i))


def greedy_nms(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """rec, id, s, e, score of the candidates that stay, per rec."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id").reset_index(drop=True)
        return group.loc[suppress(list(zip(group["s"], group["e"], group["score"], strict=True)), limit), ["rec", "id", "s", "e", "score"]]

    return rows.groupBy("rec").applyInPandas(run, "rec long, id long, s long, e long, score double")


def match_pairs(pairs: list[tuple[float, int, int]], threshold: float = 0.5) -> list[tuple[int, int]]:
    """One-to-one matches of (ratio, cut, gold): the largest ratio first, of equals the larger cut, then the larger gold."""
    cuts, golds, found = set(), set(), []
    for ratio, cut, gold in sorted(pairs, reverse=True):
        if ratio >= threshold and cut not in cuts and gold not in golds:
            cuts.add(cut)
            golds.add(gold)
            found.append((cut, gold))
    return found


def greedy_match(pairs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """rec, cut, gold of pairs (rec, ratio, cut, gold)."""

    def run(group: list[tuple]) -> list[tuple]:
        return [(group[0][0], cut, gold) for cut, gold in match_pairs([x[1:] for x in group], threshold)]

    good = pairs.select("rec", "ratio", "cut", "gold").where((F.col("ratio") >= threshold) & ~F.isnan("ratio"))
    return ordered_pass(good, [F.desc("ratio")], run, "rec long, cut long, gold long")
