"""Quality by weak supervision: rules vote or abstain, EM finds how far to trust each, a posterior decides.

One pass over the texts computes the base figures and the rules' votes. The only thing that EM needs of
the corpus is how often each pattern of votes occurs: at most 3 ** rules counts whatever the corpus holds,
gathered by one aggregation over all rows. EM runs on those counts, so its result is that of EM over every
document, and the posteriors return to the rows as a table keyed by pattern.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from .kept import only
from .workspace import Workspace, documents, unused

QUERY = "op7_quality_rules"

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


@dataclass(frozen=True)
class Rule:
    """A vote for quality at or below ``good``, against at or above ``bad``, else none; a None never votes that way."""

    name: str
    good: float | None
    bad: float | None

    def vote(self, value: float) -> int:
        if self.good is not None and value <= self.good:
            return 1
        return -1 if self.bad is not None and value >= self.bad else 0


RULES = (
    Rule("symbols_per_word", 0.02, 0.25),
    Rule("share_of_words_not_plain", 0.1, 0.25),
    Rule("upper_share_of_letters", None, 0.6),
    Rule("repeated_words_share", None, 0.3),
    Rule("duplicate_lines_share", None, 0.3),
    Rule("odd_word_length", None, 1.0),
    Rule("exclamations_per_word", None, 0.3),
    Rule("odd_sentence_length", 0.0, 1.0),
)

#: A plain word: letters, marks, apostrophes and hyphens, or digits, in ordinary punctuation.
_PLAIN = regex.compile(r"""["'(\[]?(?:[\p{L}\p{M}]+(?:['’-][\p{L}\p{M}]+)*|\p{N}+(?:[.,:]\p{N}+)*)[.,;:!?'")\]]{0,2}""").fullmatch

_SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, votes string"


def repeated_words(ids: np.ndarray, distinct: int) -> int:
    """Words inside three-word windows that occur at least twice in the text, the first occurrence included."""
    n = len(ids)
    if n < 4:
        return 0
    ids = ids.astype(np.int64)
    pairs = ids[:-1] * distinct + ids[1:]
    if distinct**3 < 2**62:
        keys = pairs[:-1] * distinct + ids[2:]
    else:
        _, pairs = np.unique(pairs, return_inverse=True)
        keys = pairs[:-1].astype(np.int64) * distinct + ids[2:]
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= twice
    return int(covered.sum())


def measure(text: str | None) -> tuple[tuple[int, ...], str]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed) and the votes, one of +, 0, - a rule."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at exactly [\x20\x09-\x0D]
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = Counter(x for x in text.split("\n") if x.strip(SPACES))
    dup_lines = lines.total() - len(lines)
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, n)
    repeats = repeated_words(ids, len(index))
    failed = n < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n
    if n:
        upper = sum(map(str.isupper, text))
        letters = upper + sum(map(str.islower, text))
        plain = sum(n_w for w, n_w in Counter(words).items() if _PLAIN(w.decode("utf-8", "surrogatepass")))
        mean = chars / n
        ends = text.count(".") + text.count("!") + text.count("?") + text.count("\u3002")
        values = (
            symbols / n,
            1 - plain / n,
            upper / max(letters, 1),
            repeats / n,
            dup_lines / lines.total(),
            float(not 2 <= mean <= 20),
            text.count("!") / n,
            float(not 2 <= n / max(ends, 1) <= 60),
        )
        votes = "".join("-0+"[r.vote(v) + 1] for r, v in zip(RULES, values, strict=True))
    else:
        votes = "0" * len(RULES)
    return (n, chars, symbols, dup_lines, repeats, failed), votes


def _measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    only(QUERY)
    for batch in batches:
        out = [measure(x.as_py()) for x in batch.column(1)]
        figures = list(zip(*(x for x, _ in out), strict=True)) or [[]] * 6
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), *(pa.array(x, pa.int64()) for x in figures[:5]), pa.array(figures[5], pa.bool_()), pa.array([v for _, v in out], pa.string())],
            names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "votes"],
        )


def fit_votes(counts: dict[str, int], rounds: int = 200, tolerance: float = 1e-9) -> tuple[float, list[float], dict[str, float]]:
    """EM over vote patterns: the share of good rows, each rule's accuracy, the posterior by pattern.

    A rule that votes is right with its accuracy whatever the class; abstaining says nothing. Accuracies
    stay in [0.6, 0.99], so that rules remain better than chance and the classes keep their meaning; two
    pseudo-votes of accuracy 0.8 start each rule. Patterns are weighted by all the rows that show them.
    """
    patterns = sorted(counts)
    if not patterns:
        return 0.5, [0.8] * len(RULES), {}
    votes = np.array([["-0+".index(c) - 1 for c in p] for p in patterns], float)
    weight = np.array([counts[p] for p in patterns], float)
    share, accuracy = 0.5, np.full(votes.shape[1], 0.8)
    for _ in range(rounds):
        logit = math.log(share / (1 - share)) + votes @ np.log(accuracy / (1 - accuracy))
        good = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
        new_share = float(np.clip((weight @ good + 4) / (weight.sum() + 5), 0.05, 0.99))
        right = weight @ ((votes > 0) * good[:, None] + (votes < 0) * (1 - good)[:, None]) + 1.6
        new = np.clip(right / (weight @ (votes != 0) + 2), 0.6, 0.99)
        moved = max(abs(new_share - share), float(np.abs(new - accuracy).max()))
        share, accuracy = new_share, new
        if moved < tolerance:
            break
    logit = math.log(share / (1 - share)) + votes @ np.log(accuracy / (1 - accuracy))
    good = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
    return share, accuracy.tolist(), dict(zip(patterns, map(float, good), strict=True))


def quality_rules(docs: DataFrame, ws: Workspace, threshold: float = 0.5) -> DataFrame:
    """One row per input row: the base figures, base_failed, quality (the posterior) and kept.

    kept is false where base_failed is, else whether the posterior reaches ``threshold``. A null or empty
    text has no words and fails the base. Null ids and repeated rows are judged like any other row. An
    empty table gives an empty result; columns other than doc_id and text are ignored.
    """
    measured = ws.table(docs.select("doc_id", "text").mapInArrow(_measure_batches, _SCHEMA), "measured")
    # At most 3 ** len(RULES) patterns, however many rows.
    counts = {r["votes"]: r["count"] for r in measured.groupBy("votes").count().collect()}
    _, _, posterior = fit_votes(counts)
    table = docs.sparkSession.createDataFrame(sorted(posterior.items()), "votes string, quality double")
    # As many rows as there are patterns: a proven bound for the broadcast.
    return measured.join(F.broadcast(table), "votes", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("quality") >= threshold)).alias("kept"), "quality", "votes",
    )


def keep_good(docs: DataFrame, ws: Workspace, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with their columns, whatever their names; judged alike, in one pass over the texts.

    Null and empty texts go, as do all rows without words; null ids and repeated rows are judged like any other. An empty table stays empty.
    """
    failed, votes = unused(docs, "failed"), unused(docs, "votes")
    schema = StructType([*docs.schema.fields, StructField(failed, BooleanType()), StructField(votes, StringType())])
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only(QUERY)
        for batch in batches:
            out = [measure(x.as_py()) for x in batch.column(at)]
            added = [pa.array([bool(x[5]) for x, _ in out], pa.bool_()), pa.array([v for _, v in out], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=schema.fieldNames())

    judged = ws.table(docs.mapInArrow(run, schema), "judged")
    counts = {r[0]: r[1] for r in judged.groupBy(votes).count().collect()}
    good = sorted(p for p, quality in fit_votes(counts)[2].items() if quality >= threshold)
    return judged.where(~F.col(failed) & F.col(votes).isin(good)).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir), Workspace(spark, "quality-rules"))


ORACLE_SQL = None
