"""The queries of this subpackage and the SQL for those that DuckDB can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bloom_lm, centroids, exact_dedup, line_spread, ngram_join, prefix_trie, quality_rules, sentencepiece_codec, soft_mixing, suffix_dedup, url_templates, warc_zip, wavelet_store

_MODULES = (
    soft_mixing,
    warc_zip,
    url_templates,
    exact_dedup,
    wavelet_store,
    suffix_dedup,
    quality_rules,
    line_spread,
    sentencepiece_codec,
    ngram_join,
    prefix_trie,
    bloom_lm,
    centroids,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {m.QUERY: m.query for m in _MODULES}


def oracle_sql() -> dict[str, str]:
    return {m.QUERY: m.ORACLE_SQL for m in _MODULES if m.ORACLE_SQL}
