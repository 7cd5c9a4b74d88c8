"""A worker's tables go when another operator's task comes."""

import gc
import weakref

import pyarrow as pa

from spanloom.llm import ngram_join, quality_rules, sentencepiece_codec


def _built():
    model = sentencepiece_codec.default_model()
    pieces = sentencepiece_codec.codec(model)
    assert sentencepiece_codec.codec(model) is pieces
    return weakref.ref(pieces)


def test_quality_rules_and_ngram_join_hold_no_pieces():
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["some words here"])], names=["doc_id", "text"])
    for task in (lambda: list(quality_rules._measure_batches(iter([batch]))), lambda: list(ngram_join._texts(iter([batch]), 1, 4))):
        pieces = _built()
        task()
        gc.collect()
        assert pieces() is None
