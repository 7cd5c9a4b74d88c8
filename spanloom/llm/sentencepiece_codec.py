"""Encode and decode with a SentencePiece BPE vocabulary in time linear in the text.

The merges are never replayed over a whole text. A token sequence is what the merges would give exactly
when each token on its own encodes to itself and each neighbouring pair is compatible, that is, encodes to
itself when joined. So every prefix of a word has one possible last token. A left-to-right pass over the
Aho-Corasick matches stores that token for each prefix, testing it against the stored last token of what
precedes it; the ids are then read backwards from the end of the word.

Words are independent: no piece holds a non-space followed by the space mark. Each Python worker keeps a
bounded table of words already encoded; a text is then a join of byte strings.
"""

from __future__ import annotations

import heapq
import itertools
import re
from collections.abc import Callable, Iterator
from hashlib import sha256

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from .kept import kept
from .workspace import documents

QUERY = "op9_sentencepiece_codec"

SPACE = "▁"
#: Words that a worker remembers; the table starts anew beyond them.
REMEMBERED_WORDS = 250_000
REMEMBERED_PAIRS = 500_000
#: Words beyond this length are not remembered.
LONGEST_REMEMBERED = 64

_CHUNK = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


def default_model() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


class PieceCodec:
    """The vocabulary of one model file, with the tables for encoding and decoding."""

    def __init__(self, model_file: str):
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = model.get_piece_size()
        self.bos, self.eos = model.bos_id(), model.eos_id()
        self.byte_id = [0] * 256
        self.rank: dict[str, tuple[float, int]] = {}
        self.surface: list[bytes] = []
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.surface.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i):
                self.surface.append(b"")
            elif model.is_unknown(i):
                self.surface.append(" ⁇ ".encode())
            else:
                self.rank[piece] = (-model.get_score(i), i)
                self.surface.append(piece.replace(SPACE, " ").encode())
        self.byte_ids = frozenset(self.byte_id)
        self.control = {i for i in range(size) if model.is_control(i)}
        self.known = frozenset(itertools.chain.from_iterable(self.rank))
        self.marked = frozenset(i for p, (_, i) in self.rank.items() if p.startswith(SPACE))
        if any(SPACE in p.lstrip(SPACE) or (p.startswith(SPACE * 2) and p.strip(SPACE)) for p in self.rank):
            raise ValueError("pieces that span words are not supported")
        # Tokens by number: a piece by its id; a character that occurs only inside pieces by a number above.
        self.token = [model.id_to_piece(i) for i in range(size)]
        self.emitted = [(i,) for i in range(size)]
        self.automaton = ahocorasick.Automaton()
        for piece in sorted(self.known.union(p for p in self.rank if len(p) == 1 or self.merge(p) == [p])):
            if piece in self.rank:
                number = self.rank[piece][1]
            else:
                number = len(self.token)
                self.token.append(piece)
                self.emitted.append(tuple(self.byte_id[b] for b in piece.encode()))
            self.automaton.add_word(piece, (len(piece), number))
        self.automaton.make_automaton()
        self.words: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}

    def merge(self, text: str) -> list[str]:
        """The merges replayed: the best-scored neighbouring pair first, the leftmost of equals."""
        parts: list[str | None] = list(text)
        left, right = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (found := self.rank.get(both := parts[i] + parts[j])):
                heapq.heappush(heap, (found[0], i, j, both))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if parts[i] is None or parts[j] is None or parts[i] + parts[j] != both or right[i] != j:
                continue
            parts[i], parts[j] = both, None
            right[i] = right[j]
            if right[i] >= 0:
                left[right[i]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [p for p in parts if p is not None]

    def compatible(self, a: int, b: int) -> bool:
        """Whether two tokens, joined, encode to themselves; remembered by pair."""
        if len(self.pairs) >= REMEMBERED_PAIRS:
            self.pairs.clear()
        left, right = self.token[a], self.token[b]
        known = self.pairs[a << 20 | b] = self.merge(left + right) == [left, right]
        return known

    def tokens(self, text: str) -> list[int]:
        """The tokens of a text of known characters, with at most one space mark, at its start."""
        n, pairs = len(text), self.pairs
        last = [-1] * (n + 1)
        for end, (size, number) in self.automaton.iter(text):
            end += 1
            if last[end] < 0:
                if end == size:
                    last[end] = number
                elif (before := last[end - size]) >= 0:
                    fits = pairs.get(before << 20 | number)
                    if fits or (fits is None and self.compatible(before, number)):
                        last[end] = number
        found: list[int] = []
        while n:
            found.append(last[n])
            n -= len(self.token[last[n]])
        found.reverse()
        return found

    def ids(self, word: str) -> list[int]:
        """The ids of one chunk: space marks, then anything but space marks."""
        body = word.lstrip(SPACE)
        marks = len(word) - len(body)
        out: list[int] = []
        text = SPACE + body if marks else body
        runs = [(True, text)] if self.known.issuperset(text) else itertools.groupby(text, self.known.__contains__)
        for known, run in runs:
            part = "".join(run)
            if known:
                for token in self.tokens(part):
                    out += self.emitted[token]
            else:
                out += [self.byte_id[b] for b in part.encode("utf-8", "surrogatepass")]
        # Marks before the last join each other only after all else; equal scores join from the left.
        if marks > 1 or (marks and not body):
            alone = not out or out[0] == self.rank[SPACE][1]
            start = 1 if alone else 0
            run = self.merge(SPACE * (marks if alone else marks - 1))
            out = [self.rank[p][1] for p in run] + out[start:]
        return out

    def word(self, word: str) -> bytes:
        found = np.array(self.ids(word), "<u4").tobytes()
        if len(word) <= LONGEST_REMEMBERED:
            if len(self.words) >= REMEMBERED_WORDS:
                self.words.clear()
            self.words[word] = found
        return found

    def encode(self, text: str) -> bytes:
        """Ids with begin and end as little-endian unsigned 32-bit integers."""
        parts = [np.array([self.bos], "<u4").tobytes()]
        if text:
            text = SPACE + text.replace(" ", SPACE)
            chunks = text[1:].split(SPACE)
            chunks = [SPACE + x for x in chunks] if "" not in chunks else _CHUNK.findall(text)
            words = self.words
            parts += [words.get(x) or self.word(x) for x in chunks]
        parts.append(np.array([self.eos], "<u4").tobytes())
        return b"".join(parts)

    def decode(self, ids: list[int]) -> str:
        """The text of ids: one leading space mark is dropped, bytes that are not UTF-8 become U+FFFD each."""
        first = next((i for i, x in enumerate(ids) if x not in self.control), len(ids))
        raw = b"".join([self.surface[i] for i in ids])
        dropped = first < len(ids) and ids[first] in self.marked
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            text = "".join(
                _loose(b"".join(self.surface[i] for i in run)) if is_byte else b"".join(self.surface[i] for i in run).decode()
                for is_byte, run in itertools.groupby(ids, self.byte_ids.__contains__)
            )
        return text[1:] if dropped else text


def _loose(raw: bytes) -> str:
    out = []
    while raw:
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[:n].decode())
                raw = raw[n:]
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            raw = raw[1:]
    return "".join(out)


def codec(model_file: str) -> PieceCodec:
    return kept(QUERY, model_file, lambda: PieceCodec(model_file))


def _encoded(batches: Iterator[pa.RecordBatch], model_file: str) -> Iterator[tuple[pa.Array, list[bytes]]]:
    pieces = codec(model_file)
    for batch in batches:
        for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
            yield part.column(0).cast(pa.int64()), [pieces.encode(x.as_py() or "") for x in part.column(1)]


def _lists(raw: list[bytes]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in raw]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(raw), "<u4").astype(np.int32)))


def _rows(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select("doc_id", text)


def encode(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """doc_id, ids: every whole text with begin and end ids. A null text counts as empty: only those two ids."""
    model_file = model_file or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, raw in _encoded(batches, model_file):
            yield pa.RecordBatch.from_arrays([ids, _lists(raw)], names=["doc_id", "ids"])

    return _rows(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_file: str | None = None) -> DataFrame:
    """doc_id, text of a table of doc_id, ids. Null ids give an empty text."""
    model_file = model_file or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = codec(model_file)
        for batch in batches:
            texts = [pieces.decode(x.as_py() or []) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return _rows(encoded, "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, digest: Callable[[bytes], str] | None = None, model_file: str | None = None, with_ids: bool = False) -> DataFrame:
    """Encode, then decode those ids, in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256, and on demand ids.

    Null and empty texts have the begin and end ids alone and decode to an empty text. Null ids and
    repeated rows are encoded like any other; an empty table gives an empty result; columns other than
    doc_id and text are ignored.
    """
    model_file = model_file or default_model()
    digest = digest or (lambda raw: sha256(raw).hexdigest())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = codec(model_file)
        for ids, raw in _encoded(batches, model_file):
            decoded = [digest(pieces.decode(np.frombuffer(x, "<u4").tolist()).encode()) for x in raw]
            columns = [ids, pa.array([len(x) // 4 for x in raw], pa.int64()), pa.array([digest(x) for x in raw], pa.string()), pa.array(decoded, pa.string()), *[_lists(raw)] * with_ids]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])

    return _rows(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir))


ORACLE_SQL = None
