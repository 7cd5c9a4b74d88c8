"""Token ids in one compressed, searchable file a shard: a wavelet matrix.

The ids of a shard are stored as bit-planes, most significant first. Each plane lists one bit of every id,
in the order left by a stable partition on the planes above: zeros first, then ones. A plane is cut into
blocks that are compressed one by one, beside a directory of the ones before each block. So a reader can,
by touching one block a plane: give the id at a position (access), count an id before a position (rank),
and find the k-th place of an id (select).

File, little-endian: magic, bits, documents, tokens, block size; then document ids with a null mask,
document starts, zeros by plane, the rank directory, block offsets, and the blocks.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import attempt, open_file, write_file
from .workspace import Workspace, documents

QUERY = "op5_wavelet_store"

END_ID = 0
BITS = 16
#: Bits of a block of a plane: 4 KiB, so that access, rank and select unpack little beside their answer.
BLOCK = 1 << 15
#: A shard is closed at this many ids; a document stays whole.
SHARD_TOKENS = 2_000_000
#: Pieces of text that a worker remembers with their ids, twice (those met lately and before), of each kind.
REMEMBERED = 400_000
LONGEST_REMEMBERED = 64

MAGIC = b"SPWM\x01\x00\x00\x00"
_HEAD = struct.Struct("<8sIIQQQ")

#: White space, a space, white space: there a run of white space may be one pre-token.
_INNER_SPACE = re.compile(r"\s \s")
#: Letters below U+0250, whose bytes the tokenizer shows as plain characters.
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]+").fullmatch
#: ASCII marks but the apostrophe, which may begin a pre-token with letters.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def default_tokenizer() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


class WordCache:
    """The ids of whole texts from the tokenizer's ids of their pieces.

    The tokenizer cuts a text before it merges, and always cuts before a space that does not stand inside
    a longer run of white space. Pieces between such spaces are therefore encoded on their own, and each
    distinct piece only once while it is remembered. Texts with longer runs go to the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << BITS:
            raise ValueError(f"ids do not fit in {BITS} bits")
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        merges = self.tokenizer.model.tokenize
        # The characters that stand for bytes, as the tokenizer itself shows them.
        one = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.shown = {i: one.pre_tokenize_str(chr(i))[0][0] for i in range(0x250)}
        self.merged = lambda shown: array("H", [t.id for t in merges(shown)]).tobytes()
        self.feed = self.whole("\n")
        self.odd = False  # whether a piece met lately was empty, or began or ended with white space
        self.known = _Pieces(self, "")
        self.spaced = _Pieces(self, " ")  # by what follows the space

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 16-bit integers."""
        for table in (self.known, self.spaced):
            table.age()
        out, ids = [], self.spaced.__getitem__
        for text in texts:
            self.odd = False
            pieces = text.split(" ")
            found = (self.known[pieces[0]] if pieces[0] else b"") + b"".join(map(ids, islice(pieces, 1, None)))
            out.append(self.whole(text) if self.odd and _INNER_SPACE.search(text) else found)
        return out


class _Pieces(dict):
    """The ids of pieces by what follows ``before``; a piece that is missing is encoded, and remembered unless it is long.

    The tokenizer also cuts around a line feed between other characters, between a letter or digit and a mark,
    and not within letters, digits or marks alone: such parts go to its merges one by one, all other pieces
    through its every step. Pieces that were not met while many others came are forgotten.
    """

    def __init__(self, words: WordCache, before: str):
        super().__init__()
        self.words, self.before, self.shown, self.old = words, before, words.shown[32] if before else "", {}

    def age(self) -> None:
        if len(self) >= REMEMBERED:
            self.old = self.copy()
            self.clear()

    def __missing__(self, piece: str) -> bytes:
        if not piece or piece[0].isspace() or piece[-1].isspace():  # not remembered, so that each text is told
            self.words.odd = True
            return self._encoded(piece)
        if (found := self.old.get(piece)) is None:
            found = self._encoded(piece)
        if len(piece) <= LONGEST_REMEMBERED:
            self[piece] = found
        return found

    def _encoded(self, piece: str) -> bytes:
        words = self.words
        if piece.isascii():
            if piece.isalpha() or piece.isdigit():
                return words.merged(self.shown + piece)
        elif _LETTERS(piece):
            return words.merged(self.shown + piece.translate(words.shown))
        word = piece.rstrip(_MARKS)
        if not word and piece:
            return words.merged(self.shown + piece)
        if len(word) < len(piece):
            return self[word] + words.known[piece[len(word) :]] if word[-1].isalnum() else words.whole(self.before + piece)
        first, *lines = piece.split("\n")
        if lines and all(x and not x[0].isspace() and not x[-1].isspace() for x in (first, *lines)):
            return words.feed.join([self[first], *map(words.known.__getitem__, lines)])
        return words.whole(self.before + piece)


@cache
def word_cache(path: str) -> WordCache:
    return WordCache(path)


def build(ids: np.ndarray, doc_ids: list[int | None], starts: np.ndarray, bits: int = BITS, block: int = BLOCK) -> bytes:
    """One shard as a file: ids of all documents in order, the documents' ids and their starts (one more than documents)."""
    press = zstandard.ZstdCompressor(level=1)
    n = len(ids)
    per_plane = max(1, -(-n // block))
    zeros, ranks, blocks, level = [], [], [], ids.astype(np.uint16 if bits <= 16 else np.uint32)
    for plane in range(bits - 1, -1, -1):
        bit = (level >> plane) & 1 != 0
        packed = np.packbits(bit, bitorder="little")
        pieces = [packed[i * block // 8 : (i + 1) * block // 8].tobytes() for i in range(per_plane)]
        ones = np.add.reduceat(np.bitwise_count(packed), np.arange(per_plane) * (block // 8), dtype=np.uint64) if n else np.zeros(1, np.uint64)
        ranks.append(np.concatenate(([0], np.cumsum(ones)[:-1])).astype("<u8"))
        zeros.append(n - int(ones.sum()))
        blocks += [press.compress(x) for x in pieces]
        level = np.concatenate((np.compress(~bit, level), np.compress(bit, level)))
    ends = np.concatenate(([0], np.cumsum([len(x) for x in blocks]))).astype("<u8")
    return b"".join([
        _HEAD.pack(MAGIC, bits, 0, len(doc_ids), n, block),
        np.array([x or 0 for x in doc_ids], "<i8").tobytes(),
        bytes(x is None for x in doc_ids),
        np.asarray(starts, "<u8").tobytes(),
        np.array(zeros, "<u8").tobytes(),
        b"".join(x.tobytes() for x in ranks),
        ends.tobytes(),
        *blocks,
    ])


class Shard:
    """A reader over one open file; it reads the tables at once and blocks of planes when they are needed."""

    def __init__(self, file):
        self.file = file
        magic, self.bits, _, self.n_docs, self.n, self.block = _HEAD.unpack(file.read(_HEAD.size))
        if magic != MAGIC:
            raise ValueError("not a wavelet matrix file")
        self.per_plane = max(1, -(-self.n // self.block))
        ids = np.frombuffer(file.read(8 * self.n_docs), "<i8").tolist()
        mask = file.read(self.n_docs)
        self.doc_ids = [None if m else x for x, m in zip(ids, mask, strict=True)]
        self.starts = np.frombuffer(file.read(8 * (self.n_docs + 1)), "<u8").astype(np.int64)
        self.zeros = np.frombuffer(file.read(8 * self.bits), "<u8").astype(np.int64).tolist()
        self.ranks = np.frombuffer(file.read(8 * self.bits * self.per_plane), "<u8").astype(np.int64).reshape(self.bits, self.per_plane)
        self.ends = np.frombuffer(file.read(8 * (self.bits * self.per_plane + 1)), "<u8").astype(np.int64)
        self.base = file.tell()
        self.plain = zstandard.ZstdDecompressor()
        self.read: dict[int, np.ndarray] = {}

    def _block(self, plane: int, i: int) -> np.ndarray:
        """Bytes of a block, the first bit lowest."""
        k = plane * self.per_plane + i
        if k not in self.read:
            if len(self.read) >= 32 * self.bits:
                self.read.clear()
            self.file.seek(self.base + int(self.ends[k]))
            raw = self.plain.decompress(self.file.read(int(self.ends[k + 1] - self.ends[k])), max_output_size=self.block // 8)
            self.read[k] = np.frombuffer(raw, np.uint8)
        return self.read[k]

    def _ones(self, plane: int, at: int) -> int:
        """Ones of a plane before a position."""
        if at >= self.n:
            return self.n - self.zeros[plane]
        i, rest = divmod(at, self.block)
        raw = self._block(plane, i)
        part = int(raw[rest >> 3]) & ((1 << (rest & 7)) - 1) if rest & 7 else 0
        return int(self.ranks[plane][i]) + int(np.bitwise_count(raw[: rest >> 3]).sum(dtype=np.int64)) + part.bit_count()

    def _select(self, plane: int, bit: int, k: int) -> int:
        """The position of the k-th (from 0) zero or one of a plane."""
        ranks = self.ranks[plane]
        before = ranks if bit else np.arange(self.per_plane, dtype=np.int64) * self.block - ranks
        i = int(np.searchsorted(before, k, "right")) - 1
        size = min(self.block, self.n - i * self.block)
        bits = np.unpackbits(self._block(plane, i), count=size, bitorder="little")
        return i * self.block + int(np.flatnonzero(bits == bit)[k - int(before[i])])

    def access(self, at: int) -> int:
        """The id at a position."""
        if not 0 <= at < self.n:
            raise IndexError(at)
        value = 0
        for plane in range(self.bits):
            i, rest = divmod(at, self.block)
            bit = int(self._block(plane, i)[rest >> 3]) >> (rest & 7) & 1
            ones = self._ones(plane, at)
            at = self.zeros[plane] + ones if bit else at - ones
            value = value << 1 | bit
        return value

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        for plane in range(self.bits):
            a, b = self._ones(plane, lo), self._ones(plane, hi)
            if token >> (self.bits - 1 - plane) & 1:
                lo, hi = self.zeros[plane] + a, self.zeros[plane] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """How often an id occurs in [lo, hi)."""
        lo, hi = self._range(token, lo, self.n if hi is None else hi)
        return hi - lo

    def select(self, token: int, k: int) -> int:
        """The position of the k-th (from 0) occurrence of an id."""
        lo, hi = self._range(token, 0, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        at = lo + k
        for plane in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - plane) & 1
            at = self._select(plane, bit, at - self.zeros[plane] if bit else at)
        return at

    def occurrences(self, token: int) -> Iterator[tuple[int | None, int]]:
        """(document id, place in the document) of every occurrence of an id."""
        for k in range(self.count(token)):
            at = self.select(token, k)
            doc = int(np.searchsorted(self.starts, at, "right")) - 1
            yield self.doc_ids[doc], at - int(self.starts[doc])

    def ids(self) -> np.ndarray:
        """All ids, from the last plane up: each plane puts its zeros and ones back where they stood."""
        level = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for plane in range(self.bits - 1, -1, -1):
            self.file.seek(self.base + int(self.ends[plane * self.per_plane]))
            raw = self.file.read(int(self.ends[(plane + 1) * self.per_plane] - self.ends[plane * self.per_plane]))
            cuts = self.ends[plane * self.per_plane : (plane + 1) * self.per_plane + 1] - self.ends[plane * self.per_plane]
            packed = b"".join(self.plain.decompress(raw[a:b], max_output_size=self.block // 8) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
            bit = np.unpackbits(np.frombuffer(packed, np.uint8), count=self.n, bitorder="little").view(bool)
            above, zero, one = np.empty_like(level), 0, self.zeros[plane]
            level[one:] |= level.dtype.type(1 << (self.bits - 1 - plane))
            for lo in range(0, self.n, 1 << 16):  # a part that stays in the processor's cache
                here, part = bit[lo : lo + (1 << 16)], above[lo : lo + (1 << 16)]
                ones = np.flatnonzero(here)
                part[ones] = level[one : one + len(ones)]
                part[np.flatnonzero(~here)] = level[zero : zero + len(here) - len(ones)]
                zero, one = zero + len(here) - len(ones), one + len(ones)
            level = above
        return level


def write_shards(docs: DataFrame, ws: Workspace, tokenizer: str | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write the documents' ids as shards in ascending doc_id order; a table of part, seq, path, n_docs, n_tokens.

    Range partitions hold consecutive ids, each task closes a shard at ``shard_tokens`` ids or at its end.
    Null ids come first; rows that repeat an id stand side by side in order of their texts; a null text is
    empty and has the end id alone. An empty table writes no shard.
    """
    path, root = tokenizer or default_tokenizer(), ws.path("shards")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, name, seq = word_cache(path), TaskContext.get().partitionId(), attempt(), 0
        end = np.array([END_ID], "<u2").tobytes()
        held: list[bytes] = []
        ids: list[int | None] = []
        size = 0

        def close() -> pa.RecordBatch:
            uri = f"{root}/{part:06d}-{seq:04d}-{name}.wm"
            starts = np.concatenate(([0], np.cumsum([len(x) // 2 for x in held])))
            write_file(uri, [build(np.frombuffer(b"".join(held), "<u2"), ids, starts)])
            return pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "path": [uri], "n_docs": [len(ids)], "n_tokens": [size]})

        for batch in batches:
            for piece in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                for doc_id, raw in zip(piece.column(0).to_pylist(), words.encode([x or "" for x in piece.column(1).to_pylist()]), strict=True):
                    ids.append(doc_id)
                    held.append(raw + end)
                    size += len(raw) // 2 + 1
                    if size >= shard_tokens:
                        yield close()
                        held, ids, size, seq = [], [], 0, seq + 1
        if ids:
            yield close()

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ws.table(ordered.mapInArrow(run, "part long, seq long, path string, n_docs long, n_tokens long"), "manifest")


def with_bases(manifest: DataFrame) -> DataFrame:
    """The manifest with ``base``, the ids of all shards before. Only one row a partition meets in one task."""
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("part_base"))
    shards = manifest.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return shards.join(parts, "part").select("path", "n_docs", "n_tokens", (F.col("part_base") + F.col("inside")).alias("base"))


def read_documents(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read from the shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with open_file(row["path"]) as file:
                    shard = Shard(file)
                    ids = shard.ids().astype("<u4")
                starts = shard.starts
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.doc_ids, pa.int64()), pa.array(starts[:-1] + row["base"]), pa.array(np.diff(starts)), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    spread = max(1, min(manifest.count(), 10_000))
    return with_bases(manifest).select("path", "base").repartition(spread).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_documents(write_shards(documents(spark, sf_dir), Workspace(spark, "wavelet-store")))


ORACLE_SQL = None
