"""Removal of repeated 100-byte strings, found by a suffix structure built column by column.

Candidates first. Every 100-byte string has an anchor, the leftmost of its 32-byte substrings with the
smallest hash, so equal strings share it, at equal places. Consecutive strings of a text with one anchor form
a short context (at most 168 bytes). Contexts with equal text are one class, whose first occurrence stands for
all; only anchors with several classes can hold strings that are equal without their contexts being so. One
shuffle by anchor finds both; copies within a task fold before it.

The contexts of those go to the suffix structure, aligned by their anchors. One symbol of every string is
inserted each round, from the right; the Burrows-Wheeler transform of the newest column (the symbols in the
order of the suffixes that follow) and the common prefixes of neighbours give those of the next one in a single
pass. Only suffixes of one column can be equal strings, so older columns need not be kept, and a collection
costs as much as it has symbols. Small collections hold their columns in memory; larger ones read them from
sequential files in the shared folder, a column a round. Suffixes that share their first 100 bytes stand side
by side; the earliest keeps the string. An anchor with more contexts than a collection takes is split by its
strings' further bytes, and the parts go to the structure too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import attempt
from .workspace import Workspace, documents

QUERY = "op6_suffix_dedup"

#: Length of a string that must not occur twice.
LENGTH = 100
#: Length of the anchor inside each string; a context has a string for each place of the anchor in it, at most.
ANCHOR = 32
PLACES = LENGTH - ANCHOR + 1
#: Columns of an aligned collection.
COLUMNS = PLACES + LENGTH - 1
#: Contexts from which a collection is closed at the next anchor, and the most that one anchor may bring to it.
COLLECTION, SPLIT = 1 << 17, 1 << 18
#: Bytes of a collection's columns that are held in memory; further ones are read from files.
IN_MEMORY = 1 << 24
#: Bytes of text that are hashed at once; longer texts are cut into overlapping pieces.
PIECE = 1 << 20
#: Groups of strings that a task folds at once.
FOLD = 1 << 20
#: Documents to change are picked by broadcast up to this number (8 bytes each), else by shuffle.
BROADCAST_DOCS = 500_000

_BASE = 0xD6E8FEB86659FD93
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15))
_powers: list[np.ndarray] = [np.ones(1, np.uint64)] * 2


def _power_tables(size: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64, up to a size."""
    if len(_powers[0]) < size:
        size = max(size, PIECE + (1 << 16))
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            table = np.full(size, np.uint64(base))
            table[0] = 1
            _powers[i] = np.multiply.accumulate(table)
    return _powers


def _scramble(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= _MIX[0]
    x ^= x >> np.uint64(29)
    x *= _MIX[1]
    x ^= x >> np.uint64(32)
    return x


#: What each byte counts for in the hashes: 64 mixed bits.
_BYTES = _scramble(np.arange(1, 257, dtype=np.uint64) * _MIX[2])


def _sliding(x: np.ndarray, width: int, take: np.ufunc, fill: np.uint64) -> np.ndarray:
    """take (minimum or maximum) over x[i : i + width] for each i with a whole window."""
    n = len(x)
    blocks = -(-n // width)
    whole = np.full(blocks * width, fill)
    whole[:n] = x
    grid = whole.reshape(blocks, width)
    up = take.accumulate(grid, axis=1).ravel()
    down = take.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return take(down[: n - width + 1], up[width - 1 : n])


def anchors(raw: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Group the strings of texts by anchor: (text, anchor hash, context hash, first start, starts, anchor place in the context).

    ``raw`` holds the texts' bytes one after the other, text i from cuts[i] to cuts[i + 1]. The anchor of a
    string is the leftmost of its anchor-long substrings with the smallest hash, so equal strings have equal
    anchors at equal places, wherever they stand. Consecutive starts with one anchor form a group; its context is
    the text from the first start to the end of the last string.
    """
    n = len(raw)
    edge = np.zeros(n + 1, np.int32)
    whole = np.flatnonzero(np.diff(cuts) >= LENGTH)
    edge[cuts[whole]] += 1
    edge[cuts[whole + 1] - LENGTH + 1] -= 1
    starts = np.flatnonzero(np.cumsum(edge))
    if not len(starts):
        return (np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3)
    power, inverse = _power_tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[raw] * power[:n], out=sums[1:])
    h = _scramble((sums[ANCHOR:] - sums[:-ANCHOR]) * inverse[: n - ANCHOR + 1])
    low = _sliding(h, PLACES, np.minimum, np.uint64(2**64 - 1))
    # An anchor is chosen where its hash is the smallest of some string that holds it.
    padded = np.zeros(len(low) + 2 * (PLACES - 1), np.uint64)
    padded[starts + PLACES - 1] = low[starts]
    chosen = np.flatnonzero(_sliding(padded, PLACES, np.maximum, np.uint64(0)) == h)
    values, low = h[chosen], low[starts]
    at = np.searchsorted(chosen, starts)
    while len(wrong := np.flatnonzero(values[at] != low)):
        at[wrong] += 1
    head = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1))))
    count = np.diff(np.append(head, len(starts)))
    first, which = starts[head], chosen[at[head]]
    last = first + count - 1 + LENGTH
    context = (sums[last] - sums[first]) * inverse[first]
    context = _scramble(context + (which - first).astype(np.uint64) * _MIX[2] + (last - first).astype(np.uint64))
    text = np.searchsorted(cuts, first, "right") - 1
    return text, h[which], context, first - cuts[text], count, which - first


# ---- the collection: one symbol of each string a round ----


class _Columns:
    """The columns of aligned strings, the rightmost first: in memory, or beyond it in files of the shared folder."""

    def __init__(self, folder: str | None):
        self.folder, self.parts, self.rows = folder, [], 0

    def add(self, data: np.ndarray, sizes: np.ndarray, shift: np.ndarray) -> None:
        """Strings one after the other in ``data``; string i begins in column shift[i]. Symbols are bytes and 1; 0 is none."""
        at = np.cumsum(sizes) - sizes
        grid = np.zeros((COLUMNS, len(sizes)), np.uint8)
        column = np.arange(len(data)) - np.repeat(at - shift, sizes)
        grid[column, np.repeat(np.arange(len(sizes)), sizes)] = data + np.uint8(1)  # UTF-8 has no byte 255
        grid = np.ascontiguousarray(grid[::-1])
        self.rows += len(sizes)
        if self.folder is None or self.rows * COLUMNS <= IN_MEMORY:
            self.parts.append((len(sizes), grid, None))
            return
        system, root = fs.FileSystem.from_uri(self.folder)
        system.create_dir(root, recursive=True)
        path = f"{root}/{attempt()}"
        with system.open_output_stream(path) as out:
            out.write(grid.data)
        self.parts.append((len(sizes), system, path))

    def read(self) -> Iterator[np.ndarray]:
        files = [(n, x if path is None else x.open_input_stream(path), path) for n, x, path in self.parts]
        for r in range(COLUMNS):
            yield np.concatenate([x[r] if path is None else np.frombuffer(x.read(n), np.uint8) for n, x, path in files])
        for (_, system, _), (_, x, path) in zip(self.parts, files, strict=True):
            if path is not None:
                x.close()
                system.delete_file(path)


def _insert(symbols: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes grown by these symbols (those that begin strings come before), and their common prefixes.

    ``symbols`` is the transform of the newest column: the symbol before each suffix, in the suffixes' order;
    ``common`` is each suffix's common prefix with the one before. Grown suffixes are in the order of their
    symbols, then as before; the common prefix of two that are next to each other now is one more than the
    smallest between them. Strings without a symbol here are over and drop out.
    """
    order = np.argsort(symbols, kind="stable")
    ordered = symbols[order]
    gone = int(np.searchsorted(ordered, 1))
    grown = np.zeros(len(order), np.uint8)
    same = ordered[1:] == ordered[:-1]
    near = same & (order[1:] == order[:-1] + 1)
    at = np.flatnonzero(near) + 1
    grown[at] = np.minimum(common[order[at]], LENGTH - 1) + 1
    far = np.flatnonzero(same & ~near) + 1
    if len(far):
        ends = np.empty(2 * len(far), np.int64)
        ends[0::2], ends[1::2] = order[far - 1] + 1, order[far] + 1
        found = np.minimum.reduceat(np.append(common, np.uint8(255)), ends)[0::2]
        grown[far] = np.minimum(found, LENGTH - 1) + 1
    return order[gone:], grown[gone:]


def later_strings(columns: _Columns, place: np.ndarray) -> np.ndarray:
    """later[x, i]: whether string i's 100 bytes from column x on also begin, in that column, in a string of a smaller place."""
    later = np.zeros((PLACES, len(place)), bool)
    who, common, inside = np.empty(0, np.int64), np.empty(0, np.uint8), np.zeros(len(place), bool)
    for r, column in enumerate(columns.read()):
        new = np.flatnonzero((column > 0) & ~inside)
        inside[new] = True
        if len(new):  # ends differ from each other and come before all symbols
            if len(common):
                common[0] = 0
            who, common = np.concatenate((new, who)), np.concatenate((np.zeros(len(new), np.uint8), common))
        order, common = _insert(column[who], common)
        who = who[order]
        x = COLUMNS - 1 - r
        if x < PLACES:
            equal = common >= LENGTH
            if equal.any():
                member = equal.copy()
                member[:-1] |= equal[1:]
                some = who[member]
                head = np.flatnonzero(~equal[member])
                lead = np.repeat(np.minimum.reduceat(place[some], head), np.diff(np.append(head, len(some))))
                later[x, some[place[some] > lead]] = True
    return later


def collection(contexts: pa.BinaryArray, doc: np.ndarray, at: np.ndarray, where: np.ndarray, folder: str | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, begin, end) of runs of strings that also start earlier within the contexts; ``where``: the anchors' places in them."""
    columns, n = _Columns(folder), len(doc)
    step = max(1, IN_MEMORY // COLUMNS)
    for i in range(0, n, step):
        raw, cuts = _bytes(contexts.slice(i, step))
        columns.add(raw, np.diff(cuts), PLACES - 1 - where[i : i + step])
    # Strings of one column begin as far from their anchors, so these are in the order of the anchors' places.
    order = np.lexsort((at + where, doc))
    new = np.concatenate(([False], (np.diff(doc[order]) != 0) | (np.diff((at + where)[order]) != 0)))
    place = np.empty(n, np.int64)
    place[order] = np.cumsum(new)
    flags = np.zeros((n, PLACES + 2), np.int8)
    flags[:, 1:-1] = later_strings(columns, place).T
    change = np.diff(flags, axis=1)
    who, first = np.nonzero(change > 0)
    last = np.nonzero(change < 0)[1] - 1
    shift = at[who] + where[who] - PLACES + 1
    return doc[who], shift + first, shift + last + LENGTH


# ---- Spark ----

_LAST = (1 << 63) - 1
_ROWS = "kind byte, ah long, ch long, doc long, at long, n long, w long"
_NAMES = [x.split()[0] for x in _ROWS.split(", ")]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("doc_id", F.lit(_LAST)).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values one after the other, and where each begins and ends."""
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    cuts = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    return raw[cuts[0] : cuts[-1]], cuts - cuts[0]


def _pieces(cuts: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, int]]:
    """(first text, text after the last, the cuts of a piece of about PIECE bytes, where it begins in its text)."""
    i, n = 0, len(cuts) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(cuts, cuts[i] + PIECE, "right")) - 1)
        if cuts[j] - cuts[i] <= PIECE:
            yield i, j, cuts[i : j + 1], 0
        else:
            for lo in range(int(cuts[i]), int(cuts[j]) - LENGTH + 1, PIECE - LENGTH + 1):
                yield i, j, np.array([lo, min(lo + PIECE, int(cuts[j]))]), lo - int(cuts[i])
        i = j


def _batch(kind: int, ah: np.ndarray, ch: np.ndarray, *rest: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(ah), kind, np.int8)), pa.array(ah.view(np.int64)), pa.array(ch.view(np.int64)), *[pa.array(x.astype(np.int64)) for x in rest]], names=_NAMES)


def _folded(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """The first group of each class (kind 0), and the others as ranges (kind 1: at and n are begin and end), joined where they meet."""
    ah, ch, doc, at, n, w = (np.concatenate(x) for x in zip(*held, strict=True))
    key = _scramble(ah ^ (ch * _MIX[2]))
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    some = order[twice]
    later = np.zeros(len(order), bool)
    if len(some):
        some = some[np.lexsort((at[some], doc[some], ch[some], ah[some]))]
        new = np.concatenate(([True], (ah[some][1:] != ah[some][:-1]) | (ch[some][1:] != ch[some][:-1])))
        lead = some[np.maximum.accumulate(np.where(new, np.arange(len(some)), 0))]
        later[some] = (doc[some] != doc[lead]) | (at[some] != at[lead])
    yield _batch(0, *(x[~later] for x in (ah, ch, doc, at, n, w)))
    if later.any():
        doc, begin, end = _joined(doc[later], at[later], at[later] + n[later] + LENGTH - 1)
        spread = _scramble(doc.astype(np.uint64) * _MIX[2] + begin.astype(np.uint64))
        yield _batch(1, spread, spread, doc, begin, end, begin)


def _joined(doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ranges of each document, those that meet as one."""
    if not len(doc):
        return doc, begin, end
    order = np.lexsort((begin, doc))
    doc, begin, end = doc[order], begin[order], end[order]
    head = np.concatenate(([True], doc[1:] != doc[:-1]))
    # Ends so far within a document: documents are lifted above each other.
    lift = np.cumsum(head) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + lift) - lift
    new = np.flatnonzero(head | np.concatenate(([True], begin[1:] > reach[:-1])))
    return doc[new], begin[new], reach[np.append(new[1:], len(doc)) - 1]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The groups of strings of all texts, folded within the task."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    for batch in batches:
        raw, cuts = _bytes(batch.column(1))
        ids = batch.column(0).to_numpy()
        for i, j, here, begin in _pieces(cuts):
            text, ah, ch, first, count, where = anchors(raw[here[0] : here[-1]], here - here[0])
            held.append((ah, ch, ids[i:j][text], first + begin, count, where))
            size += len(ah)
            if size >= FOLD:
                yield from _folded(held)
                held, size = [], 0
    if size:
        yield from _folded(held)


def _leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of groups sorted by ah, ch, doc, at: the first of each class of an anchor with several (kind 0), and later ones as ranges (kind 1).

    Rows of kind 1 pass. The last class stays until the next batch tells whether its anchor has another one.
    """
    held, several = None, False
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if len(done := table.filter(pc.equal(table["kind"], 1))):
            yield from done.to_batches()
            table = table.filter(pc.equal(table["kind"], 0))
        table = pa.concat_tables([held, table]) if held is not None else table
        if not len(table):
            continue
        ah, ch, doc, at, n = (table[x].to_numpy() for x in ("ah", "ch", "doc", "at", "n"))
        new = np.concatenate(([True], (ah[1:] != ah[:-1]) | (ch[1:] != ch[:-1])))
        lead = np.flatnonzero(new)
        first = lead[np.cumsum(new) - 1]
        later = np.flatnonzero((doc != doc[first]) | (at != at[first]))
        if len(later):
            ranges = _joined(doc[later], at[later], at[later] + n[later] + LENGTH - 1)
            out = _batch(1, ranges[0], ranges[0], *ranges, ranges[1])
            yield pa.RecordBatch.from_arrays([*out.columns, *[pa.nulls(len(out), t.type) for t in table.schema][len(_NAMES) :]], names=table.schema.names)
        many = np.zeros(len(lead), bool)
        many[1:] = ah[lead[1:]] == ah[lead[:-1]]
        many[:-1] |= many[1:]
        many[0] |= several
        yield from table.take(lead[:-1][many[:-1]]).to_batches()
        held, several = table.slice(int(lead[-1]), 1), bool(many[-1])
    if several:
        yield from held.to_batches()


def _sorted_leads(rows: DataFrame, *more: str) -> DataFrame:
    schema = ", ".join([_ROWS, *more])
    return rows.repartition("ah").sortWithinPartitions("ah", "ch", "doc", "at").mapInArrow(_leads, schema)


def _contexts(docs: DataFrame, wanted: DataFrame, ws: Workspace, broadcast_docs: int) -> DataFrame:
    """The wanted groups of strings with their texts: kind, ah, ch, doc, at, n, w, context."""
    lists = ws.table(wanted.groupBy("doc").agg(F.collect_list(F.struct(*_NAMES[1:3], *_NAMES[4:])).alias("wants")), "wants")
    # Where rows repeat an id with another text, a group is cut from the text that it is of.
    again = ws.table(docs.groupBy("doc").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("doc", F.lit(True).alias("again")), "again")
    picked = _picked(docs, lists, broadcast_docs).join(lists, "doc").join(again, "doc", "left")
    wants = [F.col(f"wants.{name}").alias(name) for name in (*_NAMES[1:3], *_NAMES[4:])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                raw, cuts = _bytes(part.column(1))
                number = np.diff(part.column(3).offsets.to_numpy())
                ah, ch, at, n, w = (part.column(i).flatten().to_numpy() for i in range(3, 8))
                of = np.repeat(np.arange(part.num_rows), number)
                begin, size = cuts[of] + at, n + LENGTH - 1
                keep = begin + size <= cuts[of + 1]
                twice = part.column(2).is_valid().to_numpy(zero_copy_only=False)
                for k in np.flatnonzero(keep & twice[of]):
                    found = anchors(raw[begin[k] : begin[k] + size[k]], np.array([0, size[k]]))
                    keep[k] = len(found[0]) == 1 and int(found[1].view(np.int64)[0]) == ah[k] and int(found[2].view(np.int64)[0]) == ch[k]
                begin, size, of = begin[keep], size[keep], of[keep]
                ends = np.cumsum(size)
                data = raw[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - ends + size, size)]
                offsets = np.concatenate(([0], ends)).astype(np.int32)
                context = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
                doc = part.column(0).to_numpy()[of]
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(of), np.int8)), *map(pa.array, (ah[keep], ch[keep], doc, at[keep], n[keep], w[keep])), context], names=[*_NAMES, "context"])

    return picked.select("doc", "text", "again", *wants).mapInArrow(run, f"{_ROWS}, context binary")


def _halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each context as its strings of the first and of the second half of the anchor's places; the key is what all strings of a half share.

    Columns lo and hi are the places of the anchor that a context's strings may have.
    """
    for batch in batches:
        out = []
        for _, ah, _, doc, at, n, w, context, lo, hi in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            middle = (lo + hi) // 2
            for a, b in ((lo, middle), (middle + 1, hi)):
                first, last = max(0, w - b), min(n - 1, w - a)
                if first > last or a > b:
                    continue
                text, core = context[first : last + LENGTH], context[w - a : w + LENGTH - b]
                key = hashlib.blake2b(core, digest_size=8, key=f"{ah},{a},{b}".encode()).digest()
                name = hashlib.blake2b(text, digest_size=8, key=f"{w - first}".encode()).digest()
                out.append((0, int.from_bytes(key, "little", signed=True), int.from_bytes(name, "little", signed=True), doc, at + first, last - first + 1, w - first, text, a, b))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 10, batch.schema.types, strict=True)], names=batch.schema.names)


def _picked(docs: DataFrame, lists: DataFrame, broadcast_docs: int, how: str = "left_semi") -> DataFrame:
    """The documents that a list of some names, before their texts are shuffled to meet it."""
    if lists.count() <= broadcast_docs:
        return docs.join(F.broadcast(lists.select("doc")), "doc", how)
    return docs if how == "left_semi" else docs.join(lists.select("doc"), "doc", how)


def repeated_ranges(docs: DataFrame, ws: Workspace, broadcast_docs: int = BROADCAST_DOCS, split: int = SPLIT) -> DataFrame:
    """doc, begin, end: ranges of bytes that together are what later occurrences of strings cover."""
    found = ws.table(_sorted_leads(docs.select("doc", "text").mapInArrow(_groups, _ROWS)), "found")
    as_ranges = lambda x: x.where("kind = 1").select("doc", F.col("at").alias("begin"), F.col("n").alias("end"))
    later, wanted = as_ranges(found), found.where("kind = 0")
    contexts = ws.table(_contexts(docs, wanted, ws, broadcast_docs), "contexts")
    folder, schema = ws.path("columns"), "doc long, begin long, end long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def close() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            doc, at, w = (table[x].to_numpy() for x in ("doc", "at", "w"))
            ranges = _joined(*collection(table["context"].combine_chunks() if table["context"].num_chunks != 1 else table["context"].chunk(0), doc, at, w, folder))
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ranges], names=["doc", "begin", "end"])

        for batch in batches:
            if held and size >= COLLECTION:
                # The first rows of the batch may still be of the last anchor.
                ah, last = batch.column(0).to_numpy(), held[-1].column(0)[-1].as_py()
                more = int(np.argmax(ah != last)) if (ah != last).any() else len(ah)
                held.append(batch.slice(0, more))
                if more < len(ah):
                    yield close()
                    held, size = [], 0
                batch = batch.slice(more)
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
        if held:
            yield close()

    def transformed(rows: DataFrame) -> DataFrame:
        return rows.select("ah", "doc", "at", "w", "context").repartition("ah").sortWithinPartitions("ah").mapInArrow(run, schema)

    level, names = 0, [*_NAMES, "context"]
    while True:
        hot = ws.table(contexts.groupBy("ah").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > split).select("ah"), f"hot-{level}")
        if hot.isEmpty():
            later = later.unionByName(transformed(contexts))
            return ws.table(later, "ranges")
        # Hot anchors are few: at most one for each ``split`` contexts. Their strings are told apart by more of their bytes.
        later = later.unionByName(ws.table(transformed(contexts.join(hot, "ah", "left_anti")), f"ranges-{level}"))
        if level == 0:
            contexts = contexts.select(*names, F.lit(0).cast("long").alias("lo"), F.lit(PLACES - 1).cast("long").alias("hi"))
        rows = contexts.join(hot, "ah", "left_semi").select(*names, "lo", "hi")
        more = ["context binary", "lo long", "hi long"]
        leads = ws.table(_sorted_leads(rows.mapInArrow(_halves, ", ".join([_ROWS, *more])), *more), f"halves-{level}")
        later, contexts, level = later.unionByName(as_ranges(leads)), leads.where("kind = 0"), level + 1


def suffix_dedup(docs: DataFrame, ws: Workspace, broadcast_docs: int = BROADCAST_DOCS, split: int = SPLIT) -> DataFrame:
    """One row per input row: doc_id, n_bytes, spans (the removed runs as [begin, end) in bytes), kept (the other bytes).

    Every byte goes that a 100-byte string covers which also starts earlier: in a smaller doc_id, or before
    in the same document. Null ids come after all others; rows that repeat an id count as one place, and a
    string at the same place in two of them is not earlier in either. Null and empty texts have no bytes.
    A cut may fall inside a character, so the kept bytes need not be UTF-8. An empty table gives an empty
    result; columns other than doc_id and text are ignored, whatever their names.

    Contexts of one anchor count as equal when their 64-bit hashes are, their anchors' hashes, sizes and places
    being equal too: m different contexts of one anchor are mistaken with a chance of m * m / 2 ** 65.
    """
    keyed = _keyed(docs)
    ranges = repeated_ranges(keyed, ws, broadcast_docs, split)
    # Bounded by the document's own anchors.
    lists = ws.table(ranges.groupBy("doc").agg(F.collect_list(F.struct("begin", "end")).alias("ranges")), "lists")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, cuts = _bytes(batch.column(1))
            number = np.diff(batch.column(2).offsets.to_numpy())
            of, sizes = np.repeat(np.arange(batch.num_rows), number), np.diff(cuts)
            begin, end = (batch.column(i).flatten().to_numpy() for i in (2, 3))
            inside = begin < sizes[of]
            of, begin, end = _joined(of[inside], begin[inside], np.minimum(end[inside], sizes[of[inside]]))
            edge = np.zeros(len(raw) + 1, np.int8)
            edge[cuts[of] + begin] += 1
            np.subtract.at(edge, cuts[of] + end, 1)
            left = np.flatnonzero(np.cumsum(edge[:-1], dtype=np.int8) == 0)
            kept = np.searchsorted(left, cuts).astype(np.int32)
            kept = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(kept), pa.py_buffer(np.ascontiguousarray(raw[left]))])
            pairs = np.stack((begin, end), 1).ravel()
            spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(batch.num_rows + 1)), pa.int32()), pa.ListArray.from_arrays(pa.array(np.arange(0, len(pairs) + 1, 2), pa.int32()), pa.array(pairs, pa.int64())))
            ids = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=ids == _LAST), pa.array(sizes, pa.int64()), spans, kept], names=["doc_id", "n_bytes", "spans", "kept"])

    rows = _picked(keyed, lists, broadcast_docs).join(lists, "doc").select("doc", "text", F.col("ranges.begin").alias("begin"), F.col("ranges.end").alias("end"))
    changed = rows.mapInArrow(run, "doc_id long, n_bytes long, spans array<array<long>>, kept binary")
    same = _picked(keyed, lists, broadcast_docs, "left_anti")
    none = F.expr("CAST(array() AS array<array<bigint>>)")
    same = same.select(F.when(F.col("doc") != _LAST, F.col("doc")).alias("doc_id"), F.octet_length("text").cast("long").alias("n_bytes"), none.alias("spans"), F.encode("text", "UTF-8").alias("kept"))
    return changed.unionByName(same)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup(documents(spark, sf_dir), Workspace(spark, "suffix-dedup"))
    return done.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = None
