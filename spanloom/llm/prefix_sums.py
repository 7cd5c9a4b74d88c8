"""Running sums over a sorted table that no single task holds.

Rows are dealt by range and sorted; each task adds up its own rows, and a row per task (its first and last
segment, and the sums at its end) is all that meets on the driver to find what each task has to add.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from .workspace import Workspace, unused


def _wrapped(x: int) -> int:
    """The value as a signed 64-bit number, as overflowing sums leave it."""
    return (x + 2**63) % 2**64 - 2**63


def _carries(ends: list[tuple]) -> dict[int, list[int]]:
    """What the rows of each task's first segment have to add; ``ends`` lists (part, first, last, sums of the last) in order."""
    carries, last, sums = {}, None, []
    for part, first, end, here in ends:
        going_on = last is not None and first == last
        if going_on:
            carries[part] = sums
        sums = [_wrapped(a + b) for a, b in zip(sums, here, strict=True)] if going_on and first == end else list(here)
        last = end
    return carries


def running_sums(df: DataFrame, ws: Workspace, name: str, order: list[Column | str], sums: list[str], segment: str | None = None) -> DataFrame:
    """``df`` with ``before_<column>`` and ``upto_<column>``: the sums of the rows before, and up to, each row of its segment.

    Rows are ordered by ``segment`` (a long column without nulls; without it all rows are one segment), then by
    ``order``; rows that tie get any order among them. Sums are of long columns without nulls and wrap at 64 bits.
    A segment may span any number of tasks. An empty table stays empty.
    """
    part, lead, seq, tie = (unused(df, x) for x in ("part", "lead", "seq", "tie"))
    keys = [*([segment] if segment else []), *order]
    added = [StructField(f"{x}_{c}", LongType()) for c in sums for x in ("before", "upto")]
    mine = [StructField(part, IntegerType()), StructField(lead, BooleanType()), StructField(seq, LongType())]
    at = [df.columns.index(c) for c in sums]
    seg_at = df.columns.index(segment) if segment else None
    width = len(df.columns)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, rows, first, last, carry = TaskContext.get().partitionId(), 0, None, None, [0] * len(at)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            seg = batch.column(seg_at).to_numpy() if segment else np.zeros(n, np.int64)
            if first is None:
                first = seg[0]
            new = np.concatenate(([last is None or seg[0] != last], seg[1:] != seg[:-1]))
            starts = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            out, ends = [], []
            for k, i in enumerate(at):
                v = batch.column(i).to_numpy()
                total = np.cumsum(v)
                upto = total - np.where(starts >= 0, (total - v)[starts], 0) + np.where(starts < 0, np.int64(carry[k]), 0)
                out += [pa.array(upto - v), pa.array(upto)]
                ends.append(int(upto[-1]))
            carry, last = ends, seg[-1]
            own = [pa.array(np.full(n, here, np.int32)), pa.array(seg == first), pa.array(np.arange(rows, rows + n))]
            rows += n
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *out, *own], names=schema.fieldNames())

    schema = StructType([*df.schema.fields, *added, *mine])
    # Rows that repeat are told apart by their place of origin, so that any number of them can be split.
    dealt = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*keys, tie).sortWithinPartitions(*keys)
    local = ws.table(dealt.mapInArrow(add_up, schema), name)
    seg = F.col(segment) if segment else F.lit(0).cast("long")
    at_end = F.max_by(F.struct(seg.alias("s"), F.array(*[F.col(f"upto_{c}") for c in sums]).alias("v")), seq)
    # As many rows as the sort had tasks.
    ends = sorted((r[0], r[1], r[2]["s"], r[2]["v"]) for r in local.groupBy(part).agg(F.min(seg), at_end).collect())
    carries = _carries(ends)

    def carry_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, leads = batch.column(len(schema) - 3).to_numpy(), batch.column(len(schema) - 2).to_numpy(zero_copy_only=False)
            columns = list(batch.columns[: width + len(added)])
            for p in np.unique(parts[leads]).tolist():
                if p in carries:
                    rows = leads & (parts == p)
                    for k, c in enumerate(carries[p]):
                        for i in (width + 2 * k, width + 2 * k + 1):
                            columns[i] = pa.array(columns[i].to_numpy() + np.where(rows, np.int64(c), 0))
            yield pa.RecordBatch.from_arrays(columns, names=done.fieldNames())

    done = StructType([*df.schema.fields, *added])
    return local.mapInArrow(carry_on, done) if carries else local.drop(part, lead, seq)
